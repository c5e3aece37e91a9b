"""Rounds of joins against plain Python."""

import random

from pyspark.sql import functions as F

from tidemark.operators.evaluation import alike, like_pairs, tagged, tokens, water_fill
from tidemark.operators.graphs import strong_components


def test_components_against_reachability(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(24), rng.randrange(24)) for _ in range(34)] + [(30, 31), (31, 30), (40, 40), (None, 1), (1, None)]
    reach = {n: {b for a, b in edges if a == n} for n in range(50)}
    for _ in range(50):
        for n in reach:
            reach[n] |= {c for b in reach[n] if b is not None for c in reach[b]}
    want = {n: frozenset(m for m in reach if m in reach[n] and n in reach[m]) for n in reach}
    want = {n: c for n, c in want.items() if len(c) > 1}
    got = {r.id: r.component for r in strong_components(spark.createDataFrame(edges, "id long, next long")).collect()}
    assert set(got) == set(want) and all((got[a] == got[b]) == (want[a] == want[b]) for a in got for b in got)
    assert strong_components(spark.createDataFrame([], "id long, next long")).count() == 0


def _likeness(a, b):
    import re

    a, b = ([t for t in re.split(r"[\W_]+", (x or "").lower()) if t] for x in (a, b))
    if not a or not b:
        return float(not a and not b)
    both = sum(t in b for t in a)
    return both / (len(a) + len(b) - both)


def test_findings_against_plain_python(spark):
    rng = random.Random(6)
    words = ["slow", "tests", "are", "flaky", "in", "core"]
    rows = [(i, f"p{i % 3}", i // 15, " ".join(rng.choice(words) for _ in range(rng.randint(2, 5))), rng.random()) for i in range(60)]
    rows += [(60, "p0", 4, None, 0.5), (61, "p0", 4, "", 0.9), (62, "q", 1, "alone", None)]
    got = {r.id: (r.leader, r.trend) for r in tagged(spark.createDataFrame(rows, "id long, profile string, period int, text string, confidence double")).collect()}
    want = {}
    for profile in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == profile]
        heads = []
        for r in mine:
            lead = next((h for h in heads if _likeness(h[3], r[3]) >= 0.7), None)
            if lead is None:
                heads.append(r)
            want[r[0]] = (lead or r)[0]
        for h in heads:
            group = [r for r in mine if want[r[0]] == h[0]]
            now, earlier = any(r[2] == mine[-1][2] for r in group), any(r[2] != mine[-1][2] for r in group)
            up = now and earlier and group[-1][4] > group[0][4] + 0.1
            for r in group:
                want[r[0]] = (h[0], "worsening" if up else "recurring" if now and earlier else "new" if now else "resolved")
    assert got == want
    assert spark.range(1).select(alike(tokens(F.lit("a a b")), tokens(F.lit("A c"))).alias("x")).first().x == 2 / 3


def test_like_pairs_against_all_pairs(spark):
    rng = random.Random(7)
    words = ["a", "a", "a", "b", "c", "d", "e", "f", "g"]
    rows = [(i, f"p{i % 2}", [rng.choice(words) for _ in range(rng.randint(1, 9))]) for i in range(160)] + [(i, "p0", ["a"] * (i - 159)) for i in range(160, 168)]
    frame = spark.createDataFrame(rows, "id long, profile string, tokens array<string>")
    for least in (0.5, 0.7, 1.0):
        want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and _likeness(" ".join(a[2]), " ".join(b[2])) >= least}
        got = [tuple(r) for r in like_pairs(frame, least).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    empty = spark.createDataFrame([(3, "p", []), (1, "p", []), (2, "p", []), (4, "q", [])], frame.schema)
    assert sorted(map(tuple, like_pairs(empty).collect())) == [(1, 2), (1, 3)]
    assert like_pairs(frame.limit(0)).count() == 0


def test_water_fill(spark):
    for sizes, total, want in [([5, 100, 100], 50, [5, 23, 22]), ([3, 4], 50, [3, 4]), ([10, 10, 10], 10, [4, 3, 3]), ([1, 2, 50], 9, [1, 2, 6])]:
        frame = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "stratum string, n long")
        assert [r.share for r in water_fill(frame, total).orderBy("stratum").collect()] == want
