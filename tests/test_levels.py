"""Delivery levels at each bound, test paths, first commits after deployments, near people and middles against plain Python."""

import collections
import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.functions import scoring, textfx
from tidemark.operators import delivery, tracker


def test_levels_at_each_bound(spark):
    inf = float("inf")
    cases = [
        (1.0, 0.99, 0.149, 0.99, "elite"), (0.99, 0.5, 0.1, 0.5, "high"), (1.0, 1.0, 0.1, 0.5, "high"), (1.0, 0.5, 0.15, 0.5, "high"), (1.0, 0.5, 0.1, 1.0, "high"), (0.25, 167.9, 0.29, 23.9, "high"),
        (0.24, 100.0, 0.2, 10.0, "medium"), (1.0, 168.0, 0.2, 10.0, "medium"), (1.0, 0.5, 0.1, 24.0, "medium"), (0.04, 719.9, 0.29, 167.9, "medium"), (0.039, 1.0, 0.1, 1.0, "low"), (9.0, 720.0, 0.1, 0.0, "low"),
        (9.0, 0.5, 0.3, 0.0, "low"), (9.0, 0.5, 0.1, 168.0, "low"), (9.0, inf, 0.0, 0.0, "low"),
    ]
    frame = spark.createDataFrame(cases, "often double, lead double, rate double, heal double, want string")
    for r in frame.withColumn("got", delivery.level(*[F.col(c) for c in ("often", "lead", "rate", "heal")])).collect():
        assert r.got == r.want, r


def test_test_paths(spark):
    yes = ["tests/a.rs", "x/tests/a.rs", "tests", "__tests__/a.js", "x/__tests__/a.js", "src/foo_test.rs", "src/test_foo.py", "a/auth.spec.ts", "a/auth.test.js", "TESTS/A.rs"]
    no = ["src/foo.rs", "contest/a.rs", "src/testing.py", "latest_x/a.py", "spec.ts", "test.js", "a/test_x/b.rs", "foo_test.go", "a.test/b", ""]
    frame = spark.createDataFrame([(p, p in yes) for p in yes + no], "path string, want boolean")
    for r in frame.withColumn("got", textfx.is_test_path(F.col("path"))).collect():
        assert r.got == r.want, r.path


def test_first_commit_after(spark):
    rng, start = random.Random(3), dt.datetime(2024, 1, 1)
    at = lambda: start + dt.timedelta(minutes=30 * rng.randrange(600))
    d = [(k, f"r{rng.randrange(3)}", at()) for k in range(120)] + [(999, "none", start)]
    c = [(k, f"r{rng.randrange(3)}", at(), f"m{k}") for k in range(90)]
    got = delivery.first_after(spark.createDataFrame(d, "deploy_id long, repo string, triggered_at timestamp_ntz"), spark.createDataFrame(c, "id long, repository string, ts timestamp_ntz, message string"), 24).collect()
    want = {}
    for k, repo, t in d:
        after = sorted((ts, i) for i, r, ts, _ in c if r == repo and t < ts <= t + dt.timedelta(hours=24))
        if after:
            want[k] = after[0][1]
    assert {r.deploy_id: r.id for r in got} == want and len(got) == len(want)


def test_near_people_of_few_words(spark, monkeypatch):
    """Words that many people have: each pair once, and pairs spread over tasks."""
    monkeypatch.setattr(tracker, "BLOCK", 16)
    people = [(k, 0 if k < 390 else 1, f"dev{k % 4}") for k in range(400)]
    got = tracker.near_people(spark.createDataFrame(people, "id long, domain long, local string")).withColumn("task", F.spark_partition_id()).collect()
    want = {(a, b) for a, d, x in people for b, e, y in people if a < b and d == e and x != y}
    assert len(got) == len(want) and {(r.id, r.other) for r in got} == want and {(r.edits, r.confidence) for r in got} == {(1, 0.85)}
    tasks = collections.Counter(r.task for r in got)
    assert max(tasks.values()) < len(got) / 4


def test_near_people(spark):
    rng = random.Random(1)
    people = [(k, rng.randrange(2), "".join(rng.choice("abc") for _ in range(rng.randrange(0, 6)))) for k in range(80)]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next(row, i, x, b)
        return row[-1]

    def _next(row, i, x, b):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
        return out

    want = {(i, j, edits(a, b)) for i, p, a in people for j, q, b in people if i < j and p == q and 1 <= edits(a, b) <= 2}
    got = tracker.near_people(spark.createDataFrame(people, "id long, domain long, local string")).collect()
    assert {(r.id, r.other, r.edits) for r in got} == want and len(got) == len(want)


def test_upper_middle(spark):
    rng = random.Random(2)
    for values in ([], [3.0], [1.0, 2.0], [5.0] * 7, [rng.random() for _ in range(501)], [rng.choice([1.0, 2.0, 900.0]) for _ in range(100)] + [None]):
        got = scoring.upper_middle(spark.createDataFrame([(v,) for v in values], "h double"), "h").first().median_hours
        known = sorted(v for v in values if v is not None)
        assert got == (known[len(known) // 2] if known else None)
