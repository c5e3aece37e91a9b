"""The filtered join of like names against all pairs, in plain Python."""

import random

import pytest

from tidemark.operators import contributors, near_names


def jaro_winkler(a, b):
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, mine = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                mine.append(c)
                break
    m = len(mine)
    if not m:
        return 0.0
    moved = sum(x != y for x, y in zip(mine, (c for c, u in zip(b, used) if u))) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3.0
    common = next((k for k, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return jaro + common * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


@pytest.mark.parametrize("least", [0.85, 0.76, 1.0])
def test_equals_all_pairs(spark, least):
    rng = random.Random(int(least * 100))
    parts = ["an", "na", "mar", "ia", "jo", "han", "nes", "li", "sa", "é", "q", "o'", "dev", "1", "2", "smith", " "]
    made = lambda n: {"".join(rng.choice(parts) for _ in range(rng.randint(1, 6))) for _ in range(n)}
    names, members = sorted(made(900)), sorted(made(250))
    names += ["".join(rng.sample(m, len(m))) for m in members[:100]] + [m[:-1] + "z" for m in members[:100]] + members[:20]
    got = near_names.alike(spark.createDataFrame([(n,) for n in [*names, None, "", names[0]]], "name string"), spark.createDataFrame([(m,) for m in [*members, None, ""]], "member string"), least)
    want = {(a, b): s for a in set(names) for b in members if a and b and (s := jaro_winkler(a, b)) >= least}
    rows = {(r.name, r.member): r.score for r in got.collect()}
    assert rows.keys() == want.keys() and len(want) >= 20 and all(abs(rows[k] - want[k]) < 1e-12 for k in want)


def test_refuses_low_bounds(spark):
    with pytest.raises(ValueError, match="0.75"):
        near_names.alike(spark.createDataFrame([], "name string"), spark.createDataFrame([], "member string"), 0.5)
    assert near_names.best(spark.createDataFrame([], "name string"), spark.createDataFrame([], "member string")).count() == 0


def test_contributors_by_spelling(spark):
    authors = [(1, "jane@a.bc", "Jane Doe", '["jd"]'), (2, "bob@a.bc", "Bob Matsuoka", "[]"), (3, "b2@a.bc", "Bob Matsuoka", "[]"), (4, "x@a.bc", None, None)]
    frame = spark.createDataFrame(authors, "id long, canonical_email string, canonical_name string, aliases string")
    asked = spark.createDataFrame([("Jane Do",), ("bob.matsuoka",), ("JD",), ("zzz",), (None,), ("",), ("b_o_b-matsuka",)], "query string")
    got = {r.query: (r.id, r.how) for r in contributors.find(asked, frame, fuzzy=True).collect()}
    assert got == {"Jane Do": (1, "fuzzy"), "bob.matsuoka": (2, "fuzzy"), "JD": (1, "alias"), "zzz": (None, "none"), None: (None, "none"), "": (None, "none"), "b_o_b-matsuka": got["b_o_b-matsuka"]}
    assert got["b_o_b-matsuka"][1] in ("fuzzy", "normalised") and got["b_o_b-matsuka"][0] == 2
    assert {r.how for r in contributors.find(asked, frame).collect()} == {"alias", "none"}
    assert contributors.fuzzy_allowed(frame.limit(0)) and not contributors.fuzzy_allowed(frame) and contributors.fuzzy_allowed(frame, True)
