"""The audit's sweep, rounding by exact binary value, and spreads."""

import random
import struct
from decimal import ROUND_HALF_EVEN, Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions import rounding
from tidemark.operators import distributions, sweep
from tidemark.operators.sweep import Stage


def by_hand(x):
    return float(Decimal(x).quantize(Decimal("0.1"), rounding=ROUND_HALF_EVEN))


def test_one_decimal(spark):
    rng = random.Random(2)
    values = [0.25, 0.35, 0.45, 0.75, 2.5, 0.05, 0.15, 1e-300, -0.0, 0.0, -0.25, -0.04, 4503599627370495.5, 2.0**52, 2.0**53, 1e300, 8.0, 1024.0, 0.0099999, 0.01, 0.049999999999999996]
    values += [rng.uniform(-1000, 1000) for _ in range(6000)] + [rng.randint(-(10**6), 10**6) / 20 for _ in range(2000)] + [rng.randint(0, 2**40) / 2**20 for _ in range(2000)] + [10 ** rng.uniform(-4, 15) for _ in range(2000)]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", rounding.one_decimal(F.col("x")).alias("r")).collect()
    bad = [(r.x, r.r, by_hand(r.x) if abs(r.x) < 2**52 else r.x) for r in got if struct.pack("d", r.r + 0.0) != struct.pack("d", (by_hand(r.x) if abs(r.x) < 2**52 else r.x) + 0.0)]
    assert not bad
    odd = [r.r for r in spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (float("-inf"),)], "x double").select(rounding.one_decimal(F.col("x")).alias("r")).collect()]
    assert odd[0] is None and odd[1] != odd[1] and odd[2:] == [float("inf"), float("-inf")]


def test_spread_by_hand(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice([None, rng.randint(0, 400) / 8, rng.random() * 50])) for _ in range(4000)] + [("one", 0.25), ("two", 1.0), ("two", 1.5), ("none", None)]
    got = {r.g: tuple(r)[1:] for r in distributions.spread(spark.createDataFrame(rows, "g string, v double").repartition(6), ["g"], "v").collect()}
    want = {}
    for g in {r[0] for r in rows if r[1] is not None}:
        xs = sorted(v for h, v in rows if h == g and v is not None)
        marks = []
        for p in (0.5, 0.75, 0.9):
            k = (len(xs) - 1) * p
            low = int(k)
            marks.append(by_hand(xs[low] + (xs[min(low + 1, len(xs) - 1)] - xs[low]) * (k - low)))
        want[g] = (len(xs), *marks)
    assert got == want


def test_a_failed_stage_is_recorded(spark):
    """Errors when planning and in tasks, empty results, missing needs and skips; what follows still runs."""
    some = spark.range(5)
    boom = lambda t: some.select(F.raise_error(F.lit("mail a@b.cc: secret-token-1 broke")).alias("x"))
    stages = [
        Stage("collect", lambda t: some), Stage("plan", lambda t: t["collect"].select("nothing")), Stage("task", boom), Stage("empty", lambda t: some.where("id > 9"), some_rows=True), Stage("no rows", lambda t: some.where("id > 9")),
        Stage("later", lambda t: some, ("task",)), Stage("board", None, skip="not set up"), Stage("last", lambda t: t["collect"].where("id > 1"), ("collect", "no rows")), Stage("python", lambda t: 1 / 0),
    ]
    outcomes, tables = sweep.sweep(spark, stages)
    rows = outcomes.orderBy("place").collect()
    assert [(r.stage, r.status, r.n_rows) for r in rows] == [("collect", "succeeded", 5), ("plan", "failed", None), ("task", "failed", None), ("empty", "failed", 0), ("no rows", "succeeded", 0), ("later", "failed", None), ("board", "skipped", None), ("last", "succeeded", 3), ("python", "failed", None)]
    assert set(tables) == {"collect", "no rows", "last"} and rows[5].reason == "needs task" and "division by zero" in rows[8].reason
    lines = [r.line for r in sweep.gap_lines(outcomes, ["secret-token-1"]).orderBy("place").collect()]
    assert len(lines) == 6 and "`board` was not attempted (not set up)" in lines[-1] and all("not assessed" in x for x in lines)
    assert not any("secret-token-1" in x or "a@b.cc" in x for x in lines) and all(len(x) < 420 for x in lines)
    with pytest.raises(ValueError, match="different names"):
        sweep.sweep(spark, [stages[0], stages[0]])
    assert sweep.sweep(spark, [])[0].count() == 0
