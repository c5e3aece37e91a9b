from datetime import datetime

from pyspark.sql import functions as F

from tidemark.functions import scoring, textfx
from tidemark.functions.timefx import calendar_week, iso_week


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_week_systems(spark):
    days = [(datetime(2024, 12, 30),), (datetime(2027, 1, 1),), (datetime(2021, 1, 3),)]
    rows = spark.createDataFrame(days, "t timestamp_ntz").select(iso_week("t").alias("iso"), calendar_week("t").alias("cal")).collect()
    assert [r.iso for r in rows] == ["2025-W01", "2026-W53", "2020-W53"]
    assert [r.cal for r in rows] == [d[0].strftime("%Y-W%W") for d in days]


def test_effort_bounds_belong_to_the_lower_band(spark):
    for score, size in ((6.0, "XS"), (6.01, "S"), (10.0, "S"), (14.0, "M"), (18.0, "L"), (18.5, "XL")):
        assert _one(spark, scoring.effort_size(F.lit(score))) == size


def test_quality_without_commits(spark):
    zero = F.lit(0).cast("double")
    assert _one(spark, F.try_divide(F.lit(1), zero)) is None
    assert spark.sql("select 0 a, 0 b").select(F.when(F.col("a") == 0, 0.75).alias("x")).first().x == 0.75


def test_upper_median_takes_the_upper_middle(spark):
    assert spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double").agg(scoring.upper_median("v").alias("x")).first().x == 3.0


def test_reverts_and_words(spark):
    texts = [("fix: revert y", True), ("reverted z", False), ('Revert "x"', True), ("revertible", False), ("revert(api): y", True), ("  REVERT it", True), ("fixes: the --revert flag", False), ("fix(revert): x", True), ("fixed x and revert", True), ("fix x\nrevert y", False), ("feat: revert y", False), ("fix--no-revert", True)]
    for text, want in texts:
        assert _one(spark, textfx.is_revert(F.lit(text))) == want
    assert _one(spark, textfx.word_count(F.lit("  a b\n c "))) == 3
    assert _one(spark, textfx.word_count(F.lit("  "))) == 0


def test_wilson_contains_the_share(spark):
    low, high = scoring.wilson(F.lit(8), F.lit(10))
    assert _one(spark, low) < 0.8 < _one(spark, high)
