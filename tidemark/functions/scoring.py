"""Scores and bands over columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upper_middle(rows: DataFrame, value: str, bins: int = 4096) -> DataFrame:
    """One row, ``median_hours``: the upper middle of all values of a column, null of none. No task holds all values: counts by bin find the bin of the middle, then only that bin is ranked."""
    span = rows.agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.count(value).alias("_n"))  # one row
    width = F.greatest((F.col("_high") - F.col("_low")) / bins, F.lit(1e-300))
    binned = rows.where(F.col(value).isNotNull()).crossJoin(F.broadcast(span)).select(F.col(value).alias("_v"), F.floor((F.col(value) - F.col("_low")) / width).alias("_bin"), F.floor(F.col("_n") / 2).alias("_at"))
    counts = binned.groupBy("_bin", "_at").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy("_at").orderBy("_bin")) - F.col("_c")  # a row a bin
    middle = counts.withColumn("_before", before).where("_before <= _at and _at < _before + _c").select("_bin", "_before")  # one row
    values = binned.join(F.broadcast(middle), "_bin").groupBy("_v", "_at", "_before").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy("_at").orderBy("_v")) + F.col("_before")  # a row a value of one bin
    return values.withColumn("_upto", upto).where("_upto > _at").agg(F.min("_v").alias("median_hours"))


def upper_median(values) -> Column:
    """The upper middle of the sorted values: index n/2, not interpolated."""
    ordered = F.array_sort(F.collect_list(values))
    return F.try_element_at(ordered, (F.floor(F.size(ordered) / 2) + 1).cast("int"))


def effort(loc, n_files, test_loc) -> Column:
    """log2(loc+1) + 1.5 log2(files+1) + (1 - 0.3 * share of tests, at most 1)."""
    share = F.least(test_loc / F.greatest(loc, F.lit(1)), F.lit(1.0))
    return F.log2(loc + 1) + F.lit(1.5) * F.log2(n_files + 1) + (1 - F.lit(0.3) * share)


def effort_size(score) -> Column:
    """Bands with inclusive upper bounds."""
    return F.when(score <= 6, "XS").when(score <= 10, "S").when(score <= 14, "M").when(score <= 18, "L").otherwise("XL")


def weekly_quality(commits, reverts, bugfixes, ticketed) -> Column:
    rate = lambda x: F.least(x / commits, F.lit(1.0))
    score = F.lit(0.35) * (1 - rate(reverts)) + F.lit(0.40) * (1 - rate(bugfixes)) + F.lit(0.25) * rate(ticketed)
    return F.when(commits == 0, F.lit(0.75)).otherwise(score)


def quality_size(score) -> Column:
    """Five bands of 0.20; a score on a bound is in the lower band."""
    return F.when(score <= 0.20, "XS").when(score <= 2.0 * 0.20, "S").when(score <= 3.0 * 0.20, "M").when(score <= 4.0 * 0.20, "L").otherwise("XL")


def share(part, whole) -> Column:
    """Percent; null when there is nothing to share."""
    return F.when(whole == 0, F.lit(None).cast("double")).otherwise(part * 100.0 / whole)


def wilson(hits, n) -> tuple[Column, Column]:
    """Bounds of the 95 % interval; null without trials."""
    z = 1.959963984540054
    p = hits / n
    centre, spread = p + z * z / (2.0 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))
    none = F.lit(None).cast("double")
    low = F.when(n > 0, (centre - spread) / (1 + z * z / n)).otherwise(none)
    return low, F.when(n > 0, (centre + spread) / (1 + z * z / n)).otherwise(none)
