"""Row numbers within groups, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.rounds import cut


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str = "n") -> DataFrame:
    """The rows and their number, from 1, along ``order`` within ``group`` (nulls are a group and come first). ``order`` should tell rows apart.

    Rows are range-partitioned by group and order, so a hot group spans partitions; each counts its own rows, and a row a partition and group tells where its numbers start."""
    keys = [*group, *order]
    placed = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    firsts = placed.groupBy("_part", *group).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) if group else F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = firsts.select(*[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)], F.col("_part").alias("_p"), (before - F.col("_first")).alias("_shift"))
    same = F.col("_part") == F.col("_p")
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    return placed.join(starts, same).select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("_at") + F.col("_shift") + 1).alias(name))
