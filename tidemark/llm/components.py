"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import join_hot, written


def _stars(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """One round. Rows (a, b) with a > b; each a or b is hung below the smallest of its (larger or smaller) neighbours."""
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n")).select("a", F.least("a", "low").alias("low"), "n")
        out = join_hot(both, least, "a", "n", 2 * total).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n"))
        out = join_hot(edges, least, "a", "n", total).where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).union(least.select("a", F.col("low").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, root) for every node a that isn't the smallest of its component. ``edges``: columns a and b, any order, loops and repeats allowed."""
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        sizes = edges.groupBy("a").agg(F.count("*").alias("n"))
        row = sizes.agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
        if row.n is None or (row.most == 1 and not edges.select("b").distinct().join(sizes.select(F.col("a").alias("b")).hint("merge"), "b", "left_semi").head(1)):
            return edges.select("a", F.col("b").alias("root"))  # stars: each a below one b, and no b below another
        edges = written(_stars(written(_stars(edges, True, row.n)), False, 2 * row.n))
