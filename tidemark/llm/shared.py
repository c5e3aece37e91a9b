"""Tables written to the folder that driver and executors share, to cut lineage; joins on keys that may be hot."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset (tests, one machine), under a new temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The same rows, read from Parquet."""
    spark, path = df.sparkSession, folder(df.sparkSession)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


#: A hot key has more than the HOT-th part of all rows, so at most so many keys are hot; and more than LEAST_HOT rows, which any task can read.
HOT, LEAST_HOT = 4096, 1000


def join_hot(rows: DataFrame, side: DataFrame, on: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined to a side that has each key once and, as ``weight``, how many of the ``total`` rows hold it: inner, left or left_anti.

    Keys with more than total / HOT rows and LEAST_HOT (fewer than HOT of them, so they are broadcast) join where their rows are; all others are shuffled, and none is large.
    """
    bound = max(LEAST_HOT, total // HOT)
    few = F.broadcast(side.where(F.col(weight) > bound))
    rest = side.where(F.col(weight) <= bound).hint("merge")
    cold = rows.join(F.broadcast(side.where(F.col(weight) > bound).select(on)), on, "left_anti")
    if how == "left_anti":
        return cold.join(rest, on, "left_anti")
    out = cold.join(rest, on, how)
    return out.unionByName(rows.join(few, on).select(*out.columns))
