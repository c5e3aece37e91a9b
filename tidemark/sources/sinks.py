"""Sinks: reports as files, keyed upsert, insert-ignore, and replacing whole partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """With a header; ``single`` for reports that are small by nature."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str, single: bool = False) -> None:
    (df.coalesce(1) if single else df).write.mode("overwrite").json(path)


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """The partitions that df has rows of are replaced, the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def upserted(stored: DataFrame, new: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row a key: the first by ``order`` of stored and new rows; new rows win ties."""
    rows = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order, F.desc("_new")))
    return rows.withColumn("_place", place).where("_place = 1").drop("_new", "_place")


def added(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Stored rows, and one new row of each key that isn't stored."""
    return stored.unionByName(new.dropDuplicates(key).join(stored.select(*key), key, "left_anti").select(*stored.columns))


def rebuild(df: DataFrame, path: str) -> None:
    """The whole table anew. Spark writes beside what is there and commits at the end; the table must not be one that df reads."""
    df.write.mode("overwrite").parquet(path)


def write_markdown(df: DataFrame, path: str, title: str, order: list, most: int = 10) -> None:
    """The first rows by ``order`` as a table under a heading; a report of at most ``most`` rows, so one file of a few lines."""
    cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in df.columns]
    head = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    top = df.orderBy(*order).limit(most).select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    body = top.agg(F.array_join(F.concat(F.array(*[F.lit(h) for h in head]), F.collect_list("line")), "\n").alias("value"))
    body.coalesce(1).write.mode("overwrite").text(path)
