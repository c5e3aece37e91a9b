"""Streams: keyed upsert by micro-batch, and weekly windows behind a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import upserted


def keep_latest(stream: DataFrame, path: str, key: list[str], order: list):
    """A query over what is there now that leaves one row a key in ``path``/v<batch>. A batch that is run again writes the same folder, so re-read rows do no harm."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stored = spark.read.schema(batch.schema).parquet(f"{path}/v{number - 1}") if number else batch.limit(0)
        upserted(stored, batch, key, order).write.mode("overwrite").parquet(f"{path}/v{number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()


def weekly_counts(stream: DataFrame, time: str, by: list[str], late: str = "7 days") -> DataFrame:
    """Events of each week from Monday (UTC); rows later than ``late`` are dropped and closed weeks leave the state."""
    week = F.window(time, "7 days", startTime="4 days")  # the epoch was a Thursday
    return stream.withWatermark(time, late).groupBy(week.alias("week"), *by).agg(F.count("*").alias("n")).select(F.col("week.start").alias("monday"), *by, "n")
