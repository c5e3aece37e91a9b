"""Carrying whole rows through an operator, whatever their columns are called."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def packed(df: DataFrame, *names: str) -> DataFrame:
    """The named columns and the whole row as one column ``_row``."""
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    return df.select(*names, whole)


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("_row.*")
