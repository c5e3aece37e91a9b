"""The alias table (email, canonical_email, name): every change gives a new table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _is(column: str, value: str):
    return F.lower(column).eqNullSafe(value.lower())


def add(aliases: DataFrame, email: str, canonical: str) -> DataFrame:
    """``email`` counts as ``canonical`` from now on, under the name that canonical has."""
    new = aliases.where(_is("canonical_email", canonical)).agg(F.max("name").alias("name"))
    row = new.select(F.lit(email).alias("email"), F.lit(canonical).alias("canonical_email"), "name")
    return aliases.where(~_is("email", email)).select("email", "canonical_email", "name").union(row)


def remove(aliases: DataFrame, email: str) -> DataFrame:
    return aliases.where(~_is("email", email))


def merge(aliases: DataFrame, source: str, target: str) -> DataFrame:
    """All addresses of one identity go to another, whose name they take."""
    name = aliases.where(_is("canonical_email", target)).agg(F.max("name").alias("kept"))
    moved = _is("canonical_email", source)
    return aliases.join(F.broadcast(name)).select("email", F.when(moved, F.lit(target)).otherwise(F.col("canonical_email")).alias("canonical_email"), F.when(moved, F.coalesce("kept", "name")).otherwise(F.col("name")).alias("name"))  # one row


def unmerge(aliases: DataFrame, email: str) -> DataFrame:
    """An address is its own identity again."""
    return aliases.withColumn("canonical_email", F.when(_is("email", email), F.col("email")).otherwise(F.col("canonical_email")))


def rename(aliases: DataFrame, canonical: str, name: str) -> DataFrame:
    return aliases.withColumn("name", F.when(_is("canonical_email", canonical), F.lit(name)).otherwise(F.col("name")))


def applied(rows: DataFrame, aliases: DataFrame, email: str = "author_email") -> DataFrame:
    """rows with ``canonical_email``: the alias of its address, else the address. Of several aliases of an address the least counts."""
    known = aliases.groupBy(F.lower("email").alias("_email")).agg(F.min("canonical_email").alias("canonical_email"))
    return rows.join(known, F.lower(email) == F.col("_email"), "left").withColumn("canonical_email", F.coalesce("canonical_email", email)).drop("_email")
