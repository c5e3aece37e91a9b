"""Bounded samples of labelled rows, for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remainder(doc_id, modulus: int):
    """crc32 of the id's decimal text, modulo; a null id has no remainder."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus))


def chosen(labels: DataFrame, key: str, label: str, most: int) -> DataFrame:
    """At most ``most`` (key, label) rows in the order of a hash of the key: the same rows however the table is cut. A key with several labels has its smallest."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.min(label).alias(label))
    return known.orderBy(F.xxhash64(key), key).limit(most)


def texts_of(docs: DataFrame, picked: DataFrame, key: str, label: str) -> DataFrame:
    """(key, label, text) of the picked keys that are in docs, each key once, with its smallest text where it has several; a null text comes last."""
    return docs.select(key, "text").join(F.broadcast(picked), key).groupBy(key, label).agg(F.min("text").alias("text"))
