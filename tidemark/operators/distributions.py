"""Sizes and spreads of samples: interpolated percentiles without a task that holds a group, rounded once to one decimal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rounding
from ..functions.timefx import seconds
from ..sources import model
from ..sources.rounds import cut
from .numbering import numbered

MARKS = ((0.5, "median"), (0.75, "p75"), (0.9, "p90"))


def spread(rows: DataFrame, group: list[str], value: str, marks: tuple = MARKS) -> DataFrame:
    """Per group: n and the marks of a column, each between the two order statistics around (n - 1) p, rounded by ``rounding.one_decimal``. Null values don't count; a group without others is left out.

    Values are numbered over range partitions, so a hot group spans tasks; only the order statistics wanted, two a mark, meet again."""
    known = numbered(rows.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("_v")), group, ["_v"], "_i")
    known = cut(known)
    sizes = known.groupBy(*group).agg(F.max("_i").alias("n"))
    at = lambda p: (F.col("n") - 1) * F.lit(p)
    wanted = F.array_distinct(F.concat(*[F.array(F.floor(at(p)) + 1, F.least(F.floor(at(p)) + 2, F.col("n"))) for p, _ in marks]))
    named = [F.col(g).alias(f"_g{k}") for k, g in enumerate(group)]
    asked = sizes.select(*named, "n", F.explode(wanted).alias("_w"))
    same = F.col("_i") == F.col("_w")
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    found = known.join(asked, same).groupBy(*group, "n").agg(F.map_from_entries(F.collect_list(F.struct("_w", "_v"))).alias("_m"))
    get = lambda i: F.element_at("_m", i)
    low = lambda p: get(F.floor(at(p)) + 1)
    mark = lambda p: low(p) + (get(F.least(F.floor(at(p)) + 2, F.col("n"))) - low(p)) * (at(p) - F.floor(at(p)))
    return found.select(*group, "n", *[rounding.one_decimal(mark(p)).alias(name) for p, name in marks])


def lead_spread(spark, sf_dir):
    """Days from creation to completion by team and year of completion."""
    rows = model.issues(spark, sf_dir).where("completed_at is not null")
    days = seconds("created_at", "completed_at") * 1000.0 / 86400000.0
    return spread(rows.select("team_key", F.year("completed_at").cast("long").alias("y"), days.alias("days")), ["team_key", "y"], "days")


def text_spread(spark, sf_dir):
    """Lengths of documents, in thousands of characters, by language and in all (null)."""
    docs = model.table(spark, sf_dir, "documents").select("lang", (F.char_length("text") / F.lit(1000.0)).alias("size"))
    both = docs.select(F.explode(F.array("lang", F.lit("(all)"))).alias("lang"), "size")
    return spread(both, ["lang"], "size")
