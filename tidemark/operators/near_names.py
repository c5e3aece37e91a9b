"""Names alike by Jaro-Winkler, found through a filter that loses no pair and never pairs all names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import jaro_winkler
from ..sources import model
from ..sources.rounds import cut

#: Characters that candidates share among their rarest; of each name, lengths that no bound admits are never tried.
SHARED = 2


def _needed(a: Column, b: Column, least: float, common: Column) -> Column:
    """Characters that names of these lengths with so many common first characters must share to reach ``least``: with m matches Jaro's mean is at most (m/a + m/b + 1) / 3."""
    jaro = (F.lit(least) - common * 0.1) / (F.lit(1.0) - common * 0.1)
    return F.greatest(F.ceil((jaro * 3 - 1) * a * b / (a + b) - 1e-9).cast("int"), F.lit(1))


def _characters(names: DataFrame, name: str) -> DataFrame:
    """Adds the characters of each distinct name, repeated ones numbered, as (character, number)."""
    chars = F.filter(F.split(name, ""), lambda c: c != "")
    numbered = F.transform(chars, lambda c, i: F.struct(c.alias("c"), F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda d: d == c)).alias("n")))
    return names.select(name).where(F.length(name) > 0).distinct().withColumn("chars", numbered)


def _keys(names: DataFrame, name: str, ranks: DataFrame, others: DataFrame, least: float, first: bool) -> DataFrame:
    """(own name, key): combinations of SHARED of the rarest characters, for each length that a partner may have."""
    ranked = names.select(name, F.explode("chars").alias("t")).join(ranks, "t").groupBy(name).agg(F.transform(F.array_sort(F.collect_list(F.struct("count", "t"))), lambda s: s["t"]).alias("rare"))
    rows = ranked.crossJoin(F.broadcast(others)).select(name, "rare", F.explode("lengths").alias("b"))  # one row of lengths
    a, b = F.size("rare"), F.col("b")
    need = _needed(a, b, least, F.least(a, b, F.lit(4)))
    rows = rows.withColumn("need", need).where(F.col("need") <= F.least(a, b)).withColumn("k", F.least(F.lit(SHARED), "need"))
    front = F.slice("rare", F.lit(1), F.least(a, a - F.col("need") + F.col("k")))
    pairs = F.flatten(F.transform(front, lambda x, i: F.transform(F.slice(front, i + 2, F.size(front)), lambda y: F.array(x, y))))
    combos = F.when(F.col("k") == 1, F.transform(front, lambda x: F.array(x))).otherwise(pairs)
    lengths = F.struct(a.alias("left"), b.alias("right")) if first else F.struct(b.alias("left"), a.alias("right"))
    return rows.select(name, lengths.alias("lengths"), F.explode(combos).alias("combo"))


def alike(names: DataFrame, members: DataFrame, least: float = 0.85) -> DataFrame:
    """(name, member, score) of all distinct pairs from names (name) and members (member) whose similarity is at least ``least``, 0.75 or more.

    Names that reach the bound share so many characters (``_needed``) that, with the characters of all names in one order, rare ones first, they share SHARED among the first
    few. Names meet on these and on both lengths; what they share is then counted with their common beginning, and only the rest compared. Null and empty names are like none."""
    if not 0.75 <= least <= 1:
        raise ValueError("a bound from 0.75 to 1 is needed")
    left, right = cut(_characters(names, "name")), cut(_characters(members, "member"))
    ranks = left.select(F.explode("chars").alias("t")).unionAll(right.select(F.explode("chars").alias("t"))).groupBy("t").count()
    lengths = lambda rows: rows.agg(F.collect_set(F.size("chars")).alias("lengths"))
    met = _keys(left, "name", ranks, lengths(right), least, True).join(_keys(right, "member", ranks, lengths(left), least, False), ["lengths", "combo"]).select("name", "member").distinct()
    rows = met.join(left, "name").join(right.withColumnRenamed("chars", "theirs"), "member")
    common = F.lit(0)
    for k in range(4, 0, -1):
        common = F.when((F.left("name", F.lit(k)) == F.left("member", F.lit(k))) & (F.length("name") >= k) & (F.length("member") >= k), F.greatest(common, F.lit(k))).otherwise(common)
    rows = rows.where(F.size(F.array_intersect("chars", "theirs")) >= _needed(F.size("chars"), F.size("theirs"), least, common))
    return rows.select("name", "member", jaro_winkler(F.col("name"), F.col("member")).alias("score")).where(F.col("score") >= least)


def best(names: DataFrame, members: DataFrame, least: float = 0.85) -> DataFrame:
    """The best member of each name that has one, to nine decimals; ties go to the member that sorts first."""
    scored = alike(names, members, least).withColumn("score", F.round("score", 9))
    return scored.groupBy("name").agg(F.min(F.struct((-F.col("score")).alias("s"), "member")).alias("b")).select("name", "b.member", (-F.col("b.s")).alias("score"))


def guessed_members(spark, sf_dir):
    """Misspelled nation and region names of customers, each with the best of all nations, regions and order clerks' kinds; nothing but the spelling joins them."""
    nations, regions = model.table(spark, sf_dir, "nation").select(F.lower("n_name").alias("member"), "n_nationkey"), model.table(spark, sf_dir, "region").select(F.lower("r_name").alias("member"))
    k, m = F.col("c_custkey"), F.col("member")
    seen = model.table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.when(k % 5 == 0, F.concat(F.substr(m, F.lit(2)), F.lit("x"))).when(k % 5 == 1, F.concat(m, (k % 100).cast("string"))).when(k % 5 == 2, F.concat(F.left(m, F.lit(2)), F.substr(m, F.lit(4)))).when(k % 5 == 3, F.reverse(m)).otherwise(F.concat(F.left(m, F.lit(3)), F.lit(" "), F.substr(m, F.lit(4))))
    return best(seen.select(name.alias("name")), nations.select("member").union(regions))
