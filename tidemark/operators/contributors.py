"""Finding contributors by what a user types: address, name, or a part of an alias."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import linking
from ..sources import model
from ..sources.rounds import cut
from . import near_names


def _grams(text: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.char_length(text) - n + 1), lambda i: F.substr(text, i, F.lit(n)))


def grams(text: Column) -> Column:
    """Distinct runs of one, two and three characters; null text has none."""
    runs = F.lit(None).cast("array<string>")
    for n in (3, 2, 1):
        more = F.when(F.char_length(text) >= n, _grams(text, n))
        runs = F.when(runs.isNull(), more).when(more.isNull(), runs).otherwise(F.concat(runs, more))
    return F.array_distinct(runs)


def alias_hits(queries: DataFrame, authors: DataFrame) -> DataFrame:
    """(query, id): authors (id, aliases as JSON text) whose alias text holds the query, letters in any case; % and _ stand for themselves.

    A text that holds the query holds all its runs of three characters, so a query meets authors on its rarest run only (the whole query,
    if shorter), never all authors; the text is tested then. Each author's text travels once, with the hits. An empty query finds none."""
    low = authors.select("id", F.lower("aliases").alias("text"))
    runs = low.select("id", F.explode(grams(F.col("text"))).alias("run"))
    asked = queries.select("query", F.lower("query").alias("low")).distinct().where("low <> ''")
    own = asked.select("query", "low", F.explode(_grams(F.col("low"), F.least(F.char_length("low"), F.lit(3)))).alias("run")).distinct()
    counts = runs.join(own.select("run").distinct(), "run").groupBy("run").agg(F.count("*").alias("n"))
    rarest = own.join(counts, "run", "left").groupBy("query", "low").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run"))["run"].alias("run"))
    return rarest.join(runs, "run").join(low, "id").where(F.contains("text", F.col("low"))).select("query", "id")


def fuzzy_allowed(aliases: DataFrame, configured: bool | None = None) -> bool:
    """Whether names may be guessed: as configured, else only without an alias table, as whoever isn't in a loaded one is nobody of it. An empty table is none."""
    return aliases.isEmpty() if configured is None else configured


def _guesses(asked: DataFrame, authors: DataFrame):
    """Hits by spelling: names alike by 0.85, else, dots, hyphens and underscores taken as blanks, by 0.82; ties go to the name that sorts first, then the smallest id."""
    for place, spelled, least in ((4, F.lower, 0.85), (5, linking.normalised, 0.82)):
        known = authors.where("canonical_name is not null").groupBy(spelled("canonical_name").alias("member")).agg(F.min("id").alias("id"))
        mine = asked.where("query is not null").select("query", spelled("query").alias("name"))
        guessed = near_names.best(mine.select("name"), known.select("member"), least).join(known, "member")
        hits = cut(mine.join(guessed, "name").select("query", F.struct(F.lit(place).alias("place"), "id", F.lit("fuzzy" if place == 4 else "normalised").alias("how")).alias("hit")))
        yield hits
        asked = asked.join(hits, "query", "left_anti")


def find(queries: DataFrame, authors: DataFrame, fuzzy: bool = False) -> DataFrame:
    """query, id, how of distinct queries: authors (id, canonical_email, canonical_name, aliases) by address, else name, else part of an alias, else with ``fuzzy`` by spelling.

    Letters count in any case; of several authors the one with the smallest id. Without any, id is null and how is none."""
    asked = queries.select("query").distinct()
    low = asked.select("query", F.lower("query").alias("low"))
    found = None
    for place, column, how in ((1, "canonical_email", "email"), (2, "canonical_name", "name")):
        first = authors.groupBy(F.lower(column).alias("low")).agg(F.min("id").alias("id"))
        hit = low.join(first, "low").select("query", F.struct(F.lit(place).alias("place"), "id", F.lit(how).alias("how")).alias("hit"))
        found = hit if found is None else found.union(hit)
    rest = asked.join(found, "query", "left_anti")
    parts = alias_hits(rest, authors).groupBy("query").agg(F.min("id").alias("id"))
    found = found.union(parts.select("query", F.struct(F.lit(3).alias("place"), "id", F.lit("alias").alias("how")).alias("hit")))
    if fuzzy:
        for hits in _guesses(rest.join(parts, "query", "left_anti"), authors):
            found = found.union(hits)
    best = found.groupBy("query").agg(F.min("hit").alias("hit")).withColumnRenamed("query", "_query")
    return asked.join(best, F.col("query").eqNullSafe(F.col("_query")), "left").select("query", "hit.id", F.coalesce("hit.how", F.lit("none")).alias("how"))


def contributor_queries(spark, sf_dir):
    """Suppliers as authors, asked for by nations' names and by parts of addresses, names and logins."""
    k = F.col("s_suppkey")
    login = F.concat(F.lit("Log_"), (k * 7 % 60).cast("string"), F.lit("%x"))
    authors = model.table(spark, sf_dir, "supplier").select(
        k.alias("id"), F.concat(F.lit("Dev"), k.cast("string"), F.lit("@example.com")).alias("canonical_email"), F.concat(F.lit("Dev "), (k % 12).cast("string")).alias("canonical_name"), F.concat(F.lit('["'), login, F.lit('"]')).alias("aliases")
    )
    n = F.col("c_custkey")
    typed = F.when(n % 4 == 0, F.concat(F.lit("dev"), n.cast("string"), F.lit("@EXAMPLE.com"))).when(n % 4 == 1, F.concat(F.lit("DEV "), (n % 24).cast("string"))).when(n % 4 == 2, F.concat(F.lit("log_"), (n % 90).cast("string"))).otherwise(F.concat((n % 70).cast("string"), F.lit("%")))
    return find(model.table(spark, sf_dir, "customer").select(typed.alias("query")), authors)
