"""Signals of issue trackers for commits: what an issue's type, labels and components say about the commits that name it.

Trackers are tables of issues and tables of mappings, so no request is made. An issue's type goes before its labels, and those before its components, each in
order; the first one mapped decides. A commit's message names issues by key (``ABC-12``, source ``keys``) or number (``owner/name#3``, ``#3`` of its own
repository, source ``numbers``); sources are asked in order, and in a source the first named issue that has a signal answers.

Null messages name nothing. An issue listed twice keeps its first signal in the order of its fields; unmapped issues have none. Each message is searched once,
however many commits share it, and issues meet references in a join by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import model
from . import rule_engine

CONFIDENCE = 0.92
SOURCES = ("keys", "numbers")
FIELDS = ("issue_type", "label", "component")


def resolved(issues: DataFrame, mappings: DataFrame) -> DataFrame:
    """(source, key, category, confidence, note) of issues (source, key, issue_type, labels, components) by mappings (source, field, value, category, confidence: null for the usual one)."""
    listed = F.concat(_values(F.array("issue_type"), "issue_type"), _values(F.col("labels"), "label"), _values(F.col("components"), "component"))
    said = issues.where("source is not null and key is not null").select("source", "key", F.posexplode(listed).alias("place", "said"))
    number = F.array_position(F.array(*map(F.lit, FIELDS)), F.col("field")) - 1
    known = mappings.select("source", number.cast("int").alias("field"), "value", "category", F.coalesce("confidence", F.lit(CONFIDENCE)).alias("confidence"))
    hit = said.select("source", "key", "place", "said.field", "said.value").join(known, ["source", "field", "value"])
    note = F.concat_ws(":", "source", F.get(F.array(*map(F.lit, FIELDS)), F.col("field")), "value")
    best = hit.groupBy("source", "key").agg(F.min(F.struct("field", "place", "value", "category", "confidence", note.alias("note"))).alias("b"))
    return best.select("source", "key", "b.category", "b.confidence", "b.note")


def _values(column, field: str):
    return F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda v: F.struct(F.lit(FIELDS.index(field)).alias("field"), v.alias("value")))


def references(messages: DataFrame) -> DataFrame:
    """(message, repository, source, place, key) of distinct (message, repository): named issues, first mention first."""
    text = F.col("message")
    keys = F.filter(F.regexp_extract_all(text, F.lit(r"\b([A-Z][A-Z0-9]{0,9}-[0-9]+)"), F.lit(1)), lambda k: F.length(F.substring_index(k, "-", -1)) <= 7)
    whole = F.regexp_extract_all(text, F.lit(r"(?:^|\s)([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+#[0-9]+)\b"), F.lit(1))
    bare = F.transform(F.regexp_extract_all(text, F.lit(r"(?:^|[\s(])#([0-9]+)\b"), F.lit(1)), lambda n: F.concat(F.col("repository"), F.lit("#"), n))
    numbers = F.transform(F.filter(F.concat(whole, bare), lambda k: k.isNotNull() & ~k.rlike("#0+$")), lambda k: F.regexp_replace(k, "#0+", "#"))
    found = messages.where(text.isNotNull()).select("message", "repository").distinct()
    of = lambda source, ks: found.select("message", "repository", F.lit(source).alias("source"), F.posexplode(F.array_distinct(ks)).alias("place", "key"))
    return of("keys", keys).unionByName(of("numbers", numbers))


def signals(commits: DataFrame, known: DataFrame, order: tuple[str, ...] = SOURCES, bound: DataFrame | None = None) -> DataFrame:
    """(sha, signal, signal_confidence, signal_note) of commits (sha, message, repository) that have one. ``known``: resolved signals; ``bound``: (repository, source), repositories that ask one source only."""
    asked = references(commits)
    if bound is not None:
        asked = asked.join(bound.select("repository", F.col("source").alias("only")), "repository", "left").where("only is null or only = source").drop("only")
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("source"))
    hit = asked.join(known, ["source", "key"]).where(rank > 0)
    best = hit.groupBy("message", "repository").agg(F.min_by(F.struct("category", "confidence", "note"), F.struct(rank, "place")).alias("s"))
    best = best.select("message", F.col("repository").alias("_repository"), "s.category", "s.confidence", "s.note")
    return commits.join(best, (commits["message"] == best["message"]) & F.col("repository").eqNullSafe(F.col("_repository"))).select("sha", F.col("category").alias("signal"), F.col("confidence").alias("signal_confidence"), F.col("note").alias("signal_note"))


def tracker_issues(spark, sf_dir) -> DataFrame:
    """The model's issues as tracker exports: numbered ones with the tags of their titles as labels, and keyed ones of the nations by region."""
    k = F.col("issue_id")
    tags = F.regexp_extract_all("title", F.lit(r"\[([^\]]+)\]"), F.lit(1))
    numbered = model.issues(spark, sf_dir).select(F.lit("numbers").alias("source"), F.concat(F.lit("repo"), (k % 25).cast("string"), F.lit("#"), k.cast("string")).alias("key"), F.lit(None).cast("string").alias("issue_type"), tags.alias("labels"), F.array(F.col("state_type")).alias("components"))
    nations = model.table(spark, sf_dir, "nation").join(model.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    keyed = nations.select(F.lit("keys").alias("source"), F.concat(F.lit("PROJ-"), F.col("n_nationkey").cast("string")).alias("key"), F.col("r_name").alias("issue_type"), F.array("n_name").alias("labels"), F.array().cast("array<string>").alias("components"))
    return numbered.unionByName(keyed)


#: What the model's labels, components and types mean.
MAPPED = [("numbers", "label", "bug", "bugfix", None), ("numbers", "label", "api", "integration", 0.85), ("numbers", "component", "canceled", "chore", None), ("keys", "label", "INDIA", "feature", None), ("keys", "issue_type", "MIDDLE EAST", "security", None), ("keys", "issue_type", "ASIA", "documentation", 0.8)]


def signalled_commits(spark, sf_dir):
    """The cascade over all commits with the trackers' signals: above words and patterns, below overrides by hand (every nineteenth commit)."""
    rows = model.commits(spark, sf_dir).select("id", "sha", "message", "is_merge", "repository")
    known = resolved(tracker_issues(spark, sf_dir), spark.createDataFrame(MAPPED, "source string, field string, value string, category string, confidence double"))
    overrides = rows.where("id % 19 = 0").select("sha", F.lit("platform").alias("work_type"))
    done = rule_engine.classify(rows.drop("repository"), overrides=overrides, signals=signals(rows, known))
    return done.select("sha", "rule_id", "category", "confidence", "method", "top_level")
