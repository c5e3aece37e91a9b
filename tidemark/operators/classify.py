"""The verdicts that the reports are made of: the whole cascade of ``rule_engine``, once a distinct message; and an earlier set of rules, which re-predictions are compared with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.rounds import stored
from . import rule_engine

#: Earlier rules by priority: id, category, pattern on the lower-cased first line, confidence.
FORMER = [
    ("merge", "merge", "^merge ", 0.95), ("revert", "bugfix", "^revert", 0.90), ("fix", "bugfix", "^fix(\\(|:)", 0.90), ("feat", "feature", "^feat(\\(|:)", 0.90),
    ("docs", "documentation", "^docs(\\(|:)", 0.90), ("refactor", "refactor", "^refactor(\\(|:)", 0.90), ("test", "test", "^test(\\(|:)", 0.90), ("ci", "ci", "^ci(\\(|:)", 0.85),
    ("chore", "maintenance", "^chore(\\(|:)", 0.85), ("perf", "performance", "^perf(\\(|:)", 0.85), ("style", "style", "^style(\\(|:)", 0.85), ("any", "maintenance", ".", 0.30),
]


def _lookup(values: dict[str, str], key: Column, missing: str | None, other: Column | None = None) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key), F.lit(missing) if other is None else other)


def first_rule(line: Column, column: int) -> Column:
    out = None
    for rule in FORMER:
        out = (F if out is None else out).when(line.rlike(rule[2]), F.lit(rule[column]))
    return out


VERDICT = ("rule_id", "category", "subcategory", "confidence", "method", "top_level", "bucket", "ticket_id")


def classify(commits: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Adds the whole cascade's verdict by its built-in rules (``VERDICT``). ``overrides``: sha, work_type, each sha once. Each distinct message is classified once, as most messages recur; a null one is like an empty one."""
    session = commits.sparkSession
    cores = max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    kinds = commits.select(F.coalesce("message", F.lit("")).alias("message"), "is_merge").distinct().repartition(cores)  # all computation, so no fewer tasks than cores
    told = rule_engine.classify(kinds.withColumn("sha", F.lit(None).cast("string")))
    told = stored(told.select(F.col("message").alias("_message"), F.col("is_merge").alias("_is_merge"), *VERDICT))  # worked out once, however often a query asks for its columns
    rows = commits.withColumn("_text", F.coalesce("message", F.lit("")))
    rows = rows.join(told, (F.col("_text") == F.col("_message")) & F.col("is_merge").eqNullSafe(F.col("_is_merge"))).drop("_text", "_message", "_is_merge")
    if overrides is None:
        return rows
    rows = rows.join(overrides.select("sha", "work_type"), "sha", "left")
    low, given = F.lower("work_type"), F.col("work_type").isNotNull()
    manual = {
        "rule_id": F.lit("manual_override"), "category": F.col("work_type"), "subcategory": F.lit(None).cast("string"), "confidence": F.lit(1.0), "method": F.lit("manual"), "ticket_id": F.col("ticket_id"),
        "top_level": _lookup(rule_engine.TOP_LEVEL, low, "unknown"), "bucket": _lookup(rule_engine.BUCKET, _lookup(rule_engine.ALIASES, low, None, low), rule_engine.NO_BUCKET),
    }
    return rows.select(*[F.col(f"`{c}`") for c in commits.columns], *[F.when(given, manual[c]).otherwise(F.col(c)).alias(c) for c in VERDICT])


def former(commits: DataFrame) -> DataFrame:
    """Adds the category by an earlier set of rules, FORMER: what a re-prediction starts from."""
    line = F.lower(F.split_part("message", F.lit("\n"), F.lit(1)))
    return commits.withColumn("category", F.coalesce(first_rule(line, 1), F.lit("uncategorized")))


def _sql_rules(column: int, missing: str) -> str:
    quote = lambda v: f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)"
    return "CASE " + " ".join(f"WHEN regexp_matches(line, '{r[2]}') THEN {quote(r[column])}" for r in FORMER) + f" ELSE {missing} END"


FORMER_SQL = f"""former AS (SELECT *, {_sql_rules(1, "'uncategorized'")} AS category FROM (SELECT *, lower(split_part(message, chr(10), 1)) AS line FROM commits))"""
