"""Ticket effort and meaning, fuzzy identities, reachability and evaluation curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import planning, textfx
from ..functions.similarity import jaro_winkler
from ..sources import model
from ..sources.rounds import cut
from . import classify as cascade

#: Reporters by order key modulo 6, and types of ticket by order key modulo 5.
REPORTERS = ["Lucia Abbott", "release-ci", "dependabot[bot]", "Kim Lee", "Jenkins", "svc-sync"]
TYPES = ["Epic", "bug", "task", "feature", "story"]


def _pick(values: list[str], n: int):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("issue_id") % n + 1).cast("int"))


def _tickets(spark, sf_dir) -> DataFrame:
    """Issues with the number of their children (lines of the order), of comments and of transitions."""
    children = model.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("issue_id")).agg(F.count("*").alias("children"))
    rows = model.issues(spark, sf_dir).join(children, "issue_id", "left").withColumn("children", F.coalesce("children", F.lit(0)))
    k = F.col("issue_id")
    age = F.datediff(F.lit("1998-08-02").cast("date"), F.to_date("created_at"))
    return rows.select("issue_id", "team_key", "children", (k % 700).alias("words"), (k % 14).alias("comments"), (k % 17).alias("transitions"), (F.col("estimate") * 8).alias("points"), _pick(REPORTERS, 6).alias("reporter"), _pick(TYPES, 5).alias("item_type"), age.alias("age_days"))


def ticket_effort(spark, sf_dir):
    rows = _tickets(spark, sf_dir)
    late = planning.deferred(F.col("item_type"), F.col("age_days"))
    score = F.when(~late, planning.effort(*[F.col(c) for c in ("children", "words", "comments", "transitions", "points")]))
    rows = rows.withColumn("score", score)
    return rows.select("issue_id", F.when(late, "deferred_recent").otherwise("scored").alias("status"), "score", planning.effort_bucket(F.col("score")).alias("bucket"))


def effort_summary(spark, sf_dir):
    return ticket_effort(spark, sf_dir).groupBy("status", "bucket").agg(F.count("*").alias("n"))


def ticket_meaning(spark, sf_dir):
    """Tickets by team and by the reason that excludes them."""
    rows = _tickets(spark, sf_dir).withColumn("title_words", F.col("issue_id") % 9).withColumn("body_words", F.when(F.col("issue_id") % 3 == 0, 0).otherwise(F.col("words")))
    why = planning.exclusion(F.col("reporter"), F.col("issue_id") % 4 < 2, F.col("title_words"), F.col("body_words"))
    return rows.groupBy("team_key", why.alias("reason")).agg(F.count("*").alias("n"))


def fuzzy_members(spark, sf_dir, least: float = 0.85):
    """The best member of the same domain for each name seen, by Jaro-Winkler; ties go to the name that sorts first."""
    members = model.table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("domain"), F.lower("n_name").alias("member"), "n_nationkey")
    k = F.col("c_custkey")
    seen = model.table(spark, sf_dir, "customer").join(members, F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.when(k % 4 == 0, F.concat(F.substr("member", F.lit(2)), F.lit("x"))).when(k % 4 == 1, F.reverse("member")).when(k % 4 == 2, F.concat("member", F.lit("son"))).otherwise(F.concat(F.substr("member", F.lit(1), F.lit(2)), F.substr("member", F.lit(4))))
    seen = seen.select("domain", name.alias("name")).distinct()
    scored = seen.join(members.select("domain", "member"), "domain").withColumn("score", F.round(jaro_winkler(F.col("name"), F.col("member")), 9)).where(F.col("score") >= least)
    place = F.row_number().over(Window.partitionBy("domain", "name").orderBy(F.desc("score"), "member"))
    return scored.withColumn("place", place).where("place = 1").select("domain", "name", "member", "score")


def closure(edges: DataFrame, seeds: DataFrame, rounds: int = 1000) -> DataFrame:
    """(tag, id): all that a tag's seeds reach over edges (id, parent), themselves too. A round walks one step from the rows found last."""
    found = frontier = cut(seeds.select("tag", "id").distinct())
    for _ in range(rounds):
        step = frontier.join(edges, "id").select("tag", F.col("parent").alias("id")).distinct()
        frontier = cut(step.join(found, ["tag", "id"], "left_anti"))
        if frontier.isEmpty():
            return found
        found = cut(found.union(frontier))
    raise ValueError(f"not closed after {rounds} rounds")


def reachability(spark, sf_dir):
    """For each commit that a tag reaches: how many tags, and the first. A commit's parent is half its id, a merge has one before it too."""
    rows = model.commits(spark, sf_dir).select("id", "is_merge")
    edges = rows.where("id > 1").select("id", F.floor(F.col("id") / 2).alias("parent")).union(rows.where("is_merge and id > 1").select("id", F.col("id") - 1))
    reached = closure(edges, rows.where("id % 1000 = 0").select(F.col("id").alias("tag"), "id"))
    return reached.groupBy("id").agg(F.count("*").alias("tags"), F.min("tag").alias("first_tag"))


def precision_curve(spark, sf_dir):
    """Coverage and precision of the verdicts at or above each confidence."""
    rows = cascade.classify(model.commits(spark, sf_dir).where("not is_merge"))
    right = F.when((F.col("id") % 8 == 3) & (F.col("category") != "maintenance"), 0).otherwise(1)
    steps = rows.groupBy("confidence").agg(F.count("*").alias("n"), F.sum(right).alias("hits"))
    over = Window.orderBy(F.desc("confidence")).rowsBetween(Window.unboundedPreceding, 0)  # one row a confidence
    steps = steps.withColumn("n", F.sum("n").over(over)).withColumn("hits", F.sum("hits").over(over)).withColumn("total", F.max("n").over(Window.partitionBy()))
    return steps.select("confidence", "n", (F.col("n") * 100.0 / F.col("total")).alias("coverage_pct"), (F.col("hits") * 100.0 / F.col("n")).alias("precision_pct"))


def boilerplate(spark, sf_dir):
    """Commits that a pattern on the first line, or over 5,000 changed lines, tell as generated."""
    rows = model.commits(spark, sf_dir).withColumn("boilerplate", textfx.is_boilerplate(F.col("message"), F.col("insertions") + F.col("deletions")))
    return rows.groupBy("repository", "boilerplate").agg(F.count("*").alias("n"))
