"""Delivery metrics over deployments, incidents and the commits around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timefx import calendar_week, seconds
from ..sources import model


def deploy_frequency(spark, sf_dir):
    rows = model.deployments(spark, sf_dir).where("status = 'success'")
    return rows.groupBy("repo", calendar_week("triggered_at").alias("week_label")).agg(F.count("*").alias("deployments"))


def lead_times(spark, sf_dir):
    """Hours from commit to deployment; negative ones are dropped."""
    return _leads(spark, sf_dir).select("deploy_id", "repo", (F.col("s") / 3600.0).alias("lead_hours"))


def _leads(spark, sf_dir):
    rows = model.deployments(spark, sf_dir).where("status = 'success'").join(model.commits(spark, sf_dir).select("sha", "ts"), F.col("git_sha") == F.col("sha"))
    return rows.withColumn("s", seconds("ts", "triggered_at")).where("s >= 0")


def deployment_failures(spark, sf_dir, hours: int = 24) -> DataFrame:
    """Deployments whose earliest non-merge commit in (t, t + hours] is a hotfix. The earliest is taken first and tested then."""
    return first_after(model.deployments(spark, sf_dir), model.activity(spark, sf_dir).where("not is_merge"), hours).where(F.col("message").startswith("hotfix")).select("deploy_id", "repo", F.col("id").alias("commit_id"))


def first_after(deployments: DataFrame, commits: DataFrame, hours: int) -> DataFrame:
    """The earliest commit (ties to the smaller id) in (t, t + hours] of each deployment that has one: deploy_id, repo, id, message.

    Time is cut into spells of that length; a commit stands in its own and the one before, so a deployment finds it in its own spell by
    one window over (repository, spell): no pairs are made, and a busy repository is many groups."""
    spell = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / (3600 * hours))
    c = commits.select(F.col("repository").alias("repo"), F.col("ts").alias("at"), F.struct("ts", "id", "message").alias("commit"), F.lit(None).cast("long").alias("deploy_id"), F.explode(F.array(spell("ts"), spell("ts") - 1)).alias("spell"), F.lit(0).alias("kind"), "id")
    d = deployments.select("repo", F.col("triggered_at").alias("at"), F.lit(None).cast(c.schema["commit"].dataType).alias("commit"), F.col("deploy_id").cast("long").alias("deploy_id"), spell("triggered_at").alias("spell"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("id"))
    later = Window.partitionBy("repo", "spell").orderBy(F.desc("at"), F.desc("kind"), F.desc("id")).rowsBetween(Window.unboundedPreceding, -1)
    rows = c.unionByName(d).withColumn("first", F.last("commit", ignorenulls=True).over(later)).where("kind = 1")
    return rows.where(F.col("first.ts") <= F.col("at") + F.make_dt_interval(F.lit(0), F.lit(hours))).select("deploy_id", "repo", "first.id", "first.message")


def change_failure_rate(spark, sf_dir):
    rows = model.deployments(spark, sf_dir).join(deployment_failures(spark, sf_dir).select("deploy_id", F.lit(1).alias("failed")), "deploy_id", "left")
    n, bad = F.count("*"), F.sum(F.coalesce("failed", F.lit(0))).cast("long")
    return rows.groupBy(calendar_week("triggered_at").alias("week_label")).agg(n.alias("deployments"), bad.alias("failures"), (bad * 100.0 / n).alias("cfr_pct"))


def recovery_time(spark, sf_dir):
    rows = model.incidents(spark, sf_dir).where("resolved_at is not null").withColumn("s", seconds("detected_at", "resolved_at"))
    return rows.groupBy("repo").agg(F.count("*").alias("incidents"), (F.sum("s") / F.count("*") / 3600.0).alias("mttr_hours"))


def delivery_summary(spark, sf_dir):
    """Per repository: deployments a week, mean lead time, failure rate, recovery time and level. A missing lead time counts as endless, a missing recovery time as 0."""
    d = model.deployments(spark, sf_dir)
    freq = d.groupBy("repo").agg(F.count("*").alias("deployments"), F.countDistinct(calendar_week("triggered_at")).alias("weeks"))
    lead = _leads(spark, sf_dir).groupBy("repo").agg(F.count("*").alias("leads"), (F.sum("s") / F.count("*") / 3600.0).alias("lead_hours"))
    bad = deployment_failures(spark, sf_dir).groupBy("repo").agg(F.count("*").alias("failures"))
    out = freq.join(lead, "repo", "left").join(bad, "repo", "left").join(recovery_time(spark, sf_dir), "repo", "left")
    per_week = F.col("deployments") / F.col("weeks")
    rate = F.coalesce("failures", F.lit(0)) * 100.0 / F.col("deployments")
    grade = level(per_week, F.coalesce("lead_hours", F.lit(float("inf"))), rate / 100, F.coalesce("mttr_hours", F.lit(0.0)))
    return out.select("repo", "deployments", per_week.alias("per_week"), F.coalesce("leads", F.lit(0)).alias("leads"), "lead_hours", rate.alias("cfr_pct"), "mttr_hours", grade.alias("level"))


#: Level, deployments a week at least, lead hours below, failure rate below, recovery hours below.
LEVELS = [("elite", 1.0, 1.0, 0.15, 1.0), ("high", 0.25, 168.0, 0.30, 24.0), ("medium", 0.04, 720.0, 0.30, 168.0)]


def level(per_week: Column, lead_hours: Column, rate: Column, recovery_hours: Column) -> Column:
    """The first level whose four bounds all hold, else low."""
    out = F
    for name, often, lead, bad, heal in LEVELS:
        out = out.when((per_week >= often) & (lead_hours < lead) & (rate < bad) & (recovery_hours < heal), name)
    return out.otherwise("low")


def bugfix_gap(spark, sf_dir):
    """Mean hours between consecutive hotfixes of a repository: the span over the gaps, 0 with fewer than two."""
    rows = model.activity(spark, sf_dir).where("message like 'hotfix%'").groupBy("repository").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return rows.select("repository", "n", F.when(F.col("n") < 2, F.lit(0.0)).otherwise(seconds("a", "b") / (F.col("n") - 1) / 3600.0).alias("gap_hours"))


def latest_events(spark, sf_dir):
    """Idempotent upsert: the last event of each user and type wins, ties to the larger id."""
    rows = model.table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    place = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id")))
    return rows.withColumn("place", place).where("place = 1").select("user_id", "event_type", "event_id", "value")
