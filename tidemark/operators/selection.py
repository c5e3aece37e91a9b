"""Selections and summaries over any commits, pull requests and deployments: people, spans of time, averages, delivery totals."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring, textfx
from ..functions.timefx import calendar_week, iso_week, seconds
from ..sources import model
from . import classify as cascade
from . import delivery

#: Parts of names and addresses of machine authors.
BOTS = ["[bot]", "dependabot", "renovate", "github-actions", "gitlab-ci", "greenkeeper"]

#: Weeks of each period.
GRAINS = {"quarterly": 13, "monthly": 4, "weekly": 1}


def is_machine(name: Column, email: Column) -> Column:
    """Whether a name or an address holds a mark of a machine author; null is like empty."""
    found = F.lit(False)
    for value in (name, email):
        low = F.lower(F.coalesce(value, F.lit("")))
        for mark in BOTS:
            found = found | low.contains(mark)
    return found


def identity(canonical: Column, email: Column) -> Column:
    """The canonical address, or the commit's own where there is none or an empty one."""
    return F.coalesce(F.nullif(canonical, F.lit("")), email)


def of_person(commits: DataFrame, email: str) -> DataFrame:
    """Commits (canonical_email, author_email, ...) of one address in any case."""
    return commits.where(F.lower(identity(F.col("canonical_email"), F.col("author_email"))) == email.lower())


def between(rows: DataFrame, column: str, since=None, until=None) -> DataFrame:
    """Rows from ``since`` to ``until``, both inclusive and both optional."""
    if since is not None:
        rows = rows.where(F.col(column) >= F.lit(since))
    if until is not None:
        rows = rows.where(F.col(column) <= F.lit(until))
    return rows


def to_end_of_day(rows: DataFrame, column: str, until: str) -> DataFrame:
    """Rows whose text time is at most 23:59:59 of a day, compared as text; later parts of that second sort before Z and stay."""
    return rows.where(F.col(column) <= F.concat(F.lit(until), F.lit("T23:59:59Z")))


def date_range(now: datetime.datetime, weeks: int | None = None, since: str | None = None, until: str | None = None, configured: str | None = None) -> tuple[str | None, str | None]:
    """Bounds as text: weeks back from now win over days, days over the configured start; the last day counts to its end."""
    if weeks is not None:
        return (now - datetime.timedelta(weeks=weeks)).isoformat(), None
    day = datetime.date.fromisoformat
    start = f"{day(since)}T00:00:00+00:00" if since is not None else configured
    return start, None if until is None else f"{day(until)}T23:59:59+00:00"


def weeks_of(grain: str, custom: int | None = None) -> int:
    """Weeks of a period: quarterly 13, monthly 4, weekly 1, custom at least 1."""
    return max(1, custom or 1) if grain == "custom" else GRAINS[grain]


def by_alias(authors: DataFrame, query: str) -> DataFrame:
    """Authors (aliases as JSON text) that hold the query anywhere in that text, letters in any case; % and _ stand for themselves."""
    return authors.where(F.contains(F.lower("aliases"), F.lit(query.lower())))


def size_number(size: Column) -> Column:
    """XS to XL as 1 to 5, anything else 0."""
    return F.when(size == "XS", 1).when(size == "S", 2).when(size == "M", 3).when(size == "L", 4).when(size == "XL", 5).otherwise(0)


def truncated(text: Column, budget: int) -> Column:
    """The first ``budget`` characters and a mark of how many are gone; a text within the budget stays as it is."""
    gone = F.char_length(text) - budget
    return F.when(gone > 0, F.concat(F.left(text, F.lit(budget)), F.lit("\n[truncated "), gone.cast("string"), F.lit(" characters]"))).otherwise(text)


def evidence(hits: DataFrame, share: float = 0.5) -> DataFrame:
    """Hits (query, score, ...) with at least half of their query's best finite score; no floor where that isn't above 0. Scores not finite go.

    The best score is a partial aggregate joined back, so a query with very many hits is no single task."""
    finite = hits.where(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf")))
    best = finite.groupBy(F.col("query").alias("_query")).agg(F.max("score").alias("_best"))
    floor = F.when(F.col("_best") > 0, F.col("_best") * share).otherwise(F.lit(float("-inf")))
    return finite.join(best, F.col("query").eqNullSafe(F.col("_query"))).where(F.col("score") >= floor).select(*[F.col(f"`{c}`") for c in hits.columns])


def score_bands(rows: DataFrame, score: str, size: str, least: int = 5) -> DataFrame:
    """Adds band 1 to 5 by nearest-rank 20, 40, 60 and 80 percent marks (strictly below a mark); below ``least`` rows the size's number."""
    marks = rows.agg(F.count("*").alias("_n"), *[F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY `{score}`)").alias(f"_p{p}") for p in (20, 40, 60, 80)])  # one row
    s = F.col(f"`{score}`")
    band = F.when(s < F.col("_p20"), 1).when(s < F.col("_p40"), 2).when(s < F.col("_p60"), 3).when(s < F.col("_p80"), 4).otherwise(5)
    return rows.crossJoin(F.broadcast(marks)).select(*[F.col(f"`{c}`") for c in rows.columns], F.when(F.col("_n") < least, size_number(F.col(f"`{size}`"))).otherwise(band).alias("band"))


def person_commits(spark, sf_dir, email: str = "DEV7@example.com"):
    """Commits of one person by category, merges left out; every sixth commit has an empty canonical address, every seventh another one."""
    k = F.col("id")
    canonical = F.when(k % 7 == 0, F.concat(F.lit("Dev"), (k % 97).cast("string"), F.lit("@Example.com"))).when(k % 6 == 0, "")
    rows = cascade.classify(model.commits(spark, sf_dir).where("not is_merge")).withColumn("canonical_email", canonical)
    return of_person(rows, email).groupBy("category").agg(F.count("*").alias("n"))


def author_categories(spark, sf_dir):
    """Categories of each author who isn't a machine."""
    rows = cascade.classify(model.commits(spark, sf_dir).where("not is_merge")).withColumn("name", F.when(F.col("author_id") % 41 == 0, F.concat("author_name", F.lit(" [Bot]"))).otherwise(F.col("author_name")))
    return rows.where(~is_machine(F.col("name"), F.col("author_email"))).groupBy("author_email", "category").agg(F.count("*").alias("n"))


def span_commits(spark, sf_dir, since: str = "1995-03-01", until: str = "1996-06-30"):
    """Commits by repository from a day to the end of another, times compared as text."""
    rows = model.commits(spark, sf_dir).withColumn("stamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return to_end_of_day(between(rows, "stamp", since), "stamp", until).groupBy("repository").agg(F.count("*").alias("n"), F.min("stamp").alias("first_at"), F.max("stamp").alias("last_at"))


def average_quality(spark, sf_dir, first: tuple[int, int] = (1995, 10), last: tuple[int, int] = (1996, 20)):
    """Mean weekly score of each author from one (year, week) to another, both inclusive."""
    rows = cascade.classify(model.commits(spark, sf_dir).where("not is_merge")).groupBy("author_email", iso_week("ts").alias("week_label")).agg(
        F.count("*").alias("n"), F.count_if(textfx.is_revert(F.col("message"))).alias("r"), F.count_if(F.col("category") == "bugfix").alias("b"), F.count_if(F.col("ticketed")).alias("t")
    )
    at = F.split_part("week_label", F.lit("-W"), F.lit(1)).cast("int") * 100 + F.split_part("week_label", F.lit("-W"), F.lit(2)).cast("int")
    rows = rows.where(at.between(first[0] * 100 + first[1], last[0] * 100 + last[1]))
    return rows.groupBy("author_email").agg(F.count("*").alias("weeks"), F.round(F.avg(scoring.weekly_quality(F.col("n"), F.col("r"), F.col("b"), F.col("t"))), 9).alias("score"))


def unresolved(spark, sf_dir):
    """Commits without a known author and without being merges; every 29th customer is unknown."""
    rows = model.commits(spark, sf_dir).where("not is_merge").withColumn("author", F.when(F.col("author_id") % 29 != 0, F.col("author_id")))
    return rows.groupBy("repository").agg(F.count("*").alias("n"), F.count_if(F.col("author").isNull()).alias("unresolved"))


def effort_quintiles(spark, sf_dir):
    """Commits by quintile of their effort score, beside the least and greatest score's size number."""
    from .report import _efforts

    rows = _efforts(spark, sf_dir).withColumn("score", F.round("score", 9)).withColumn("size", scoring.effort_size(F.col("score")))
    return score_bands(rows, "score", "size").groupBy("band").agg(F.count("*").alias("n"), F.min(size_number(F.col("size"))).alias("least"), F.max(size_number(F.col("size"))).alias("most"))


def newest_untracked(spark, sf_dir, rows: int = 50):
    """The newest commits without a ticket: time as text, newest first, ties by sha."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return model.commits(spark, sf_dir).where("not ticketed").select("sha", stamp.alias("stamp"), truncated(textfx.first_line(F.col("message")), 20).alias("subject")).orderBy(F.desc("stamp"), "sha").limit(rows)


def evidence_kept(spark, sf_dir):
    """Events as hits of their type: how many clear half of the type's best value."""
    hits = model.table(spark, sf_dir, "events").select(F.col("event_type").alias("query"), F.col("value").alias("score"), "event_id")
    return evidence(hits).groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("least"))


def _mean_hours(s: Column) -> Column:
    """Mean of whole seconds, in hours; null of none."""
    return F.try_divide(F.sum(s), F.count(s)) / 3600.0


def delivery_totals(spark, sf_dir, since: str | None = "2024-01-10"):
    """One row: successful deployments, weeks that have some, deployments a week, mean lead time, failure rate, mean recovery time.

    ``since`` narrows frequency and failure rate only, not the lead and recovery times."""
    found = between(model.deployments(spark, sf_dir), "triggered_at", since)
    failed = delivery.deployment_failures(spark, sf_dir).select("deploy_id", F.lit(1).alias("failed"))
    good = F.col("status") == "success"
    week = F.when(good, calendar_week("triggered_at"))
    totals = found.join(failed, "deploy_id", "left").agg(F.count_if(good).alias("deployments"), F.countDistinct(week).alias("weeks"), F.count("*").alias("_n"), F.count("failed").alias("_bad"))
    lead = delivery._leads(spark, sf_dir).agg(_mean_hours(F.col("s")).alias("lead_hours"))
    recovery = model.incidents(spark, sf_dir).agg(_mean_hours(seconds("detected_at", "resolved_at")).alias("mttr_hours"))
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    one = totals.crossJoin(F.broadcast(lead)).crossJoin(F.broadcast(recovery))  # single rows
    return one.select("deployments", "weeks", rate("deployments", "weeks").alias("per_week"), "lead_hours", rate("_bad", "_n").alias("failure_rate"), "mttr_hours")


def delivery_sources(deployments: DataFrame, commits: DataFrame, pull_requests: DataFrame, start, end, weeks: int) -> DataFrame:
    """One row: frequency and lead time of a period with where each comes from.

    Frequency is that of the period's deployments, or without any that of merged pull requests (merge_proxy). Lead time is the mean from
    commit to deployment, negative ones dropped (measured), else the mean cycle of 0.5 to 720 hours (proxy), else null (unmeasurable)."""
    in_period = between(deployments, "triggered_at", start, end)
    lead = seconds("_ts", "triggered_at")
    by_sha = commits.groupBy("sha").agg(F.min("ts").alias("_ts"))
    d = in_period.join(by_sha, in_period["git_sha"] == by_sha["sha"], "left").agg(F.count("*").alias("d"), _mean_hours(F.when(lead >= 0, lead)).alias("measured"))
    cycle = seconds("created_at", "merged_at")
    p = pull_requests.agg(F.count("merged_at").alias("p"), _mean_hours(F.when((cycle / 3600.0).between(0.5, 720), cycle)).alias("proxy"))
    used = F.when(F.col("d") > 0, F.col("measured"))  # without deployments nothing is measured
    source = F.when(used.isNotNull(), "measured").when(F.col("proxy").isNotNull(), "proxy").otherwise("unmeasurable")
    frequency = F.when(F.col("d") > 0, F.col("d")).otherwise(F.col("p")) / max(weeks, 1)
    where = F.when(F.col("d") > 0, "deployments").otherwise("merge_proxy")
    return d.crossJoin(F.broadcast(p)).select(frequency.alias("per_week"), where.alias("frequency_source"), F.coalesce(used, "proxy").alias("lead_hours"), source.alias("lead_source"))  # two single rows


def delivery_origin(spark, sf_dir):
    """Frequency and lead time of a period that has deployments and of one that has none."""
    facts = model.deployments(spark, sf_dir), model.commits(spark, sf_dir), model.pull_requests(spark, sf_dir)
    out = None
    for name, year in (("with", 2024), ("without", 1990)):
        row = delivery_sources(*facts, f"{year}-01-01", f"{year}-12-31", 52).withColumn("period", F.lit(name))
        out = row if out is None else out.union(row)
    return out


def failure_proxy(spark, sf_dir):
    """Failure rate of each repository from commits alone: the greater of bugfixes and reverts over commits."""
    rows = cascade.classify(model.commits(spark, sf_dir).where("not is_merge"))
    fixes, reverts = F.count_if(F.col("category") == "bugfix"), F.count_if(textfx.is_revert(F.col("message")))
    return rows.groupBy("repository").agg(F.count("*").alias("commits"), F.coalesce(F.try_divide(F.greatest(fixes, reverts), F.count("*")), F.lit(0.0)).alias("rate"))


def period_summary(commits: DataFrame, shas: DataFrame, deployments: DataFrame, pull_requests: DataFrame, start, end) -> DataFrame:
    """One row for a period over all repositories: frequency and lead time with their sources, failure rate, recovery hours and level.

    ``commits``: ts, message, category, is_merge; ``shas``: sha, ts of all commits, merges too. Weeks are those with commits. The failure rate is the greater of bugfixes and reverts over
    commits; recovery the mean gap between one commit that is a bugfix or a revert and the next, 0 with fewer than two. A period without commits has no failures and one week. A missing lead time counts as endless."""
    fix, back = F.coalesce(F.col("category") == "bugfix", F.lit(False)), F.coalesce(textfx.is_revert(F.col("message")), F.lit(False))
    at = F.when(fix | back, F.col("ts"))
    n = between(commits, "ts", start, end).where("not is_merge").agg(
        F.count("*").alias("n"), F.countDistinct(iso_week("ts")).alias("weeks"), F.greatest(F.count_if(fix), F.count_if(back)).alias("bad"), F.count(at).alias("m"), seconds(F.min(at), F.max(at)).alias("span")
    )
    weeks = n.first().weeks  # one number
    rate = F.coalesce(F.try_divide("bad", "n"), F.lit(0.0))
    gap = F.when(F.col("m") < 2, F.lit(0.0)).otherwise(F.col("span") / (F.col("m") - 1) / 3600.0)
    both = delivery_sources(deployments, shas, pull_requests, start, end, weeks).crossJoin(F.broadcast(n.select(rate.alias("failure_rate"), gap.alias("mttr_hours"))))  # two single rows
    grade = delivery.level(F.col("per_week"), F.coalesce("lead_hours", F.lit(float("inf"))), F.col("failure_rate"), F.col("mttr_hours"))
    return both.withColumn("level", grade)


def delivery_period(spark, sf_dir):
    """The summary of the year that has deployments, and of one that has none."""
    rows = cascade.classify(model.activity(spark, sf_dir))
    shas, deployments, pulls = model.commits(spark, sf_dir), model.deployments(spark, sf_dir), model.pull_requests(spark, sf_dir)
    out = [period_summary(rows, shas, deployments, pulls, f"{year}-01-01", f"{year}-12-31").withColumn("period", F.lit(name)) for name, year in (("with", 2024), ("without", 1990))]
    return out[0].union(out[1])
