"""Activity reports: authors, repositories, weeks, coverage, quality, effort, ownership."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring, textfx
from ..functions.timefx import iso_week
from ..sources import model
from . import classify as cascade


#: Factors of the activity score and their weights.
ACTIVITY_WEIGHTS = [("commits", 0.22), ("prs", 0.26), ("lines", 0.26), ("files_per_commit", 0.11), ("categorised", 0.15)]


def _classified(spark, sf_dir, merges: bool = False) -> DataFrame:
    rows = model.commits(spark, sf_dir)
    return cascade.classify(rows if merges else rows.where("not is_merge")).withColumn("week_label", iso_week("ts"))


def _n(condition, name):
    return F.sum(F.when(condition, 1).otherwise(0)).alias(name)


def author_summary(spark, sf_dir):
    """Longest name of each address (of several, the one seen first, then the first by spelling), totals and the span of activity."""
    rows = model.commits(spark, sf_dir).where("not is_merge")
    name = F.min_by("author_name", F.struct(F.col("author_name").isNull(), -F.octet_length("author_name"), "ts", "author_name")).alias("name")
    return rows.groupBy("author_email").agg(name, F.count("*").alias("commits"), F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"), F.sum("files_changed").alias("files"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


def repository_summary(spark, sf_dir):
    return model.commits(spark, sf_dir).where("not is_merge").groupBy("repository").agg(F.count("*").alias("commits"), F.countDistinct("author_email").alias("authors"), F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"))


def repository_top_categories(spark, sf_dir):
    counts = _classified(spark, sf_dir).groupBy("repository", "category").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("repository").orderBy(F.desc("n"), "category"))
    return counts.withColumn("place", rank).where("place <= 5")


def weekly_activity(spark, sf_dir):
    rows = _classified(spark, sf_dir)
    return rows.groupBy("week_label", "author_email", "repository").agg(
        F.count("*").alias("commits"), F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"), F.sum("files_changed").alias("files"), _n(F.col("ticketed"), "ticketed"),
        _n(F.col("is_ai_assisted"), "ai_assisted"), _n(textfx.is_revert(F.col("message")), "reverts"), _n(F.col("category") == "bugfix", "bugfixes"), _n(F.col("category") == "feature", "features"),
    )


def category_totals(spark, sf_dir):
    return _classified(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"))


def week_totals(spark, sf_dir):
    return _classified(spark, sf_dir).groupBy("week_label").agg(F.count("*").alias("commits"), F.countDistinct("author_email").alias("developers"))


def weekly_metrics(spark, sf_dir):
    rows = _classified(spark, sf_dir)
    kinds = ["feature", "bugfix", "refactor", "documentation", "test", "maintenance"]
    return rows.groupBy("week_label").agg(F.count("*").alias("total"), *[_n(F.col("category") == k, k) for k in kinds])


def weekly_categorization(spark, sf_dir):
    counts = _classified(spark, sf_dir).groupBy("week_label", "category").agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("week_label")))


def _merged(spark, sf_dir):
    pr = model.pull_requests(spark, sf_dir).where("state = 'merged'")
    return pr.withColumn("h", F.timestamp_diff("SECOND", F.col("created_at"), F.col("merged_at")) / 3600.0)


def pr_cycle_stats(spark, sf_dir):
    """Cycle times between half an hour and 720 hours: count, mean, upper median; and merges of any cycle time per week that has merges, 0 without."""
    rows = _merged(spark, sf_dir)
    kept = F.when(F.col("h").between(0.5, 720), F.timestamp_diff("SECOND", F.col("created_at"), F.col("merged_at")))
    n = F.count(kept)
    per_week = F.coalesce(F.try_divide(F.count("merged_at"), F.countDistinct(iso_week("merged_at"))), F.lit(0.0))
    out = rows.agg(n.alias("merged"), F.try_divide(F.sum(kept), n * 3600.0).alias("avg_hours"), per_week.alias("per_week"))
    return out.crossJoin(F.broadcast(scoring.upper_middle(rows.where("h between 0.5 and 720"), "h"))).select("merged", "avg_hours", "median_hours", "per_week")  # two single rows


def weekly_velocity(spark, sf_dir):
    """Merges and commits per developer of each week, beside the average cycle time of all weeks."""
    weeks = week_totals(spark, sf_dir)
    merged = _merged(spark, sf_dir).groupBy(iso_week("merged_at").alias("week_label")).agg(F.count("*").alias("prs"))
    overall = pr_cycle_stats(spark, sf_dir).select("avg_hours")  # one row
    out = weeks.join(merged, "week_label", "left").crossJoin(F.broadcast(overall))
    return out.select("week_label", F.coalesce("prs", F.lit(0)).alias("prs_merged"), (F.col("commits") / F.col("developers")).alias("commits_per_developer"), F.col("avg_hours").alias("overall_avg_hours"))


def pr_metrics(spark, sf_dir):
    rows = model.pull_requests(spark, sf_dir).withColumn("author", F.when(F.col("author") == "", "(unknown)").otherwise(F.col("author")))
    s = F.when(F.col("state") == "merged", F.timestamp_diff("SECOND", F.col("created_at"), F.col("merged_at")))
    s = F.when(s >= 0, s)
    merged = F.sum(F.when(F.col("state") == "merged", 1).otherwise(0))
    return rows.groupBy("author").agg(F.count("*").alias("opened"), merged.alias("merged"), (merged / F.count("*")).alias("merge_rate"), F.coalesce(F.sum(s) / F.count(s) / 3600.0, F.lit(0.0)).alias("avg_hours"))


def pr_drilldown(spark, sf_dir):
    """Upper median and, from twenty merges, the value at index n*95/100."""
    rows = _merged(spark, sf_dir).where("h between 0.5 and 720").select("author", "h")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("author").orderBy("h"))).withColumn("n", F.count("*").over(Window.partitionBy("author")))
    at = lambda place: F.max(F.when(F.col("place") == place, F.col("h")))
    return rows.groupBy("author", "n").agg(at(F.floor(F.col("n") / 2) + 1).alias("median_hours"), F.when(F.col("n") >= 20, at(F.floor(F.col("n") * 95 / 100) + 1)).alias("p95_hours"))


def _efforts(spark, sf_dir):
    rows = model.files(spark, sf_dir)
    loc = F.col("insertions") + F.col("deletions")
    test = F.when(textfx.is_test_path(F.col("path")), loc).otherwise(0)
    rows = rows.groupBy("commit_id").agg(F.sum(loc).alias("loc"), F.countDistinct("path").alias("n_files"), F.sum(test).alias("test_loc"))
    return rows.withColumn("score", scoring.effort(F.col("loc"), F.col("n_files"), F.col("test_loc")))


def effort_histogram(spark, sf_dir):
    return _efforts(spark, sf_dir).groupBy(scoring.effort_size(F.col("score")).alias("size")).agg(F.count("*").alias("n"))


def effort_bands(spark, sf_dir):
    """Nearest-rank thresholds at 20, 40, 60 and 80 percent of lines changed, and how many commits lie in each band (strictly below its bound)."""
    rows = _efforts(spark, sf_dir)
    marks = rows.agg(*[F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY loc)").alias(f"p{p}") for p in (20, 40, 60, 80)])  # one row
    loc = F.col("loc")
    band = F.when(loc < F.col("p20"), "XS").when(loc < F.col("p40"), "S").when(loc < F.col("p60"), "M").when(loc < F.col("p80"), "L").otherwise("XL")
    return rows.crossJoin(F.broadcast(marks)).groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.min("loc").cast("long").alias("least"), F.max("loc").cast("long").alias("most"))


def commit_summary(spark, sf_dir):
    rows = model.commits(spark, sf_dir).where("not is_merge")
    return rows.groupBy("author_email").agg(F.count("*").alias("commits"), _n(F.col("ticketed"), "ticketed"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.array_join(F.array_sort(F.collect_set("repository")), ",").alias("repositories"))


def period_trends(spark, sf_dir, weeks: int = 4):
    """Periods of four ISO weeks from each author's first week."""
    rows = _classified(spark, sf_dir).withColumn("monday", F.to_date(F.date_trunc("week", "ts")))
    first = rows.groupBy("author_email").agg(F.min("monday").alias("anchor"))
    period = F.floor(F.datediff("monday", "anchor") / (7 * weeks)).cast("long")
    return rows.join(first, "author_email").groupBy("author_email", period.alias("period")).agg(F.count("*").alias("commits"), _n(F.col("category") == "bugfix", "bugfixes"), F.sum("insertions").alias("insertions"))


def weekly_quality(spark, sf_dir):
    rows = _classified(spark, sf_dir).groupBy("author_email", "week_label", "repository").agg(
        F.count("*").alias("commits"), _n(textfx.is_revert(F.col("message")), "reverts"), _n(F.col("category") == "bugfix", "bugfixes"), _n(F.col("ticketed"), "ticketed")
    )
    rows = rows.withColumn("score", scoring.weekly_quality(F.col("commits"), F.col("reverts"), F.col("bugfixes"), F.col("ticketed")))
    return rows.withColumn("size", scoring.quality_size(F.col("score")))


def quality_summary(spark, sf_dir):
    rows = _classified(spark, sf_dir).agg(F.count("*").alias("commits"), _n(F.col("category") == "bugfix", "b"), _n(textfx.is_revert(F.col("message")), "reverts"))
    rows = rows.withColumn("bugfixes", F.greatest("b", "reverts"))
    score = 1 - F.lit(0.4) * F.try_divide("bugfixes", "commits") - F.lit(0.6) * F.try_divide("reverts", "commits")
    score = F.when(F.col("commits") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).otherwise(F.lit(0.0))
    defects = F.when(F.col("commits") > F.col("bugfixes"), F.try_divide("bugfixes", F.col("commits") - F.col("bugfixes"))).otherwise(F.lit(0.0))
    return rows.select("commits", F.coalesce("bugfixes", F.lit(0)).alias("bugfixes"), F.coalesce("reverts", F.lit(0)).alias("reverts"), score.alias("score"), defects.alias("defect_ratio"))


def weekly_engineer(spark, sf_dir):
    rows = weekly_activity(spark, sf_dir)
    net = F.greatest(F.col("commits") - F.col("reverts"), F.lit(0))
    return rows.select("week_label", "author_email", "repository", net.alias("net"), F.when(net > 0, F.col("ai_assisted") * 100.0 / net).otherwise(F.lit(0.0)).alias("agentic_pct"))


def developer_activity(spark, sf_dir):
    """Min-max normalised score of five factors: commits, pull requests (not known by author: constant 0), lines, files a commit, and commits with a category.

    A factor without range counts 0. The work type is the most frequent category, ties to the first by name."""
    rows = _classified(spark, sf_dir)
    kinds = rows.groupBy("author_email", "category").agg(F.count("*").alias("n")).groupBy("author_email").agg(F.min(F.struct(-F.col("n"), "category"))["category"].alias("work_type"), F.sum("n").alias("categorised"))
    rows = rows.groupBy("author_email").agg(F.count("*").alias("commits"), F.sum(F.col("insertions") + F.col("deletions")).alias("lines"), (F.sum("files_changed") / F.count("*")).alias("files_per_commit"), F.countDistinct("week_label").alias("weeks"))
    rows = rows.join(kinds, "author_email").withColumn("prs", F.lit(0).cast("long"))
    span = rows.agg(*[f(c).alias(f"{n}_{c}") for c, _ in ACTIVITY_WEIGHTS for n, f in (("low", F.min), ("high", F.max))])  # one row
    unit = lambda c: F.when(F.col(f"high_{c}") == F.col(f"low_{c}"), F.lit(0.0)).otherwise((F.col(c) - F.col(f"low_{c}")) / (F.col(f"high_{c}") - F.col(f"low_{c}")))
    score = sum((F.lit(w) * unit(c) for c, w in ACTIVITY_WEIGHTS), F.lit(0.0))
    return rows.crossJoin(F.broadcast(span)).select("author_email", "commits", "prs", "lines", "files_per_commit", "categorised", "weeks", (F.col("commits") / F.col("weeks")).alias("commits_per_week"), "work_type", score.alias("score"))


def coverage(spark, sf_dir):
    rows = _classified(spark, sf_dir, merges=True)
    done = F.sum(F.when(F.col("confidence") > 0.3, 1).otherwise(0))
    return rows.rollup("repository").agg(F.count("*").alias("total"), done.alias("classified"), (done * 100.0 / F.count("*")).alias("pct")).withColumn("repository", F.coalesce("repository", F.lit("(all)")))


def bus_factor(spark, sf_dir):
    """Per top-level path: touches, authors, share of the top author, and the fewest authors with half of the touches."""
    touched = model.files(spark, sf_dir).join(model.commits(spark, sf_dir).select("id", "author_email"), F.col("commit_id") == F.col("id"))
    counts = touched.groupBy(F.split("path", "/")[0].alias("subsystem"), "author_email").agg(F.count("*").alias("n"))
    w = Window.partitionBy("subsystem").orderBy(F.desc("n"), "author_email")
    all_rows = Window.partitionBy("subsystem")
    counts = counts.withColumn("run", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", F.row_number().over(w)).withColumn("total", F.sum("n").over(all_rows))
    return counts.groupBy("subsystem").agg(F.max("total").alias("touches"), F.count("*").alias("authors"), (F.max("n") * 100.0 / F.max("total")).alias("top_pct"), F.min(F.when(F.col("run") * 2 >= F.col("total"), F.col("place"))).cast("long").alias("bus_factor"))


def single_author_paths(spark, sf_dir):
    touched = model.files(spark, sf_dir).join(model.commits(spark, sf_dir).select("id", "author_email"), F.col("commit_id") == F.col("id"))
    return touched.groupBy("path").agg(F.countDistinct("author_email").alias("authors"), F.min("author_email").alias("author"), F.count("*").alias("touches")).where("authors = 1")


def monthly_trajectory(spark, sf_dir):
    """The latest twelve months that have commits."""
    rows = model.commits(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.countDistinct("author_email").alias("authors"), F.countDistinct("sha").alias("commits"))
    return rows.orderBy(F.desc("month")).limit(12)


def churn(spark, sf_dir):
    """The twenty most changed files."""
    touched = model.files(spark, sf_dir).join(model.commits(spark, sf_dir).select("id", "author_email"), F.col("commit_id") == F.col("id"))
    rows = touched.groupBy("path").agg(F.countDistinct("commit_id").alias("commits"), F.countDistinct("author_email").alias("authors"), F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"))
    rows = rows.withColumn("severity", F.when(F.col("commits") >= 20, "red").when(F.col("commits") >= 5, "amber").otherwise("green"))
    return rows.orderBy(F.desc("commits"), "path").limit(20)


def debt_rollup(spark, sf_dir):
    """Counts by tier, dimension, repository and tier, tier and dimension, and in total, in one pass."""
    rows = _classified(spark, sf_dir).select("repository", F.when(F.col("insertions") > 400, "high").when(F.col("insertions") > 150, "medium").otherwise("low").alias("tier"), F.col("top_level").alias("dimension"))
    tier, dimension, repository = F.col("tier"), F.col("dimension"), F.col("repository")
    return rows.groupingSets([[tier], [dimension], [repository, tier], [tier, dimension], []], tier, dimension, repository).agg(F.count("*").alias("n"))


def untracked(spark, sf_dir):
    """Commits without a ticket that aren't boilerplate: the author's name over all commits, and the whole first line."""
    rows = model.commits(spark, sf_dir).where("not is_merge and not ticketed").where(~F.coalesce(textfx.is_boilerplate(F.col("message"), F.col("insertions") + F.col("deletions")), F.lit(False)))
    names = author_summary(spark, sf_dir).select("author_email", "name")
    subject = F.regexp_replace(F.split_part("message", F.lit("\n"), F.lit(1)), "\r$", "")
    return rows.join(names, "author_email", "left").select("sha", F.coalesce("name", "author_name").alias("author"), "repository", "ts", subject.alias("subject"))


def classified_commits(spark, sf_dir):
    """The whole cascade with its built-in rules, with every nineteenth commit overridden by hand."""
    rows = model.commits(spark, sf_dir).select("id", "sha", "message", "is_merge")
    overrides = rows.where("id % 19 = 0").select("sha", F.lit("platform").alias("work_type"))
    return cascade.classify(rows, overrides).select("sha", *cascade.VERDICT)


def bucket_counts(spark, sf_dir):
    return _classified(spark, sf_dir).groupBy("bucket").agg(F.count("*").alias("n"), F.countDistinct("author_email").alias("authors"))


def tickets(spark, sf_dir):
    m = F.col("message")
    return model.commits(spark, sf_dir).select("sha", textfx.ticket(m).alias("ticket"), textfx.is_revert(m).alias("is_revert"), textfx.word_count(m).alias("words"))


def week_drift(spark, sf_dir):
    """Repositories seen in each week, beside the week before that is known."""
    rows = model.commits(spark, sf_dir).groupBy(iso_week("ts").alias("week_label")).agg(F.countDistinct("repository").alias("repositories"))
    before = F.lag("repositories").over(Window.orderBy("week_label"))  # one row a week
    return rows.withColumn("before", before).withColumn("drift", F.col("repositories") - F.col("before"))


def week_gaps(spark, sf_dir):
    """Every ISO week from the first to the last, with 0 where nothing happened."""
    rows = model.commits(spark, sf_dir).select(F.to_date(F.date_trunc("week", "ts")).alias("monday"))
    span = rows.agg(F.min("monday").alias("a"), F.max("monday").alias("b"))
    weeks = span.select(F.explode(F.sequence("a", "b", F.expr("interval 7 days"))).alias("monday"))
    return weeks.join(rows.groupBy("monday").agg(F.count("*").alias("n")), "monday", "left").select(iso_week(F.col("monday")).alias("week_label"), F.coalesce("n", F.lit(0)).alias("commits"))


def repository_trend(spark, sf_dir):
    """Least-squares slope of commits over the months that have commits, numbered from 0: improving beyond 0.1, declining below -0.1."""
    rows = model.commits(spark, sf_dir).groupBy("repository", (F.year("ts") * 12 + F.month("ts")).alias("month")).agg(F.count("*").alias("y"))
    rows = rows.withColumn("x", F.row_number().over(Window.partitionBy("repository").orderBy("month")) - 1)
    x, y = F.col("x").cast("long"), F.col("y")
    n, sx, sy, sxy, sxx = F.count("*"), F.sum(x), F.sum(y), F.sum(x * y), F.sum(x * x)
    slope = F.when(n * sxx - sx * sx == 0, F.lit(0.0)).otherwise((n * sxy - sx * sy) / (n * sxx - sx * sx))
    out = rows.groupBy("repository").agg(slope.alias("slope"))
    return out.withColumn("trend", F.when(F.col("slope") > 0.1, "improving").when(F.col("slope") < -0.1, "declining").otherwise("stable"))
