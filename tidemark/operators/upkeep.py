"""Incremental reads, path predicates, and looking up people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources import model
from .linking import _choice

#: File names that nobody writes by hand, and endings of configuration and prose.
GENERATED_NAMES = ["Cargo.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "go.sum", "Gemfile.lock", "composer.lock", "CHANGELOG.md"]
GENERATED_ENDINGS = ["toml", "md", "tsv", "csv", "json", "yaml", "yml", "lock", "txt", "cfg", "ini", "xml", "svg"]
#: Parts of lower-cased paths of tests.
TEST_PATH = r"(^|/)(tests|test|__tests__|spec|benches)(/|$)|(^|/)tests\.rs$|_tests?\.rs$|_test\.(go|py)$|(^|/)test_[^/]*$|\.(test|spec)\.[^/]*$"


def is_generated(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return name.isin(GENERATED_NAMES) | F.substring_index(name, ".", -1).isin(GENERATED_ENDINGS)


def glob(pattern: str) -> str:
    """The regular expression of a branch glob: ** crosses segments, * and ? don't."""
    import re

    marks = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(marks.get(p) or re.escape(p) for p in re.split(r"(\*\*|\*|\?)", pattern) if p) + "$"


def path_kinds(spark, sf_dir):
    """Lines changed in tests, generated files and code."""
    path = F.concat("path", F.when(F.col("insertions") % 9 == 0, ".svg").when(F.col("insertions") % 9 == 1, "/Cargo.lock").when(F.col("insertions") % 9 == 2, "/tests/a.rs").otherwise(""))
    kind = F.when(is_generated(path), "generated").when(F.lower(path).rlike(TEST_PATH), "test").otherwise("code")
    return model.files(spark, sf_dir).groupBy(kind.alias("kind")).agg(F.count("*").alias("touches"), F.sum(F.col("insertions") + F.col("deletions")).alias("lines"))


def branch_matches(spark, sf_dir, patterns=("release/*", "feature/**", "hot?ix-*")):
    """Branches that globs select."""
    branch = F.concat(_choice(["release/", "release/x/", "feature/a/b-", "hotfix-", "hotix-", "main"], F.col("id")), (F.col("id") % 5).cast("string"))
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.col("branch").rlike(glob(p))
    return model.commits(spark, sf_dir).select(branch.alias("branch")).groupBy("branch").agg(F.count("*").alias("commits")).where(hit)


def reread(spark, sf_dir):
    """Events from each type's watermark on, the watermark itself too; what was stored is counted as seen again."""
    rows = model.table(spark, sf_dir, "events")
    marks = rows.where("event_id % 4 <> 0").groupBy("event_type").agg(F.max("ts").alias("mark"))
    new = rows.join(marks, "event_type").where(F.col("ts") >= F.col("mark"))
    return new.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("event_id") % 4 != 0).alias("again"))


def stale_versions(spark, sf_dir, version: int = 3):
    """Rows that an older detector judged, by repository."""
    seen = F.col("id") % 5
    return model.commits(spark, sf_dir).groupBy("repository").agg(F.count("*").alias("n"), F.count_if((seen < version) | (F.col("id") % 31 == 0)).alias("stale"))


def walk_plan(spark, sf_dir):
    """Per repository: skip, go on or start over, and why."""
    k = F.substr("repository", F.lit(5)).cast("int")
    rows = model.commits(spark, sf_dir).groupBy("repository").agg(F.max("id").alias("head")).withColumn("k", k)
    known = F.when(F.col("k") % 5 != 0, F.when(F.col("k") % 3 == 0, F.col("head")).otherwise(F.col("head") - 1))
    plan = F.when(known.isNull(), F.struct(F.lit("full").alias("plan"), F.lit("never walked").alias("why"))).when(F.col("k") % 7 == 1, F.struct(F.lit("full").alias("plan"), F.lit("not finished").alias("why"))).when(F.col("k") % 11 == 2, F.struct(F.lit("full").alias("plan"), F.lit("settings changed").alias("why"))).when(known == F.col("head"), F.struct(F.lit("skip").alias("plan"), F.lit("same head").alias("why"))).otherwise(F.struct(F.lit("incremental").alias("plan"), F.lit("head moved").alias("why")))
    return rows.select("repository", plan.alias("p")).select("repository", "p.plan", "p.why")


def walk_states(marks: DataFrame) -> DataFrame:
    """repository, finished, head, changed_at from marks (repository, at, kind, head): kind is start before a walk and complete after it.

    A walk that was started and never completed leaves its repository unfinished, with the head of the last complete walk (null: none);
    at one time complete comes before start. Marks are only appended, so a lost job leaves no false state."""
    start = F.col("kind") == "start"
    latest, whole = F.max(F.struct("at", start.alias("start"))), F.max(F.when(F.col("kind") == "complete", F.struct("at", "head")))
    rows = marks.where("kind in ('start', 'complete')").groupBy("repository").agg(latest.alias("l"), whole.alias("w"))
    return rows.select("repository", (~F.col("l.start")).alias("finished"), F.col("w.head").alias("head"), F.col("l.at").alias("changed_at"))


def walk_states_of_events(spark, sf_dir):
    """Views as starts and purchases as completed walks of a repository."""
    kind = F.when(F.col("event_type") == "view", "start").when(F.col("event_type") == "purchase", "complete")
    marks = model.table(spark, sf_dir, "events").select(F.concat(F.lit("repo"), (F.col("user_id") % 25).cast("string")).alias("repository"), F.col("ts").alias("at"), kind.alias("kind"), F.col("event_id").alias("head"))
    return walk_states(marks)


def shared_commits(spark, sf_dir):
    """Addresses that share a commit: the pair, how many and the confidence. A commit's distinct addresses are two at most here, so min and max name the pair."""
    rows = model.commits(spark, sf_dir)
    other = F.when(F.col("id") % 30 == 4, F.concat(F.lit("dev"), (F.col("author_id") % 89).cast("string"), F.lit("@home.org")))
    both = rows.select("sha", "author_email").union(rows.where(other.isNotNull()).select("sha", other))
    pairs = both.groupBy("sha").agg(F.min("author_email").alias("src"), F.max("author_email").alias("dst")).where("src < dst")
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("commits")).withColumn("confidence", F.lit(0.92))


def merge_risk(spark, sf_dir):
    """The ten busiest authors, and those of them whose address starts like another of the ten."""
    top = model.commits(spark, sf_dir).where("not is_merge").groupBy("author_email").agg(F.count("*").alias("commits")).orderBy(F.desc("commits"), "author_email").limit(10)
    stem = F.substr("author_email", F.lit(1), F.lit(4))
    alike = top.groupBy(stem.alias("stem")).agg(F.count("*").alias("alike"))
    return top.withColumn("stem", stem).join(alike, "stem").select("author_email", "commits", (F.col("alike") > 1).alias("at_risk"))
