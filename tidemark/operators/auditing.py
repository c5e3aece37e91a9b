"""Audit queries over imports, licences, advisories, citations and texts; project statistics; incremental bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timefx import iso_week
from ..sources import model
from .graphs import strong_components
from .linking import _choice

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TEXTS = [("documents", "text"), ("documents", "lang"), ("pages", "html"), ("pages", "url"), ("benchmark", "text"), ("conversations", "text"), ("conversations", "role")]
#: Ranks of licence terms (1 free to use, 2 weak, 3 strong copyleft); other terms are unknown, rank 4.
LICENCES = {"MIT": 1, "Apache-2.0": 1, "ISC": 1, "Zlib": 1, "BSD-3-Clause": 1, "MPL-2.0": 2, "LGPL-3.0": 2, "EPL-2.0": 2, "GPL-3.0": 3, "AGPL-3.0": 3}
VERDICTS = ["permissive", "weak", "strong", "unknown"]
EXPRESSIONS = ["MIT", "Apache-2.0 OR GPL-3.0", "GPL-3.0 AND LGPL-3.0", "LGPL-3.0", "Custom-1.0", "", "MPL-2.0", "AGPL-3.0 OR EPL-2.0", "Foo-2 AND MPL-2.0"]
#: Shapes of secrets.
SECRETS = r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|-----BEGIN [A-Z ]*PRIVATE KEY-----"
DIFF = r"(?m)^(\+\+\+|---|@@) "
AS_OF = "1998-08-02"


def import_edges(spark, sf_dir) -> DataFrame:
    """Suppliers as modules."""
    s = F.col("s_suppkey")
    rows = model.table(spark, sf_dir, "supplier")
    return rows.where(s % 2 == 0).select(s.alias("id"), ((s * 3 + 1) % 64).alias("next")).union(rows.select(s, F.floor(s / 3))).union(rows.where(s % 7 == 5).select(s, s - 1)).distinct()


def import_cycles(spark, sf_dir):
    """Modules that import each other: the least of them and their number."""
    found = strong_components(import_edges(spark, sf_dir))
    return found.groupBy("component").agg(F.min("id").alias("first"), F.count("*").alias("modules")).select("first", "modules")


def inbound_degrees(spark, sf_dir):
    """The five modules that most others import."""
    return import_edges(spark, sf_dir).where("id <> next").groupBy(F.col("next").alias("module")).agg(F.count("*").alias("importers")).orderBy(F.desc("importers"), "module").limit(5)


def licence_policy(spark, sf_dir):
    """Packages by verdict: any free term of a choice settles it, else the worst term counts."""
    text = _choice(EXPRESSIONS, F.col("p_partkey"))
    ranks = F.transform(F.split(text, " (?:AND|OR) "), lambda t: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LICENCES.items() for x in kv]), t), F.lit(4)))
    verdict = F.when(text == "", "unlicensed").otherwise(F.element_at(F.array(*[F.lit(v) for v in VERDICTS]), F.when(F.array_min(ranks) == 1, 1).otherwise(F.array_max(ranks))))
    return model.table(spark, sf_dir, "part").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("packages"))


def advisory_rollup(spark, sf_dir):
    """The ten packages with the highest scores, most used first, and their severity."""
    score = F.floor(F.col("p_retailprice") * 10).cast("long") % 101
    used = model.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("uses"))
    rows = model.table(spark, sf_dir, "part").select("p_partkey", score.alias("points")).join(used, "p_partkey")
    band = F.when(F.col("points") >= 90, "critical").when(F.col("points") >= 70, "high").when(F.col("points") >= 40, "medium").when(F.col("points") > 0, "low").otherwise("none")
    return rows.withColumn("severity", band).orderBy(F.desc("points"), F.desc("uses"), "p_partkey").limit(10)


def severities(spark, sf_dir):
    """How often each severity is used, and by how many packages."""
    score = F.floor(F.col("p_retailprice") * 10).cast("long") % 101
    band = F.when(score >= 90, "critical").when(score >= 70, "high").when(score >= 40, "medium").when(score > 0, "low").otherwise("none")
    return model.table(spark, sf_dir, "part").groupBy(band.alias("severity")).agg(F.count("*").alias("packages"))


def citations(spark, sf_dir):
    """Whether the cited line has the quoted text, another line has it, or none. Every document is cited: any of its lines may be quoted and any cited."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    docs = model.table(spark, sf_dir, "documents").select("doc_id", lines.alias("lines"))
    n, k = F.size("lines").cast("long"), F.col("doc_id")
    quoted = F.pmod(k * 7, n)  # from 0
    quote = F.when(k % 4 == 0, "no such line").otherwise(F.trim(F.get("lines", quoted.cast("int"))))
    cited = docs.select("doc_id", "lines", (F.pmod(quoted + F.when(k % 3 == 0, 1).otherwise(0), n) + 1).alias("line"), quote.alias("quote"))
    here = F.trim(F.get("lines", (F.col("line") - 1).cast("int"))) == F.col("quote")
    somewhere = F.exists("lines", lambda t: F.trim(t) == F.col("quote"))
    return cited.select("doc_id", "line", F.when(here, "verified").when(somewhere, "moved").otherwise("missing").alias("verdict"))


def coverage_rollup(spark, sf_dir):
    """Share of commits with a ticket by repository, to one decimal."""
    rows = model.commits(spark, sf_dir).where("not is_merge").groupBy("repository").agg(F.count("*").alias("n"), F.count_if("ticketed").alias("covered"))
    return rows.select("repository", "n", (F.floor(F.col("covered") * 1000.0 / F.col("n") + 0.5) / 10.0).alias("pct"))


def text_scan(spark, sf_dir):
    """Each text column: values, nulls, the longest, and how many look like a diff; one scan a table."""
    out = None
    for t in dict.fromkeys(t for t, _ in TEXTS):
        columns = [c for n, c in TEXTS if n == t]
        facts = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"{c}_n").alias("n"), F.col(f"{c}_none").alias("nulls"), F.col(f"{c}_max").alias("longest"), F.col(f"{c}_diff").alias("diff_like")) for c in columns])).alias("f")
        measures = [m for c in columns for m in (F.count(c).alias(f"{c}_n"), F.count_if(F.col(c).isNull()).alias(f"{c}_none"), F.max(F.length(c)).cast("long").alias(f"{c}_max"), F.count_if(F.col(c).rlike(DIFF)).alias(f"{c}_diff"))]
        rows = model.table(spark, sf_dir, t).agg(*measures).select(F.lit(t).alias("table_name"), facts).select("table_name", "f.*")
        out = rows if out is None else out.union(rows)
    return out


def table_counts(spark, sf_dir):
    """Rows and columns of every table."""
    out = None
    for t in TABLES:
        df = model.table(spark, sf_dir, t)
        rows = df.agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n", F.lit(len(df.columns)).cast("long").alias("n_columns"))
        out = rows if out is None else out.union(rows)
    return out


def blended_paths(spark, sf_dir, most: int = 25):
    """Three ranked lists dealt in rounds, a path where it comes first; 25 in all. Lanes are cut before they meet."""
    rows = model.files(spark, sf_dir).groupBy("path").agg(F.count("*").alias("touches"), F.sum("insertions").alias("added"), F.sum("deletions").alias("gone"))
    lanes = None
    for lane, by in enumerate(("touches", "added", "gone")):
        top = rows.orderBy(F.desc(by), "path").limit(most)
        top = top.select(F.lit(lane).alias("lane"), "path", F.row_number().over(Window.partitionBy(F.lit(lane)).orderBy(F.desc(by), "path")).alias("turn"))
        lanes = top if lanes is None else lanes.union(top)
    first = lanes.groupBy("path").agg(F.min(F.struct("turn", "lane")).alias("f")).select("path", "f.turn", "f.lane")
    return first.orderBy("turn", "lane").limit(most)


def scrubbed(spark, sf_dir):
    return model.table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), SECRETS, "<secret>"), 256).alias("text_sha256"))


def period_labels(spark, sf_dir):
    """First and last ISO week of each author; the second without its year if it is the same."""
    rows = model.commits(spark, sf_dir).groupBy("author_email").agg(iso_week(F.min("ts")).alias("a"), iso_week(F.max("ts")).alias("b"))
    same = F.substr("a", F.lit(1), F.lit(4)) == F.substr("b", F.lit(1), F.lit(4))
    return rows.select("author_email", F.concat("a", F.lit(".."), F.when(same, F.substring_index("b", "-", -1)).otherwise(F.col("b"))).alias("period"))


def parsed_times(spark, sf_dir):
    """Seconds since the epoch of times written in five ways; null for what is none of them."""
    t, k = F.col("ts").cast("timestamp"), F.col("event_id")
    text = F.when(k % 6 == 0, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k % 6 == 1, F.concat(F.date_format(t + F.expr("interval 2 hours"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))).when(k % 6 == 2, F.date_format(t, "yyyy-MM-dd HH:mm:ss")).when(k % 6 == 3, F.date_format(t, "yyyy-MM-dd")).when(k % 6 == 4, F.unix_timestamp(t).cast("string")).otherwise("yesterday")
    forms = ["yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"]
    rows = model.table(spark, sf_dir, "events").select("event_id", text.alias("text"))
    read = F.coalesce(*[F.unix_timestamp(F.try_to_timestamp("text", F.lit(f))) for f in forms], F.when(F.col("text").rlike("^[0-9]+$"), F.expr("try_cast(text as bigint)")))
    return rows.select("event_id", read.alias("seconds"))


def _projects(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey").cast("int")
    start = F.lit("1997-01-01").cast("date")
    state = _choice(["planned", "started", "completed", "completed", "canceled"], k)
    target = F.when(k % 7 != 0, F.date_add(start, k % 600))
    return model.table(spark, sf_dir, "part").select(k.alias("id"), state.alias("state"), target.alias("target"), F.when(state == "completed", F.date_add(start, (k * 13) % 650)).alias("done"), (k % 3 != 0).alias("led"))


def project_stats(spark, sf_dir):
    """Projects by state: without target, overdue, late, mean days late, share with a lead."""
    late = F.datediff("done", "target")
    return _projects(spark, sf_dir).groupBy("state").agg(
        F.count("*").alias("n"), F.count_if(F.col("target").isNull()).alias("no_target"), F.count_if((F.col("state") == "started") & (F.col("target") < F.lit(AS_OF).cast("date"))).alias("overdue"),
        F.count_if(late > 0).alias("late"), F.avg(F.when(late > 0, late)).alias("mean_days_late"), (F.count_if("led") * 100.0 / F.count("*")).alias("led_pct"))


def cycle_stats(spark, sf_dir):
    """Completed cycles by team: pooled and median completion, slots carried over a cycle."""
    k = F.col("c_custkey")
    rows = model.table(spark, sf_dir, "customer").where(k % 5 != 0).select((k % 6).alias("team"), (k % 17).alias("scope"), F.when(k % 11 != 0, k % 17 - F.least(k % 4, k % 17)).alias("done")).where("scope > 0 and done is not null")
    return rows.groupBy("team").agg(F.count("*").alias("cycles"), (F.sum("done") * 100.0 / F.sum("scope")).alias("pooled_pct"), (F.sum(F.col("scope") - F.col("done")) / F.count("*")).alias("carryover"), F.round(F.percentile(F.col("done") * 100.0 / F.col("scope"), 0.5), 6).alias("median_pct"))


def population(spark, sf_dir):
    """Issues by team and state, with subtotals and the total."""
    return model.issues(spark, sf_dir).rollup("team_key", "state_type").agg(F.count("*").alias("n"))


def usage_totals(spark, sf_dir):
    """Calls and tokens by outcome; the tokens are a JSON field."""
    tokens = F.get_json_object("props", "$.k").cast("long")
    return model.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("calls"), F.sum(tokens).alias("tokens"), F.max(tokens).alias("most"))


def pending_partitions(spark, sf_dir):
    """(repository, ISO week) not yet in the ledger of processed ones."""
    rows = model.commits(spark, sf_dir).select("id", "repository", iso_week("ts").alias("week_label"))
    ledger = rows.where("id % 3 = 0").select("repository", "week_label").distinct()
    return rows.select("repository", "week_label").distinct().join(ledger, ["repository", "week_label"], "left_anti")


def soft_deletes(spark, sf_dir):
    """A full sync compared with what is stored: new, kept and removed rows."""
    rows = model.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("team"))
    stored, sent = rows.where("id % 3 <> 0").withColumn("old", F.lit(1)), rows.where("id % 4 <> 0").withColumn("new", F.lit(1))
    status = F.when(F.col("new").isNull(), "removed").when(F.col("old").isNull(), "new").otherwise("kept")
    return stored.join(sent, ["id", "team"], "full").groupBy("team", status.alias("status")).agg(F.count("*").alias("n"))


def renamed_references(spark, sf_dir):
    """References by the key that each project has now; distinct after the renaming."""
    k = F.col("id")
    refs = model.commits(spark, sf_dir).select("repository", F.concat(F.lit("P"), (k % 9).cast("string")).alias("key"), (k % 40).alias("number"))
    names = spark.createDataFrame([("P1", "Q1"), ("P2", "Q1"), ("P5", "P6")], "key string, now string").hint("broadcast")
    now = refs.join(names, "key", "left").select("repository", F.coalesce("now", "key").alias("key"), "number").distinct()
    return now.groupBy("repository", "key").agg(F.count("*").alias("references"))


def activity_candidates(spark, sf_dir):
    """Issues whose marker isn't their last change (nulls compare as values) and that have no tombstone at it."""
    k = F.col("issue_id")
    rows = model.issues(spark, sf_dir).select(k, "team_key", F.coalesce("completed_at", "started_at").alias("updated_at"))
    state = rows.where(k % 3 != 0).select(k, F.when(k % 5 != 0, F.col("updated_at")).alias("marker"), F.when(k % 10 == 0, F.col("updated_at")).alias("tombstone"))
    met = rows.join(state, "issue_id", "left").where(~F.col("marker").eqNullSafe(F.col("updated_at")) & ~F.coalesce(F.col("tombstone") == F.col("updated_at"), F.lit(False)))
    return met.groupBy("team_key").agg(F.count("*").alias("candidates"))
