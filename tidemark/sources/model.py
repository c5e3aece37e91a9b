"""The engineering-activity model, projected from the tables at hand.

orders are commits and pull requests, lineitem with part are file changes, customer are authors, events are deployments and incidents.
Every function returns a DataFrame; nothing is read before an action. ``PRELUDE`` says the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Commit messages by order key modulo 15.
MESSAGES = [
    "feat: add export button", "fix: handle empty input", "docs: update readme", "refactor: split parser module", "test: cover edge cases",
    "chore: bump dependencies", "ci: cache build artifacts", "perf: speed up query planner", "style: format code", "fix(api): correct null check",
    "Merge branch main into dev", "Revert \"feat: add export button\"", "PROJ-12 improve error text", "wip", "reverted broken change",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _seconds(c):
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), c.cast("decimal(18,6)"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    names = F.array(*[F.lit(m) for m in MESSAGES])
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), F.concat(F.lit("c"), k.cast("string")).alias("sha"), F.col("o_custkey").alias("author_id"),
        F.concat(F.lit("dev"), (F.col("o_custkey") % 97).cast("string"), F.lit("@example.com")).alias("author_email"),
        F.concat(F.lit("Dev "), (F.col("o_custkey") % 101).cast("string")).alias("author_name"), (F.col("o_orderdate") + _seconds(k % 86400)).alias("ts"),
        F.concat(F.lit("repo"), (k % 25).cast("string")).alias("repository"),
        F.concat(F.element_at(names, (k % 15 + 1).cast("int")), F.when(k % 5 == 2, F.concat(F.lit(" (#"), k.cast("string"), F.lit(")"))).otherwise("")).alias("message"),
        F.floor(F.col("o_totalprice") / 500).cast("long").alias("insertions"), F.floor(F.col("o_totalprice") / 900).cast("long").alias("deletions"), (k % 7 + 1).alias("files_changed"),
        (k % 15 == 10).alias("is_merge"), (k % 4 == 0).alias("ticketed"), (k % 11 == 3).alias("is_ai_assisted"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lower(F.replace("p_type", F.lit(" "), F.lit("/"))), F.lit("/f"), (F.col("p_partkey") % 50).cast("string"), F.when(F.col("l_linenumber") == 7, "_test.rs").otherwise(".rs"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount")
    return lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("commit_id"), path.alias("path"), F.col("l_quantity").cast("long").alias("insertions"), F.round(F.col("l_discount") * 100).cast("long").alias("deletions")
    )


def pull_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    opened = F.col("o_orderdate") + _seconds(k % 86400)
    done = opened + _seconds((k * 7919) % 3000000 - 20000)
    return table(spark, sf_dir, "orders").select(
        k.alias("pr_number"), F.concat(F.lit("repo"), (k % 25).cast("string")).alias("repository"), F.when(F.col("o_custkey") % 53 == 0, "").otherwise(F.concat(F.lit("dev"), (F.col("o_custkey") % 97).cast("string"))).alias("author"),
        F.when(F.col("o_orderstatus") == "F", "merged").when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("state"), opened.alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", done).alias("merged_at"),
    )


def deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").select(
        e.alias("deploy_id"), F.concat(F.lit("repo"), (F.col("user_id") % 25).cast("string")).alias("repo"), F.col("ts").alias("triggered_at"),
        F.when(e % 9 == 4, "failure").otherwise("success").alias("status"), F.concat(F.lit("c"), (e % 1500 + 1).cast("string")).alias("git_sha"),
    )


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits of the deployment period: views and errors of the event table."""
    return table(spark, sf_dir, "events").where("event_type in ('view', 'error')").select(
        F.col("event_id").alias("id"), F.concat(F.lit("repo"), (F.col("user_id") % 25).cast("string")).alias("repository"), F.col("ts").alias("ts"),
        F.when(F.col("event_type") == "error", "hotfix: patch outage").otherwise("feat: next step").alias("message"), (F.col("event_id") % 13 == 5).alias("is_merge"),
    )


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'error'").select(
        F.col("event_id").alias("incident_id"), F.concat(F.lit("repo"), (F.col("user_id") % 25).cast("string")).alias("repo"), F.col("ts").alias("detected_at"),
        F.when(F.col("event_id") % 6 != 0, F.col("ts") + _seconds(F.col("event_id") * 37 % 90000)).alias("resolved_at"),
    )


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    created = F.col("o_orderdate") + _seconds(k % 86400)
    state = F.when(k % 9 == 1, "canceled").when(k % 9 == 2, "duplicate").when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "started").otherwise("backlog")
    days = (k * 31) % 5000000
    return table(spark, sf_dir, "orders").select(
        k.alias("issue_id"), F.concat(F.lit("T"), (F.col("o_custkey") % 6).cast("string")).alias("team_key"), state.alias("state_type"), created.alias("created_at"),
        F.when(state.isin("completed", "started"), created + _seconds(F.floor(days / 3))).alias("started_at"), F.when(state == "completed", created + _seconds(days)).alias("completed_at"),
        F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey") % 40).alias("assignee_id"), F.when(k % 3 == 0, (k % 8).cast("double")).alias("estimate"),
        F.concat(F.when(k % 4 == 1, "[api] ").when(k % 4 == 2, "[ui][bug] ").otherwise(""), F.lit("task "), k.cast("string")).alias("title"),
    )


_CASES = " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MESSAGES))
PRELUDE = f"""
commits AS (SELECT o_orderkey AS id, 'c' || o_orderkey AS sha, o_custkey AS author_id, 'dev' || (o_custkey % 97) || '@example.com' AS author_email, 'Dev ' || (o_custkey % 101) AS author_name,
  o_orderdate + to_seconds(o_orderkey % 86400) AS ts, 'repo' || (o_orderkey % 25) AS repository,
  (CASE o_orderkey % 15 {_CASES} END) || CASE WHEN o_orderkey % 5 = 2 THEN ' (#' || o_orderkey || ')' ELSE '' END AS message,
  CAST(floor(o_totalprice / 500) AS BIGINT) AS insertions, CAST(floor(o_totalprice / 900) AS BIGINT) AS deletions, o_orderkey % 7 + 1 AS files_changed,
  o_orderkey % 15 = 10 AS is_merge, o_orderkey % 4 = 0 AS ticketed, o_orderkey % 11 = 3 AS is_ai_assisted FROM orders),
files AS (SELECT l_orderkey AS commit_id, lower(replace(p_type, ' ', '/')) || '/f' || (p_partkey % 50) || CASE WHEN l_linenumber = 7 THEN '_test.rs' ELSE '.rs' END AS path,
  CAST(trunc(l_quantity) AS BIGINT) AS insertions, CAST(round(l_discount * 100) AS BIGINT) AS deletions FROM lineitem JOIN part ON l_partkey = p_partkey),
pull_requests AS (SELECT o_orderkey AS pr_number, 'repo' || (o_orderkey % 25) AS repository, CASE WHEN o_custkey % 53 = 0 THEN '' ELSE 'dev' || (o_custkey % 97) END AS author,
  CASE o_orderstatus WHEN 'F' THEN 'merged' WHEN 'O' THEN 'open' ELSE 'closed' END AS state, o_orderdate + to_seconds(o_orderkey % 86400) AS created_at,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_seconds(o_orderkey % 86400) + to_seconds((o_orderkey * 7919) % 3000000 - 20000) END AS merged_at FROM orders),
deployments AS (SELECT event_id AS deploy_id, 'repo' || (user_id % 25) AS repo, ts AS triggered_at, CASE WHEN event_id % 9 = 4 THEN 'failure' ELSE 'success' END AS status, 'c' || (event_id % 1500 + 1) AS git_sha FROM events WHERE event_type = 'purchase'),
activity AS (SELECT event_id AS id, 'repo' || (user_id % 25) AS repository, ts, CASE WHEN event_type = 'error' THEN 'hotfix: patch outage' ELSE 'feat: next step' END AS message, event_id % 13 = 5 AS is_merge FROM events WHERE event_type IN ('view', 'error')),
incidents AS (SELECT event_id AS incident_id, 'repo' || (user_id % 25) AS repo, ts AS detected_at, CASE WHEN event_id % 6 <> 0 THEN ts + to_seconds(event_id * 37 % 90000) END AS resolved_at FROM events WHERE event_type = 'error'),
issues0 AS (SELECT *, o_orderdate + to_seconds(o_orderkey % 86400) AS c, (o_orderkey * 31) % 5000000 AS d,
  CASE WHEN o_orderkey % 9 = 1 THEN 'canceled' WHEN o_orderkey % 9 = 2 THEN 'duplicate' WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'started' ELSE 'backlog' END AS st FROM orders),
issues AS (SELECT o_orderkey AS issue_id, 'T' || (o_custkey % 6) AS team_key, st AS state_type, c AS created_at, CASE WHEN st IN ('completed', 'started') THEN c + to_seconds(CAST(floor(d / 3) AS BIGINT)) END AS started_at,
  CASE WHEN st = 'completed' THEN c + to_seconds(d) END AS completed_at, CASE WHEN o_custkey % 10 <> 0 THEN o_custkey % 40 END AS assignee_id, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 8 AS DOUBLE) END AS estimate,
  (CASE o_orderkey % 4 WHEN 1 THEN '[api] ' WHEN 2 THEN '[ui][bug] ' ELSE '' END) || 'task ' || o_orderkey AS title FROM issues0)
"""
