"""Links between commits, pull requests and tickets; marks, votes and words of messages; identity suggestions; selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import linking
from ..functions.similarity import jaro_winkler
from ..sources import model
from . import classify as cascade

#: Words that decide a category: id, category, word, priority, confidence.
WORDS = [("null-check", "bugfix", "null check", 90, 0.9), ("planner", "performance", "planner", 80, 0.85), ("readme", "documentation", "readme", 80, 0.85), ("parser", "refactor", "parser", 80, 0.85), ("build", "ci", "build", 70, 0.8), ("add", "feature", "add", 60, 0.8), ("error", "bugfix", "error", 60, 0.75)]
#: Categories of ticket types.
ISSUE_TYPES = {"story": "feature", "bug": "bugfix", "defect": "bugfix", "task": "maintenance", "sub-task": "maintenance", "epic": "feature", "improvement": "feature", "tech debt": "refactor", "spike": "maintenance", "test": "test", "documentation": "documentation"}
#: Categories of path prefixes.
PATHS = [("economy", "maintenance"), ("economy/f1.rs", "content"), ("standard", "feature"), ("promo", "integrations"), ("small", "platform"), ("small/plated", "refactor")]
TRAILERS = ["Co-Authored-By: Claude <x@y.z>", "co-authored-by: Ann Lee <ann@x.org>", "Co-authored-by: aider (x) <a@b.c>", "Signed-off-by: A", "X-AI-Model: m-1", "Co-authored-by: GitHub Copilot <c@g.h>"]


def _choice(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def _sources(spark, sf_dir) -> DataFrame:
    k = F.col("id")
    s = k.cast("string")
    branch = F.when(k % 6 == 0, F.concat(F.lit("refs/heads/feature/PROJ-"), s, F.lit("-thing"))).when(k % 6 == 1, "fix/ADR-0029-followup").when(k % 6 == 2, F.concat(F.lit("fix/"), s, F.lit("-harvest"))).when(k % 6 == 3, F.concat(F.lit("ENG-"), s)).when(k % 6 == 4, "main").otherwise(F.concat(F.lit("team/x/OPS-"), s, F.lit("_b")))
    body = F.when(k % 4 == 0, F.concat(F.lit("Closes #"), s)).when(k % 4 == 1, F.concat(F.lit("see #"), s)).when(k % 4 == 2, F.concat(F.lit("Rework. fixed  #"), s, F.lit(" too")))
    title = F.when(k % 7 == 0, "fix(x): [PROJ-9] title").when(k % 7 == 1, "UTF-8 AB#17 title").otherwise("plain title")
    return model.commits(spark, sf_dir).select("id", "repository", "message", branch.alias("branch"), title.alias("title"), body.alias("body"))


def ticket_links(spark, sf_dir):
    """The key of each commit, from its subject, else the branch, else the title, else what the body closes."""
    found = [("commit", linking.subject_ticket(F.col("message"))), ("branch", linking.branch_ticket(F.col("branch"))), ("title", linking.subject_ticket(F.col("title"))), ("body", linking.closing_ticket(F.col("body")))]
    first = F.coalesce(*[F.when(key.isNotNull(), F.struct(key.alias("key"), F.lit(name).alias("source"))) for name, key in found])
    return _sources(spark, sf_dir).select("id", first.alias("f")).select("id", F.col("f.key").alias("ticket"), F.col("f.source").alias("source"))


def ticketed_stats(spark, sf_dir):
    """By source, and in all: commits and their share."""
    rows = ticket_links(spark, sf_dir).groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.count("*").alias("n"))
    return rows.select("source", "n", (F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy())).alias("pct"))  # one row a source


def commit_pull_requests(spark, sf_dir):
    """Merged pull requests list their commits; the first names a commit's title, the last owns it."""
    k = F.col("pr_number")
    listed = model.pull_requests(spark, sf_dir).where("state = 'merged'").select(k, F.explode(F.array_distinct(F.array(k, k + 1, k * 2))).alias("commit_id"))
    both = listed.groupBy("commit_id").agg(F.min("pr_number").alias("first_pr"), F.max("pr_number").alias("last_pr"), F.count("*").alias("pull_requests"))
    return both.join(model.commits(spark, sf_dir).select(F.col("id").alias("commit_id")), "commit_id", "left_semi")


def _items(spark, sf_dir) -> DataFrame:
    k = F.col("issue_id")
    rows = model.issues(spark, sf_dir)
    return rows.where(k % 2 == 1).select(F.concat(F.lit("ENG-"), k.cast("string")).alias("ticket"), F.lit("linear").alias("tracker"), k).union(
        rows.where(k % 3 == 0).select(F.concat(F.lit("PROJ-"), k.cast("string")), F.lit("jira"), k)).union(rows.where(k % 5 == 2).select(F.concat(F.lit("#"), k.cast("string")), F.lit("github"), k))


def correlation_counts(spark, sf_dir):
    """Commits and tickets, linked and not."""
    links, items = ticket_links(spark, sf_dir), _items(spark, sf_dir)
    pairs = links.join(items, "ticket")
    linked = links.join(pairs.select("id").distinct().withColumn("hit", F.lit(1)), "id", "left").agg(F.count("*").alias("all"), F.count("hit").alias("hit"))
    used = items.join(pairs.select("ticket", "tracker").distinct().withColumn("hit", F.lit(1)), ["ticket", "tracker"], "left").groupBy("tracker").agg(F.count("*").alias("all"), F.count("hit").alias("hit"))
    return linked.select(F.lit("commits").alias("what"), F.col("all").alias("n"), F.col("hit").alias("linked")).union(used.select("tracker", "all", "hit"))


def issue_type_categories(spark, sf_dir):
    """Categories by the type of the first ticket of each commit (by tracker, then ticket)."""
    kind = _choice(["Story", "bug", "Task", "Tech Debt", "spike", "oddity"], F.col("issue_id"))
    first = ticket_links(spark, sf_dir).join(_items(spark, sf_dir).withColumn("kind", kind), "ticket").groupBy("id").agg(F.min_by("kind", F.struct("tracker", "issue_id")).alias("kind"))
    return first.groupBy(cascade._lookup(ISSUE_TYPES, F.lower("kind"), "(none)").alias("category")).agg(F.count("*").alias("n"))


def authorship_marks(spark, sf_dir):
    """The tool that each commit names, how it took part and where it is named."""
    k = F.col("id")
    message = F.when(k % 3 == 0, F.col("message")).otherwise(F.concat("message", F.lit("\n\nBody text.\n"), _choice(TRAILERS, F.floor(k / 3)), F.lit("\n")))
    email = F.when(k % 50 == 7, "devin-ai-integration[bot]@users.x").otherwise(F.col("author_email"))
    rows = model.commits(spark, sf_dir).select("id", message.alias("message"), email.alias("email"))
    rows = rows.select("id", linking.mark(F.col("message"), F.col("email")).alias("m"))
    return rows.select("id", "m.tool", "m.mode", "m.method")


def weighted_votes(spark, sf_dir):
    """The one best category of each message, or none, with its confidence of at most 0.95."""
    rows = linking.voted(model.commits(spark, sf_dir).select("id", "message", "is_merge"))
    points = F.col("vote.points")
    return rows.select("id", F.col("vote.category").alias("category"), (F.when(points > 95, 95).otherwise(points) / F.lit(100.0)).alias("confidence"))


def exact_words(spark, sf_dir):
    """The whole word of highest priority in each message, the earliest on a tie; and its confidence."""
    text = F.lower("message")
    rules = [F.when(text.rlike(rf"\b{w}\b"), F.struct(F.lit(-p).alias("p"), F.length(F.regexp_extract(text, rf"(?s)^(.*?)\b{w}\b", 1)).alias("at"), F.lit(i).alias("rule_id"), F.lit(c).alias("category"), F.lit(x).alias("confidence"))) for i, c, w, p, x in WORDS]
    best = F.array_min(F.array_compact(F.array(*rules)))
    return model.commits(spark, sf_dir).select("id", best.alias("b")).where("b is not null").select("id", "b.rule_id", "b.category", "b.confidence")


def path_map(spark, sf_dir):
    """Touches by category of the longest mapped prefix; a path's own prefixes are looked up, so nothing is compared pairwise."""
    parts = F.split("path", "/")
    own = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    paths = model.files(spark, sf_dir).groupBy("path").agg(F.count("*").alias("n"))
    hits = paths.select("path", own.alias("prefix")).join(spark.createDataFrame(PATHS, "prefix string, category string").hint("broadcast"), "prefix")
    best = hits.groupBy("path").agg(F.max_by("category", F.length("prefix")).alias("category"))
    return paths.join(best, "path", "left").groupBy(F.coalesce("category", F.lit("(unmapped)")).alias("category")).agg(F.sum("n").alias("touches"), F.count("*").alias("paths"))


def excerpts(spark, sf_dir, most: int = 200):
    """Each text without addresses, cut to 200 characters with an ellipsis; as a digest."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<email>")
    cut = F.when(F.length(text) > most, F.concat(F.substr(text, F.lit(1), F.lit(most)), F.lit("…"))).otherwise(text)
    return model.table(spark, sf_dir, "documents").select("doc_id", F.length(cut).alias("n_chars"), F.sha2(cut, 256).alias("excerpt_sha256"))


def _addresses(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    local = F.concat(F.lit("dev"), (k % 37).cast("string"))
    email = F.when(k % 5 == 0, F.concat(local, F.lit("@host"), (k % 7).cast("string"), F.lit(".local"))).when(k % 5 == 1, F.concat((k % 1000).cast("string"), F.lit("+"), local, F.lit("@users.noreply.github.com"))).when(k % 5 == 2, F.concat(local, F.lit("@exmaple.com"))).otherwise(F.concat(local, F.lit("@example.com")))
    return model.table(spark, sf_dir, "customer").select(email.alias("email")).distinct().select("email", F.substring_index("email", "@", 1).alias("local"), F.substring_index("email", "@", -1).alias("domain"))


def identity_suggestions(spark, sf_dir, home: str = "example.com"):
    """Addresses of a machine, a forge login or a mistyped domain, each with the best known address of the same person.

    Suggestions meet on an equal local part, so the join is by key. Only the highest confidence of a pair stays."""
    rows = _addresses(spark, sf_dir)
    login = F.when(F.col("domain") == "users.noreply.github.com", F.element_at(F.split("local", r"\+"), -1))
    edits = F.levenshtein("domain", F.lit(home))
    why = F.when(F.col("domain").endswith(".local"), "machine").when(login.isNotNull(), "login").when((edits > 0) & (edits <= 2), "typo")
    odd = rows.withColumn("reason", why).where("reason is not null").select(F.col("email").alias("src"), F.coalesce(login, "local").alias("local"), F.when(why == "typo", 0.88).otherwise(0.90).alias("confidence"), "reason")
    pairs = odd.join(rows.select("local", F.col("email").alias("dst"), "domain"), "local").where((F.col("src") != F.col("dst")) & ((F.col("domain") == home) | (F.col("reason") == "login")))
    return pairs.groupBy("src", "dst").agg(F.max(F.struct("confidence", "reason")).alias("b")).select("src", "dst", "b.confidence", "b.reason")


def normalised_members(spark, sf_dir, least: float = 0.82):
    """The best member for each spelling after dots, hyphens and underscores are taken as blanks; members of a region meet by key."""
    n = F.col("n_nationkey")
    members = model.table(spark, sf_dir, "nation").select("n_regionkey", F.concat(F.lit("Dev "), F.lower("n_name")).alias("member"), n)
    k = F.col("s_suppkey")
    base = F.concat(F.lit("dev"), _choice([".", "-", "_"], k), F.translate(F.lower("n_name"), "_", "."), F.when(k % 4 == 3, "x").otherwise(""))
    seen = model.table(spark, sf_dir, "supplier").join(model.table(spark, sf_dir, "nation"), F.col("s_nationkey") == n).select("n_regionkey", base.alias("local")).distinct()
    score = F.round(jaro_winkler(linking.normalised(F.col("local")), linking.normalised(F.col("member"))), 9)
    scored = seen.join(members, "n_regionkey").withColumn("score", score).where(F.col("score") >= least)
    best = scored.groupBy("n_regionkey", "local").agg(F.min(F.struct((-F.col("score")).alias("s"), "member")).alias("b"))
    return best.select(F.col("n_regionkey").alias("domain"), "local", "b.member", (-F.col("b.s")).alias("score"))


def review_candidates(spark, sf_dir, most: int = 50):
    """Pull requests never checked or changed since, newest change first."""
    k = F.col("pr_number")
    rows = model.pull_requests(spark, sf_dir).withColumn("updated_at", F.coalesce("merged_at", "created_at"))
    rows = rows.withColumn("checked_at", F.when(k % 3 != 0, F.col("created_at") + F.make_dt_interval((k % 30).cast("int"))))
    return rows.where("checked_at is null or updated_at > checked_at").orderBy(F.desc("updated_at"), F.desc("pr_number")).limit(most).select("pr_number", "repository", "updated_at")


def picked_commits(spark, sf_dir, most: int = 5):
    """Per author: the newest bugfix, feature and refactoring, then the largest of the rest (newest on ties), five in all."""
    rows = cascade.classify(model.commits(spark, sf_dir).where("not is_merge")).withColumn("size", F.col("insertions") + F.col("deletions"))
    rank = F.when(F.col("category") == "bugfix", 1).when(F.col("category") == "feature", 2).when(F.col("category") == "refactor", 3)
    first = F.row_number().over(Window.partitionBy("author_email", "category").orderBy(F.desc("ts"), F.desc("id"))) == 1
    rows = rows.withColumn("turn", F.when(first, rank)).withColumn("turn", F.coalesce("turn", F.lit(9)))
    order = [F.col("turn"), F.when(F.col("turn") == 9, F.col("size")).desc_nulls_last(), F.desc("ts"), F.desc("id")]
    place = F.row_number().over(Window.partitionBy("author_email").orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= most).select("author_email", "place", "id", "category", "size")
