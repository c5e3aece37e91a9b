"""Issue-tracker statistics, entity resolution and evaluation of the classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.timefx import quarter, quarter_index, seconds
from ..sources import model
from ..sources.rounds import stored
from . import classify as cascade
from .numbering import numbered

#: People of one local part that a pairing of blocks takes from a side, so at most BLOCK squared pairs.
BLOCK = 512


def completions_per_quarter(spark, sf_dir):
    """By team and over all, in one pass."""
    rows = model.issues(spark, sf_dir).where("completed_at is not null").select("team_key", quarter("completed_at").alias("quarter_label"))
    both = rows.withColumn("team", F.explode(F.array("team_key", F.lit("(all)"))))
    return both.groupBy("team", "quarter_label").agg(F.count("*").alias("n"))


def stable_teams(spark, sf_dir):
    """Completions of the last four complete quarters against the four before; stable teams completed something in all eight."""
    rows = model.issues(spark, sf_dir).where("completed_at is not null").select("team_key", quarter_index("completed_at").alias("q"))
    last = rows.agg(F.max("q").alias("last"))  # one row
    rows = rows.crossJoin(F.broadcast(last)).where("q < last and q >= last - 8")
    prior, recent = F.sum(F.when(F.col("q") < F.col("last") - 4, 1).otherwise(0)), F.sum(F.when(F.col("q") >= F.col("last") - 4, 1).otherwise(0))
    return rows.groupBy("team_key").agg(prior.alias("prior"), recent.alias("recent"), F.when(prior == 0, F.lit(None).cast("double")).otherwise((recent - prior) * 100.0 / prior).alias("change_pct"), (F.countDistinct("q") == 8).alias("stable"))


def lead_by_year(spark, sf_dir):
    """Days from creation to completion: interpolated percentiles, to six decimals."""
    rows = model.issues(spark, sf_dir).where("completed_at is not null").withColumn("d", seconds("created_at", "completed_at") / 86400.0)
    return rows.groupBy(F.year("completed_at").cast("long").alias("y")).agg(F.count("*").alias("n"), *[F.round(F.percentile("d", p / 100), 6).alias(f"p{p}") for p in (50, 75, 90)])


def cancel_rate(spark, sf_dir):
    rows = model.issues(spark, sf_dir)
    count = lambda s: F.sum(F.when(F.col("state_type") == s, 1).otherwise(0))
    closed = count("completed") + count("canceled") + count("duplicate")
    return rows.groupBy(F.year("created_at").cast("long").alias("y")).agg(closed.alias("closed"), count("completed").alias("completed"), count("canceled").alias("canceled"), count("duplicate").alias("duplicate"), scoring.share(count("canceled"), closed).alias("cancel_pct"))


def title_tags(spark, sf_dir):
    lead = F.regexp_extract("title", r"^((?:\[[^\]]+\])*)", 1)
    rows = model.issues(spark, sf_dir).withColumn("tag", F.explode(F.regexp_extract_all(lead, F.lit(r"\[([^\]]+)\]"), 1)))
    return rows.groupBy("tag").agg(F.count("*").alias("n"))


def concentration(spark, sf_dir):
    """Share of assigned completions by the top one, three and five assignees of a team."""
    counts = model.issues(spark, sf_dir).where("state_type = 'completed' and assignee_id is not null").groupBy("team_key", "assignee_id").agg(F.count("*").alias("n"))
    counts = counts.withColumn("place", F.row_number().over(Window.partitionBy("team_key").orderBy(F.desc("n"), "assignee_id")))
    top = lambda k: (F.sum(F.when(F.col("place") <= k, F.col("n")).otherwise(0)) * 100.0 / F.sum("n")).alias(f"top{k}_pct")
    return counts.groupBy("team_key").agg(F.sum("n").alias("completions"), top(1), top(3), top(5))


def contributors_per_year(spark, sf_dir):
    return model.issues(spark, sf_dir).where("completed_at is not null").groupBy(F.year("completed_at").cast("long").alias("y")).agg(F.countDistinct("assignee_id").alias("contributors"))


def field_use(spark, sf_dir):
    rows = model.issues(spark, sf_dir)
    pct = lambda c, n: (F.sum(F.when(F.col(c).isNotNull(), 1).otherwise(0)) * 100.0 / F.count("*")).alias(n)
    return rows.groupBy("team_key").agg(F.count("*").alias("n"), pct("assignee_id", "assigned_pct"), pct("estimate", "estimated_pct"), pct("started_at", "started_pct"))


def closed_weekly(spark, sf_dir):
    """Keys closed by each assignee and team in a half-open window, as a sorted list."""
    rows = model.issues(spark, sf_dir).where("completed_at >= timestamp_ntz'1996-01-01' and completed_at < timestamp_ntz'1998-01-01' and assignee_id is not null")
    from ..functions.timefx import iso_week

    keys = F.array_join(F.transform(F.array_sort(F.collect_list("issue_id")), lambda k: k.cast("string")), ",")
    return rows.groupBy("assignee_id", "team_key", iso_week("completed_at").alias("week_label")).agg(F.count("*").alias("closed"), keys.alias("keys"))


def majority_author(spark, sf_dir):
    """The author with most file touches of each repository, ties to the smaller address."""
    rows = model.commits(spark, sf_dir).groupBy("repository", "author_email").agg(F.sum("files_changed").alias("n"))
    place = F.row_number().over(Window.partitionBy("repository").orderBy(F.desc("n"), "author_email"))
    return rows.withColumn("place", place).where("place = 1").select("repository", "author_email", "n")


def _people(spark, sf_dir):
    return model.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("domain"), F.concat(F.lit("dev"), (F.col("s_suppkey") * 7 % 60).cast("string")).alias("local"), F.concat(F.lit("Dev "), (F.col("s_suppkey") % 12).cast("string")).alias("name"))


def near_identities(spark, sf_dir):
    """Pairs of one domain whose local parts differ by one or two edits."""
    return near_people(_people(spark, sf_dir))


def _shorter(words):
    """The words, and each without any one of its characters."""
    return F.array_distinct(F.concat(words, F.flatten(F.transform(words, lambda s: F.transform(F.filter(F.sequence(F.lit(0), F.length(s)), lambda i: i > 0), lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1)))))))


def near_people(people: DataFrame) -> DataFrame:
    """id, other, edits, confidence of people (id, domain, local) of one domain with local parts one or two edits apart.

    Two words within two edits have a form in common after at most two deletions each, so distinct words of a domain meet on (domain, form), never all pairs,
    and are compared once, however many people have them. People are then paired by their words: a word's people in blocks of BLOCK, and a pair of blocks is a
    group of a join, so that words that many people have are spread over the tasks. A pair a row remains, as the result asks for each."""
    people = people.select("id", "domain", "local").where("id is not null").distinct()
    words = people.select("domain", "local").distinct()
    forms = words.select("domain", "local", F.explode(_shorter(_shorter(F.array("local")))).alias("form"))
    met = forms.join(forms.withColumnRenamed("local", "other_local"), ["domain", "form"]).where("local < other_local").select("domain", "local", "other_local").distinct()
    near = met.withColumn("edits", F.levenshtein("local", "other_local").cast("long")).where("edits between 1 and 2")
    placed = numbered(people.select("domain", "local", "id"), ["domain", "local"], ["id"], "_n")
    blocks = stored(placed.groupBy("domain", "local", F.floor((F.col("_n") - 1) / BLOCK).alias("_block")).agg(F.collect_list("id").alias("ids")))  # at most BLOCK ids
    first = blocks.select("domain", "local", F.col("ids").alias("_a"))
    second = blocks.select("domain", F.col("local").alias("other_local"), F.col("ids").alias("_b"))
    tasks = 4 * max(people.sparkSession.sparkContext.defaultParallelism, int(people.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = near.join(first, ["domain", "local"]).join(second, ["domain", "other_local"]).repartition(tasks)
    pairs = dealt.select("edits", F.explode("_a").alias("_x"), "_b").select("edits", "_x", F.explode("_b").alias("_y")).where("_x <> _y")
    return pairs.select(F.least("_x", "_y").alias("id"), F.greatest("_x", "_y").alias("other"), "edits", F.when(F.col("edits") == 1, 0.85).otherwise(0.78).alias("confidence"))


def same_names(spark, sf_dir):
    rows = _people(spark, sf_dir)
    return rows.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("keep"), F.countDistinct("domain").alias("domains")).where("n > 1").withColumn("confidence", F.when(F.col("domains") == 1, 0.95).otherwise(0.90))


def alias_cascade(spark, sf_dir):
    """Each commit author by address, else by name, else unmatched; the first hit wins."""
    authors = model.commits(spark, sf_dir).select("author_email", "author_name").distinct()
    by_email = model.commits(spark, sf_dir).where("author_id % 3 = 0").groupBy("author_email").agg(F.min("author_id").alias("e"))
    by_name = model.commits(spark, sf_dir).where("author_id % 5 = 1").groupBy("author_name").agg(F.min("author_id").alias("m"))
    out = authors.join(by_email, "author_email", "left").join(by_name, "author_name", "left")
    return out.select("author_email", "author_name", F.coalesce("e", "m").alias("author_id"), F.when(F.col("e").isNotNull(), "email").when(F.col("m").isNotNull(), "name").otherwise("none").alias("how"))


def _judged(spark, sf_dir):
    rows = cascade.classify(model.commits(spark, sf_dir).where("not is_merge"))
    return rows.withColumn("label", F.when(F.col("id") % 8 == 3, "maintenance").otherwise(F.col("category")))


def precision_by_rule(spark, sf_dir):
    hits = F.sum(F.when(F.col("label") == F.col("category"), 1).otherwise(0))
    rows = _judged(spark, sf_dir).groupBy("rule_id").agg(F.count("*").alias("n"), hits.alias("hits"))
    low, high = scoring.wilson(F.col("hits"), F.col("n"))
    return rows.select("rule_id", "n", "hits", low.alias("low"), high.alias("high"))


def confusion(spark, sf_dir):
    return _judged(spark, sf_dir).groupBy(F.col("category").alias("predicted"), "label").agg(F.count("*").alias("n"))


def kappa(spark, sf_dir):
    """Cohen's kappa of label and prediction; null when chance agrees always."""
    cells = confusion(spark, sf_dir)
    total = cells.agg(F.sum("n").alias("t"), F.sum(F.when(F.col("predicted") == F.col("label"), F.col("n")).otherwise(0)).alias("same"))
    p = cells.groupBy(F.col("predicted").alias("k")).agg(F.sum("n").alias("a"))
    q = cells.groupBy(F.col("label").alias("k")).agg(F.sum("n").alias("b"))
    chance = p.join(q, "k").agg(F.sum(F.col("a") * F.col("b")).alias("c"))
    out = total.crossJoin(F.broadcast(chance))  # two single rows
    po, pe = F.col("same") / F.col("t"), F.col("c") / (F.col("t") * F.col("t"))
    return out.select(po.alias("observed"), pe.alias("expected"), F.when(pe >= 1, F.lit(None).cast("double")).otherwise((po - pe) / (1 - pe)).alias("kappa"))


def allocation(spark, sf_dir, total: int = 1000):
    """Largest-remainder shares of a sample over the repositories."""
    rows = model.commits(spark, sf_dir).groupBy("repository").agg(F.count("*").alias("n"))
    rows = rows.withColumn("all", F.sum("n").over(Window.partitionBy()))  # one row a repository
    rows = rows.withColumn("base", F.floor(F.col("n") * total / F.col("all"))).withColumn("rest", F.col("n") * total % F.col("all"))
    left = total - F.sum("base").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.desc("rest"), "repository"))
    return rows.withColumn("left", left).withColumn("place", place).select("repository", "n", (F.col("base") + F.when(F.col("place") <= F.col("left"), 1).otherwise(0)).alias("share"))


def unlinked(spark, sf_dir):
    """Authors of pull requests who never committed, and committers without a pull request."""
    c = model.commits(spark, sf_dir).select(F.split_part("author_email", F.lit("@"), F.lit(1)).alias("who")).distinct()
    p = model.pull_requests(spark, sf_dir).where("author <> ''").select(F.col("author").alias("who")).distinct()
    return p.join(c, "who", "left_anti").withColumn("side", F.lit("pr only")).union(c.join(p, "who", "left_anti").withColumn("side", F.lit("commit only")))


def identities(spark, sf_dir):
    c = model.commits(spark, sf_dir).select(F.split_part("author_email", F.lit("@"), F.lit(1)).alias("who"))
    return c.union(model.pull_requests(spark, sf_dir).where("author <> ''").select("author")).distinct()


def page_text(spark, sf_dir):
    from ..functions.textfx import without_tags, word_count

    return model.table(spark, sf_dir, "pages").select("page_id", F.length(without_tags(F.col("html"))).cast("long").alias("n_chars"), word_count(without_tags(F.col("html"))).alias("words"))


def redacted(spark, sf_dir):
    from ..functions.textfx import redact_emails

    return model.table(spark, sf_dir, "documents").select("doc_id", F.sha2(redact_emails(F.col("text")), 256).alias("text_sha256"))


def freshness(spark, sf_dir):
    rows = model.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.max("ts").alias("latest"))
    age = F.timestamp_diff("SECOND", F.col("latest"), F.lit("2024-02-15").cast("timestamp_ntz")) / 3600.0
    return rows.select("event_type", "n", age.alias("age_hours"), (age > 48).alias("stale"))
