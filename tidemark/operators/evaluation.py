"""Judging the cascade on a stratified sample, and findings that recur over periods."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import model
from ..sources.rounds import stored
from . import classify as cascade
from . import rule_engine
from .graphs import leaders
from .linking import ticket_links

Z = 1.959963984540054

#: Settings of the cascade that are tables by commit, so that equal messages may differ.
BY_SHA = frozenset({"overrides", "mapped", "signals"})


def stratum(method: Column, rule: Column, category: Column, confidence: Column) -> Column:
    """One of nine: the catch-all rule before unknown, then by tier, patterns by confidence too."""
    regex = method == "regex"
    return (
        F.when(rule == "catch-all", "catch_all").when(rule.isNull() | F.lower(category).isin("uncategorized", "unknown"), "unknown").when(method == "exact", "exact")
        .when(regex & (confidence >= 0.9), "regex_high").when(regex & confidence.between(0.55, 0.7), "regex_mid").when(regex, "regex_other")
        .when(method.isin("weighted_sum", "fuzzy"), method).otherwise("other")
    )


def _population(spark, sf_dir, weeks: int = 100) -> DataFrame:
    """Commits but merges of the last weeks before the newest."""
    rows = model.commits(spark, sf_dir).where("not is_merge")
    newest = rows.agg(F.max("ts").alias("newest"))
    rows = rows.join(F.broadcast(newest), F.col("ts") >= F.col("newest") - F.expr(f"interval {weeks * 7} days"))  # one row
    rows = cascade.classify(rows)
    return rows.withColumn("stratum", stratum(F.col("method"), F.col("rule_id"), F.col("category"), F.col("confidence")))


def strata(spark, sf_dir):
    rows = _population(spark, sf_dir)
    return rows.groupBy("stratum").agg(F.count("*").alias("n"), F.min("confidence").alias("least"), F.max("confidence").alias("most"))


def water_fill(sizes: DataFrame, total: int) -> DataFrame:
    """Adds ``share``: strata (stratum, n) that are smaller than an equal share are taken whole, the others split what is left; a rest goes by name.

    Going from small to large, stratum i of k is taken whole if n times the strata left fits in what is left. One row a stratum, so a window without keys is small."""
    order = Window.orderBy("n", "stratum")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    over = Window.partitionBy()
    rows = sizes.withColumn("whole", F.col("n") * (F.count("*").over(over) - F.row_number().over(order) + 1) <= F.lit(total) - before)
    left = F.lit(total) - F.sum(F.when(F.col("whole"), F.col("n")).otherwise(0)).over(over)
    rows = rows.withColumn("left", left).withColumn("open", F.count_if(~F.col("whole")).over(over)).withColumn("turn", F.row_number().over(Window.partitionBy("whole").orderBy("stratum")))
    part = F.floor(F.col("left") / F.greatest("open", F.lit(1))).cast("long")
    return rows.select("stratum", "n", F.when(F.col("whole"), F.col("n")).otherwise(part + F.when(F.col("turn") <= F.col("left") % F.greatest("open", F.lit(1)), 1).otherwise(0)).alias("share"))


def allocation_by_stratum(spark, sf_dir, total: int = 200):
    return water_fill(_population(spark, sf_dir).groupBy("stratum").agg(F.count("*").alias("n")), total)


def stratified_draw(spark, sf_dir, total: int = 200, seed: str = "s1", by_author: int = 40):
    """The sample: in each stratum the first commits by a salted hash, at most 40 of an author. Ranks are cut to the total before rows meet their share."""
    rows = _population(spark, sf_dir).select("sha", "author_email", "stratum", F.md5(F.concat(F.lit(seed), F.lit(":"), "sha")).alias("hash"))
    rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy("stratum", "author_email").orderBy("hash", "sha"))).where(F.col("turn") <= by_author)
    shares = water_fill(rows.groupBy("stratum").agg(F.count("*").alias("n")), total)
    top = rows.withColumn("place", F.row_number().over(Window.partitionBy("stratum").orderBy("hash", "sha"))).where(F.col("place") <= total)
    return top.join(shares, "stratum").where(F.col("place") <= F.col("share")).select("stratum", "place", "sha", "author_email")


def _judged(spark, sf_dir) -> DataFrame:
    """Strata with their size, the number judged (every ninth) and how many were right."""
    right = (F.col("id") % 8 != 3) | (F.col("category") == "maintenance")
    return _population(spark, sf_dir).groupBy("stratum").agg(F.count("*").alias("population"), F.count_if(F.col("id") % 9 == 0).alias("n"), F.count_if((F.col("id") % 9 == 0) & right).alias("correct"))


def stratum_accuracy(spark, sf_dir):
    """Accuracy weighted by the size of the strata that were judged, and its interval."""
    over = Window.partitionBy()  # one row a stratum
    rows = _judged(spark, sf_dir).withColumn("all", F.sum("population").over(over)).where("n > 0").withColumn("w", F.col("population") / F.sum("population").over(over)).withColumn("p", F.col("correct") / F.col("n"))
    one = rows.agg(F.sum(F.col("w") * F.col("p")).alias("e"), F.sqrt(F.sum(F.col("w") * F.col("w") * F.col("p") * (1 - F.col("p")) / F.col("n"))).alias("s"), F.sum("population").alias("c"), F.max("all").alias("all"))
    return one.where("c > 0").select(F.round("e", 9).alias("estimate"), F.round(F.greatest(F.col("e") - Z * F.col("s"), F.lit(0.0)), 9).alias("low"), F.round(F.least(F.col("e") + Z * F.col("s"), F.lit(1.0)), 9).alias("high"), (F.col("c") / F.col("all")).alias("covered"))


def merge_scaling(spark, sf_dir):
    """Each stratum less its share of merges, as seen in every seventh commit."""
    rows = cascade.classify(model.commits(spark, sf_dir))
    rows = rows.groupBy(stratum(F.col("method"), F.col("rule_id"), F.col("category"), F.col("confidence")).alias("stratum")).agg(F.count("*").alias("population"), F.count_if(F.col("id") % 7 == 0).alias("n"), F.count_if((F.col("id") % 7 == 0) & F.col("is_merge")).alias("merges"))
    gone = F.when(F.col("n") > 0, F.least(F.floor(F.col("population") * F.col("merges") / F.greatest("n", F.lit(1)) + 0.5), "population")).otherwise(0).cast("long")
    return rows.select("stratum", "population", gone.alias("removed"), (F.col("population") - gone).alias("kept"))


def ticket_coverage(spark, sf_dir):
    """Pull requests of each author with and without a ticket."""
    pulls = model.pull_requests(spark, sf_dir).select(F.col("pr_number").alias("id"), "author")
    rows = pulls.join(ticket_links(spark, sf_dir), "id", "left").groupBy("author").agg(F.count("*").alias("n"), F.count("ticket").alias("linked"), F.count_if(F.col("source") == "branch").alias("by_branch"))
    return rows.select("author", "n", "linked", "by_branch", (F.col("linked") * 100.0 / F.col("n")).alias("pct"))


def repredict(sample: DataFrame, commits: DataFrame, rules: list[tuple] | None = None, **settings) -> DataFrame:
    """The sample with its four prediction columns (category, subcategory, confidence, method) replaced by the cascade's verdict of today.

    Rows are looked up by (sha, repository); all other columns stay. Each distinct message is classified once, unless a setting goes by commit. Adds ``rules_sha256``, the hash of the rules in use. A sample that is
    empty or holds a commit that isn't known is refused, as its figures would be of other rows."""
    predicted = ["category", "subcategory", "confidence", "method"]
    lookup = commits.dropDuplicates(["sha", "repository"]).select("sha", "repository", F.coalesce("message", F.lit("")).alias("_message"), F.col("is_merge").alias("_is_merge"), F.lit(True).alias("_known"))
    kept = sample.drop(*predicted)
    asked = stored(kept.join(lookup, ["sha", "repository"], "left"))  # looked up once, for the checks and the verdicts
    if asked.isEmpty():
        raise ValueError("the sample holds no rows")
    if not asked.where("_known is null").isEmpty():
        raise ValueError("the sample holds commits that are not known")
    if BY_SHA.isdisjoint(settings):
        session = sample.sparkSession
        tasks = max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))  # all computation, so no fewer tasks than cores
        kinds = asked.select("_message", "_is_merge").distinct().repartition(tasks)
        told = rule_engine.classify(kinds.select(F.lit(None).cast("string").alias("sha"), F.col("_message").alias("message"), F.col("_is_merge").alias("is_merge")), rules, **settings)
        told = stored(told.select(F.col("message").alias("_text"), F.col("is_merge").alias("_merge"), *predicted))
        rows = asked.join(told, (F.col("_message") == F.col("_text")) & F.col("_is_merge").eqNullSafe(F.col("_merge"))).drop("_text", "_merge")
    else:
        found = asked.select("sha", "repository", F.col("_message").alias("message"), F.col("_is_merge").alias("is_merge")).dropDuplicates(["sha", "repository"])
        rows = asked.join(rule_engine.classify(found, rules, **settings).select("sha", "repository", *predicted), ["sha", "repository"])
    rows = rows.drop("_message", "_is_merge", "_known")
    used = repr(rule_engine.RULES if rules is None else rules) + repr(sorted(settings.items(), key=lambda s: s[0]))
    return rows.withColumn("rules_sha256", F.lit(hashlib.sha256(used.encode()).hexdigest()))


def repredicted(spark, sf_dir):
    """The short classification of all commits beside the whole cascade's: how many rows change."""
    commits = model.commits(spark, sf_dir)
    sample = cascade.former(commits).select("sha", "repository", "category", F.col("category").alias("before"))
    rows = repredict(sample, commits).groupBy("before", F.col("category").alias("after")).agg(F.count("*").alias("n"))
    return rows.withColumn("changed", ~F.col("before").eqNullSafe(F.col("after")))


def tokens(text) -> Column:
    """Runs of letters and digits in lower case, repeats kept."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def alike(a: Column, b: Column) -> Column:
    """Tokens of a that b has, over the others of both; repeats in a count. Two empty lists are alike, one is like nothing."""
    both = F.size(F.filter(a, lambda t: F.array_contains(b, t)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def like_pairs(texts: DataFrame, least: float = 0.7) -> DataFrame:
    """(a, b), a < b, of texts (id, profile, tokens) of one profile that are alike to ``least``: joined on a shared token, never all pairs.

    Tokens are ordered by how many texts of the profile have them, rarest first. A list without repeats can miss at most 1 - least of its
    own places, and so can the other, so both have a token in common before that many places from the end. A list with repeats may be like
    a shorter one, so it misses at most what its own length allows and meets the other on any token. Empty lists are alike: each is paired
    with the first of its profile, which is all that leaders need."""
    words = texts.where(F.size("tokens") > 0).select("id", "profile", F.size("tokens").alias("size"), F.explode("tokens").alias("token")).groupBy("id", "profile", "size", "token").agg(F.count("*").alias("times"))
    common = words.groupBy("profile", "token").agg(F.count("*").alias("texts"))
    order = Window.partitionBy("id").orderBy("texts", "token")  # one text
    words = words.join(common, ["profile", "token"]).withColumn("before", F.sum("times").over(order) - F.col("times")).withColumn("place", F.row_number().over(order) - 1).withColumn("kinds", F.count("*").over(Window.partitionBy("id")))
    repeats = F.col("kinds") < F.col("size")
    need = F.when(repeats, F.ceil(F.lit(least / (1 + least) - 1e-9) * (F.col("size") + 1))).otherwise(F.ceil(F.lit(least - 1e-9) * F.col("size")))
    a = words.where(F.col("before") <= F.col("size") - need).select("profile", "token", F.col("id").alias("a"), repeats.alias("repeats"))
    b = words.select("profile", "token", F.col("id").alias("b"), (F.col("place") <= F.col("kinds") - F.ceil(F.lit(least - 1e-9) * F.col("size"))).alias("early"))
    met = a.join(b, ["profile", "token"]).where("a < b and (repeats or early)").select("a", "b").distinct()
    lists = texts.select("id", "tokens")
    met = met.join(lists.select(F.col("id").alias("a"), F.col("tokens").alias("a_tokens")), "a").join(lists.select(F.col("id").alias("b"), F.col("tokens").alias("b_tokens")), "b")
    empty = texts.where(F.size("tokens") == 0)
    first = empty.groupBy("profile").agg(F.min("id").alias("a"))
    return met.where(alike(F.col("a_tokens"), F.col("b_tokens")) >= least).select("a", "b").union(empty.join(first, "profile").where("a < id").select("a", F.col("id").alias("b")))


def tagged(findings: DataFrame, least: float = 0.7) -> DataFrame:
    """Adds leader and trend to findings (id, profile, period, text, confidence), ids in the order of time.

    The first finding of a profile that a later one is like leads it. Equal texts are compared once, and different ones only if they share
    a rare enough token. A cluster in the profile's last period is worsening if its last
    confidence is more than 0.1 above its first, recurring if it is in an earlier period too, else new; a cluster that isn't is resolved."""
    texts = findings.groupBy("profile", F.coalesce("text", F.lit("")).alias("text")).agg(F.min("id").alias("id")).withColumn("tokens", tokens("text"))
    lead = texts.join(leaders(texts, like_pairs(texts, least)), "id").select("profile", "text", "leader")
    rows = findings.withColumn("text", F.coalesce("text", F.lit(""))).join(lead, ["profile", "text"])
    last = findings.groupBy("profile").agg(F.max_by("period", "id").alias("last"))
    rows = rows.join(last, "profile")
    facts = rows.groupBy("leader").agg(F.max(F.col("period") == F.col("last")).alias("now"), F.max(F.col("period") != F.col("last")).alias("earlier"), (F.max_by("confidence", "id") > F.min_by("confidence", "id") + 0.1).alias("up"))
    trend = F.when(F.col("now") & F.col("earlier") & F.col("up"), "worsening").when(F.col("now") & F.col("earlier"), "recurring").when(F.col("now"), "new").otherwise("resolved")
    return rows.join(facts.select("leader", trend.alias("trend")), "leader").select("id", "profile", "period", "text", "confidence", "leader", "trend")


def finding_trends(spark, sf_dir):
    """Findings by profile, with parts as findings."""
    k = F.col("p_partkey")
    text = F.concat("p_name", F.lit(" in module m"), (k % 2).cast("string"), F.lit(" again today"))
    order = F.col("p_size") * 10000000 + k
    rows = model.table(spark, sf_dir, "part").select(order.alias("id"), F.col("p_brand").alias("profile"), F.floor(F.col("p_size") / 10).alias("period"), text.alias("text"), (F.col("p_retailprice") % 10 / 10).alias("confidence"))
    return tagged(rows).select("id", "profile", "leader", "trend")
