"""Work items as trackers export them: fields read from JSON of several providers, and links of attachments to pull requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import model

#: Where providers keep each field, tried in this order, and the keys of a person and of a parent.
REPORTER = ["$.fields.reporter", "$.fields.creator", "$.fields['System.CreatedBy']", "$.user", "$.creator", "$.author"]
PERSON = ["displayName", "name", "login", "emailAddress"]
DESCRIPTION = ["$.fields.description", "$.fields['System.Description']", "$.description", "$.body"]
CREATED = ["$.fields.created", "$.fields['System.CreatedDate']", "$.created_at", "$.createdAt", "$.created"]
PARENT = ["$.fields.parent", "$.fields['System.Parent']", "$.parent"]
PARENT_KEYS = ["key", "identifier", "id", "number"]

#: Names (letters and digits in lower case) and ids of fields for story points, and the points that are plausible.
POINT_NAMES = ["storypoints", "storypointestimate", "estimate"]
POINT_IDS = ["customfield_10004", "customfield_10016", "customfield_13001", "customfield_13737"]
POINTS = (0.5, 40.0)

#: Fixed value: the shape of a pull request's address.
PULL_REQUEST = r"^https?://(?:www\.)?github\.com/([^/?#]+/[^/?#]+)/pull/\+?([0-9]+)(?:[/?#]|$)"


def _filled(text: Column) -> Column:
    return F.nullif(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit(""))


def _scalar(raw: Column, path: str) -> Column:
    """The value at a path unless it is an object or a list."""
    value = F.get_json_object(raw, path)
    return _filled(F.when(~F.ltrim(value).rlike(r"^[{\[]"), value))


def _first(raw: Column, paths: list[str], keys: list[str]) -> Column:
    """The first path that holds a filled scalar, or an object with one under the first such key."""
    return F.coalesce(*[_scalar(raw, path) if not key else _scalar(raw, f"{path}.{key}") for path in paths for key in ["", *keys]])


def reporter(raw: Column) -> Column:
    return _first(raw, REPORTER, PERSON)


def description(raw: Column) -> Column:
    """Plain descriptions, tags left out; rich text as an object gives null."""
    return F.coalesce(*[_filled(F.regexp_replace(_scalar(raw, path), "<[^>]*>", " ")) for path in DESCRIPTION])


def created(raw: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(_scalar(raw, path)) for path in CREATED])


def parent(raw: Column) -> Column:
    return _first(raw, PARENT, PARENT_KEYS)


def _keyed(key: str):
    return lambda field: field["key"] == key


def _entries(text: Column) -> Column:
    return F.array_sort(F.map_entries(F.from_json(text, "map<string,string>")))


def _points(fields: Column) -> Column:
    """Plausible points among entries, by name before by id."""
    named = F.filter(fields, lambda f: F.lower(F.regexp_replace(f["key"], r"[^\p{L}\p{N}]", "")).isin(POINT_NAMES))
    by_id = [F.filter(fields, _keyed(i)) for i in POINT_IDS]
    ordered = [F.transform(entries, lambda f: F.trim(f["value"]).try_cast("double")) for entries in [named, *by_id]]
    return F.coalesce(*[F.try_element_at(F.filter(values, lambda v: v.between(*POINTS)), F.lit(1)) for values in ordered])


def story_points(raw: Column) -> Column:
    """Plausible points of a field by name (in order of names), else by id, in $.fields before the item itself; numbers or texts of numbers."""
    return F.coalesce(*[_points(_entries(text)) for text in (F.get_json_object(raw, "$.fields"), raw)])


def _place(path: str) -> tuple[bool, str]:
    """Whether a path is in $.fields, and its last name."""
    inner = path.startswith("$.fields")
    return inner, path.removeprefix("$.fields").removeprefix("$").strip(".[]'")


def fields_of(items: DataFrame) -> DataFrame:
    """id, reporter, description, created_at, parent and points of items (id, raw as JSON text); null where no provider's path holds one or the text isn't JSON.

    A text is read once for all names of the item and once for those of its fields, not once a path; only objects are looked into by path. Of a
    name that an object repeats, the last counts."""
    raw = F.col("raw")
    paths = list(dict.fromkeys(REPORTER + DESCRIPTION + CREATED + PARENT))
    outer, inner = ([path for path in paths if _place(path)[0] == inside] for inside in (False, True))
    at = {path: f"_{k}" for k, path in enumerate(paths)}
    rows = items.select("id", "raw", F.json_tuple("raw", "fields", *[_place(path)[1] for path in outer]).alias("_fields", *[at[path] for path in outer]))
    # a text may hold JSON too, but is no object
    object_ = ~raw.rlike(r'"fields"\s*:\s*"') | F.coalesce(*[F.get_json_object(raw, path) for path in inner]).isNotNull()
    rows = rows.withColumn("_object", F.when(object_, F.col("_fields")))
    rows = rows.select("*", F.json_tuple("_object", *[_place(path)[1] for path in inner]).alias(*[at[path] for path in inner]))
    rows = rows.select("*", _entries(F.col("_fields")).alias("_inner"), _entries(raw).alias("_outer"))
    scalar = lambda path: _filled(F.when(~F.ltrim(F.col(at[path])).rlike(r"^[{\[]"), F.col(at[path])))
    within = lambda path, key: F.when(F.startswith(F.ltrim(F.col(at[path])), F.lit("{")), _scalar(raw, f"{path}.{key}"))
    first = lambda of, keys: F.coalesce(*[within(path, key) if key else scalar(path) for path in of for key in ["", *keys]])
    plain = F.coalesce(*[_filled(F.regexp_replace(scalar(path), "<[^>]*>", " ")) for path in DESCRIPTION])
    time = F.coalesce(*[F.try_to_timestamp(scalar(path)) for path in CREATED])
    return rows.select("id", first(REPORTER, PERSON).alias("reporter"), plain.alias("description"), time.alias("created_at"), first(PARENT, PARENT_KEYS).alias("parent"), F.coalesce(_points(F.col("_inner")), _points(F.col("_outer"))).alias("points"))


def attachment_links(attachments: DataFrame, items: DataFrame, pull_requests: DataFrame) -> DataFrame:
    """Distinct (repository, pr_number, identifier): attachments (issue_id, url) of items (linear_id, identifier) that name a known pull request.

    Owner and name compare in any case, and the stored spelling is kept; of several spellings the one that sorts first. An address of
    another shape names none. A null key joins nothing."""
    url = F.col("url")
    named = attachments.select("issue_id", F.lower(F.regexp_extract(url, PULL_REQUEST, 1)).alias("slug"), F.regexp_extract(url, PULL_REQUEST, 2).try_cast("long").alias("number")).where("number > 0")
    known = pull_requests.groupBy(F.lower("repository").alias("slug"), F.col("pr_number").alias("number")).agg(F.min("repository").alias("repository"))
    owned = named.join(items.select(F.col("linear_id").alias("issue_id"), "identifier"), "issue_id")
    return owned.join(known, ["slug", "number"]).select("repository", F.col("number").alias("pr_number"), "identifier").distinct()


def work_item_fields(spark, sf_dir):
    """Orders as items of four providers, and how many have each field."""
    k, who = F.col("o_orderkey"), F.concat(F.lit("dev"), (F.col("o_custkey") % 97).cast("string"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00'Z'")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    jira = text('{"fields": {"reporter": {"displayName": "', who, '"}, "Story Points": ', (k % 45).cast("string"), ', "created": "', day, '", "description": "<p>Do ', k.cast("string"), '</p>", "parent": {"key": "P-', (k % 50).cast("string"), '"}}}')
    azure = text('{"fields": {"creator": " ", "System.CreatedBy": "', who, '", "System.CreatedDate": "', day, '", "System.Parent": ', (k % 40).cast("string"), "}}")
    linear = text('{"creator": {"name": "", "emailAddress": "', who, '"}, "createdAt": "', day, '", "parent": {"identifier": "L-', (k % 30).cast("string"), '"}}')
    github = text('{"user": {"login": "', who, '"}, "created_at": "', day, '", "body": "Fix ', k.cast("string"), '"}')
    raw = F.when(k % 5 == 0, jira).when(k % 5 == 1, azure).when(k % 5 == 2, linear).when(k % 5 == 3, github).otherwise("not json")
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # mostly computation, so no fewer tasks than cores
    orders = model.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate").repartition(tasks)
    rows = fields_of(orders.select(k.alias("id"), raw.alias("raw")))
    return rows.groupBy("reporter").agg(F.count("*").alias("n"), F.count("description").alias("described"), F.countDistinct("parent").alias("parents"), F.min("created_at").alias("first_at"), F.sum("points").alias("points"))


def pull_request_items(spark, sf_dir):
    """Pull requests that attachments of issues name, with addresses in several shapes."""
    k = F.col("issue_id")
    repo = F.concat(F.lit("Org/Repo"), (k % 25).cast("string"))
    end = F.when(k % 6 == 0, F.concat(F.lit("/pull/"), k.cast("string"))).when(k % 6 == 1, F.concat(F.lit("/pull/"), k.cast("string"), F.lit("/files#r1"))).when(k % 6 == 2, F.concat(F.lit("/issues/"), k.cast("string"))).when(k % 6 == 3, "/pull/0").otherwise(F.concat(F.lit("/pull/"), k.cast("string"), F.lit("?a=b")))
    found = model.issues(spark, sf_dir).select(k.alias("issue_id"), F.concat(F.when(k % 4 == 0, "http://www.github.com/").when(k % 4 == 1, "https://example.org/").otherwise("https://github.com/"), repo, end).alias("url"))
    items = model.issues(spark, sf_dir).select(k.alias("linear_id"), F.concat("team_key", F.lit("-"), k.cast("string")).alias("identifier"))
    pulls = model.pull_requests(spark, sf_dir).withColumn("repository", F.concat(F.lit("org/"), "repository"))
    return attachment_links(found.union(found), items, pulls).groupBy("repository").agg(F.count("*").alias("links"), F.min("pr_number").alias("first"), F.max("identifier").alias("last"))
