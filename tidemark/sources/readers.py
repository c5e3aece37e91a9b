"""File sources: change logs, delimited and JSON facts, folders of monitor exports, and layered rule files. All read through Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DEPLOYMENTS = "deploy_id string, repo string, environment string, triggered_at timestamp, completed_at timestamp, status string, git_sha string, git_tag string, triggered_by_pr long, source string"
INCIDENTS = "incident_id string, source string, detected_at timestamp, resolved_at timestamp, severity string, repo string, triggering_deploy string"
RULES = "id string, category string, subcategory string, keywords array<string>, patterns array<string>, priority int, confidence double"


def change_log(spark: SparkSession, path: str) -> DataFrame:
    """(author, added, deleted, path) of logs whose records start with \\x01 and an address; ``-`` counts 0, other lines are passed over.

    A record is one piece of a file, split by Spark's text reader, so no file is read whole."""
    records = spark.read.option("lineSep", "\x01").text(path)
    lines = F.split("value", "\n")
    rows = records.select(F.trim(F.element_at(lines, 1)).alias("author"), F.explode(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))).alias("line"))
    parts = F.split("line", "\t", 3)
    number = [F.when(F.get(parts, F.lit(i)) == "-", F.lit(0)).otherwise(F.expr(f"try_cast(split(line, '\\t', 3)[{i}] as bigint)")) for i in (0, 1)]
    rows = rows.select("author", number[0].alias("added"), number[1].alias("deleted"), F.get(parts, F.lit(2)).alias("path"))
    return rows.where("added is not null and deleted is not null and path <> '' and author <> ''")


def facts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a .csv file with a header, or of a JSON array or lines; a row that doesn't fit the schema fails the read."""
    reader = spark.read.schema(schema).option("mode", "FAILFAST").option("timeZone", "UTC")
    return reader.option("header", True).csv(path) if path.endswith(".csv") else reader.option("multiLine", True).json(path)


def first_facts(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row a key, the first by ``order``; rows without a key go."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.dropna(subset=key).withColumn("_place", place).where("_place = 1").drop("_place")


def monitor_events(spark: SparkSession, path: str) -> DataFrame:
    """(incident_id, title, seconds) from a folder's .json files: one event, a list, or a list under ``events`` or ``data``. Other files and texts that aren't JSON are passed over."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(path)
    event = "struct<id:string,title:string,date_happened:string,attributes:struct<title:string,timestamp:string>>"
    text = F.trim("value")
    lists = [F.when(text.startswith("["), F.from_json("value", f"array<{event}>"))]
    lists += [F.from_json(F.get_json_object("value", f"$.{k}"), f"array<{event}>") for k in ("events", "data")]
    one = F.when(text.startswith("{"), F.from_json("value", event))
    rows = files.select(F.explode(F.coalesce(*lists, F.array(one))).alias("e")).where("e.id is not null")
    when = F.coalesce("e.date_happened", "e.attributes.timestamp")
    seconds = F.coalesce(F.when(when.rlike("^[0-9]+$"), when.try_cast("long")), F.unix_timestamp(F.try_to_timestamp(when)))
    return rows.select(F.col("e.id").alias("incident_id"), F.coalesce("e.title", "e.attributes.title").alias("title"), seconds.alias("seconds"))


def layered_rules(layers: list[DataFrame]) -> DataFrame:
    """Rules of several layers: a later layer replaces a rule of the same id, in the place where the id came first; priority first, then place."""
    rows = None
    for n, layer in enumerate(layers):
        numbered = layer.withColumn("layer", F.lit(n)).withColumn("at", F.monotonically_increasing_id())
        rows = numbered if rows is None else rows.unionByName(numbered)
    same = Window.partitionBy("id")
    rows = rows.withColumn("since", F.min(F.struct("layer", "at")).over(same)).withColumn("last", F.row_number().over(same.orderBy(F.desc("layer"), F.desc("at"))))
    return rows.where("last = 1").orderBy(F.desc("priority"), "since").drop("layer", "at", "last", "since")
