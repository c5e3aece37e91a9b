import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions.planning import is_bot
from tidemark.functions.similarity import jaro_winkler
from tidemark.operators.planning import closure
from tidemark.sources import sinks
from tidemark.streaming import incremental


def test_jaro_winkler(spark):
    duckdb = pytest.importorskip("duckdb")
    words = ["", "a", "ab", "ba", "martha", "marhta", "dixon", "dicksonx", "jellyfish", "smellyfish", "crate", "trace", "éa😀b", "aé😀b", "aaaaab", "abaaaa"]
    pairs = [(a, b) for a in words for b in words]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", jaro_winkler(F.col("a"), F.col("b")).alias("s")).collect()
    con = duckdb.connect()
    for r in got:
        if r.a and r.b and (r.a + r.b).isascii():
            assert r.s == pytest.approx(con.execute("SELECT jaro_winkler_similarity(?, ?)", [r.a, r.b]).fetchone()[0]), (r.a, r.b)
    by = {(r.a, r.b): r.s for r in got}
    assert by["", ""] == 1.0 and by["", "a"] == 0.0 and by["éa😀b", "aé😀b"] == by["aé😀b", "éa😀b"] > 0.9


def test_bots(spark):
    names = {"Lucia Abbott": False, "release-ci": True, "x[bot]": True, "Robot": True, "Marie-Cindy": False, None: False, "": False}
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", is_bot(F.col("n")).alias("b")).collect()
    assert {r.n: r.b for r in rows} == names


def test_closure_stops_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "id long, parent long")
    seeds = spark.createDataFrame([("t", 1), ("u", 4), ("t", 1)], "tag string, id long")
    assert sorted(map(tuple, closure(edges, seeds).collect())) == [("t", 1), ("t", 2), ("t", 3), ("u", 4), ("u", 5)]
    assert closure(edges, seeds.limit(0)).count() == 0


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, t long")
    new = spark.createDataFrame([(2, "c", 1), (3, "d", 2), (1, "z", 0), (3, "d", 2)], "k long, v string, t long")
    assert sorted(map(tuple, sinks.upserted(old, new, ["k"], [F.desc("t")]).collect())) == [(1, "a", 1), (2, "c", 1), (3, "d", 2)]
    assert sorted(map(tuple, sinks.added(old, new, ["k"]).collect())) == [(1, "a", 1), (2, "b", 1), (3, "d", 2)]
    path = str(tmp_path / "parts")
    sinks.replace_partitions(old, path, ["k"])
    sinks.replace_partitions(new.where("k = 2"), path, ["k"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]
    sinks.write_csv(old, str(tmp_path / "c"), single=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    sinks.write_json(old, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).columns == ["k", "t", "v"]


def test_streams(spark, tmp_path):
    source, day = str(tmp_path / "in"), lambda d: datetime.datetime(2024, 1, d)
    for k, rows in enumerate([[(1, day(1), "a"), (2, day(2), "b")], [(1, day(9), "c"), (2, day(1), "z")]]):
        spark.createDataFrame(rows, "k long, ts timestamp, v string").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("k long, ts timestamp, v string").option("maxFilesPerTrigger", 1).parquet(source)
    out = str(tmp_path / "out")
    incremental.keep_latest(stream, out, ["k"], [F.desc("ts")]).awaitTermination()
    assert sorted((r.k, r.v) for r in spark.read.parquet(f"{out}/v1").collect()) == [(1, "c"), (2, "b")]
    query = incremental.weekly_counts(stream, "ts", []).writeStream.outputMode("complete").format("memory").queryName("weeks").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.monday.day, r.n) for r in spark.table("weeks").collect()} == {(1, 3), (8, 1)}
