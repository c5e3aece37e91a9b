import pytest
from pyspark.sql import functions as F

from tidemark.operators import aliases
from tidemark.sources import readers, sinks


def test_change_log(spark, tmp_path):
    (tmp_path / "a.log").write_text("\x01ann@x\n3\t1\tsrc/a.py\n-\t-\tlogo.png\n\nnot a line\n\x01bob@x\n\x01ann@x\n2\t0\tsrc/with\ttab.py\n")
    (tmp_path / "b.log").write_text("")
    rows = sorted(map(tuple, readers.change_log(spark, str(tmp_path)).collect()))
    assert rows == [("ann@x", 0, 0, "logo.png"), ("ann@x", 2, 0, "src/with\ttab.py"), ("ann@x", 3, 1, "src/a.py")]


def test_facts(spark, tmp_path):
    csv = tmp_path / "i.csv"
    csv.write_text("incident_id,source,detected_at,resolved_at,severity,repo,triggering_deploy\n1,m,2024-01-01T00:00:00Z,,high,r,\n1,m,2024-01-02T00:00:00Z,,low,r,d\n")
    rows = readers.facts(spark, str(csv), readers.INCIDENTS)
    assert [r.severity for r in readers.first_facts(rows, ["incident_id"], [F.desc("detected_at")]).collect()] == ["low"]
    (tmp_path / "d.json").write_text('[{"deploy_id": "1", "repo": "r", "triggered_at": "2024-01-01T00:00:00Z", "triggered_by_pr": 7}]')
    assert readers.facts(spark, str(tmp_path / "d.json"), readers.DEPLOYMENTS).first().triggered_by_pr == 7
    csv.write_text("incident_id,source,detected_at,resolved_at,severity,repo,triggering_deploy\n1,m,not a time,,high,r,\n")
    with pytest.raises(Exception):
        readers.facts(spark, str(csv), readers.INCIDENTS).collect()


def test_monitor_events(spark, tmp_path):
    texts = {"a.json": '{"events": [{"id": 1, "title": "x", "date_happened": 1700000000}]}', "b.json": '[{"id": "2", "attributes": {"title": "y", "timestamp": "2023-11-14T22:13:20Z"}}]', "c.json": '{"id": "3", "title": "z"}', "d.json": "{no json", "e.txt": '{"id": "4"}', "f.json": "{}"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    rows = sorted(map(tuple, readers.monitor_events(spark, str(tmp_path)).collect()))
    assert rows == [("1", "x", 1700000000), ("2", "y", 1700000000), ("3", "z", None)]


def test_layered_rules(spark):
    one = spark.createDataFrame([("a", "x", 5), ("b", "x", 9), ("c", "x", 5)], "id string, category string, priority int").coalesce(1)
    two = spark.createDataFrame([("a", "y", 5), ("d", "y", 5)], "id string, category string, priority int").coalesce(1)
    assert [tuple(r) for r in readers.layered_rules([one, two]).collect()] == [("b", "x", 9), ("a", "y", 5), ("c", "x", 5), ("d", "y", 5)]


def test_aliases(spark):
    table = spark.createDataFrame([("a@x", "a@x", "Ann"), ("a@home", "a@x", "Ann"), ("b@x", "b@x", "Bob")], "email string, canonical_email string, name string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert ("b@home", "b@x", "Bob") in rows(aliases.add(table, "b@home", "b@x"))
    assert rows(aliases.remove(table, "A@HOME")) == [("a@x", "a@x", "Ann"), ("b@x", "b@x", "Bob")]
    merged = aliases.merge(table, "a@x", "b@x")
    assert rows(merged) == [("a@home", "b@x", "Bob"), ("a@x", "b@x", "Bob"), ("b@x", "b@x", "Bob")]
    assert ("a@x", "a@x", "Bob") in rows(aliases.unmerge(merged, "a@x"))
    assert {r.name for r in aliases.rename(merged, "b@x", "Rob").collect()} == {"Rob"}
    seen = spark.createDataFrame([("A@home",), ("z@x",), (None,)], "author_email string")
    assert {r.author_email: r.canonical_email for r in aliases.applied(seen, merged).collect()} == {"A@home": "b@x", "z@x": "z@x", None: None}


def test_markdown_and_rebuild(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1), ("c", 3), (None, 2)], "name string, n long")
    sinks.write_markdown(df, str(tmp_path / "m"), "Top", [F.desc("n")], most=2)
    assert [r.value for r in spark.read.text(str(tmp_path / "m")).collect()] == ["# Top", "", "| name | n |", "|-|-|", "| c | 3 |", "|  | 2 |"]
    for rows in (df, df.limit(1)):
        sinks.rebuild(rows, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
