import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import contributors, evaluation, rule_engine, selection, upkeep, work_items


def _values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_machines_and_identity(spark):
    rows = [("Dependabot", "a@b"), ("Ann", "x+renovate@y"), ("ann[BOT]", None), ("Ann", "ann@y"), (None, None)]
    assert _values(spark, rows, "n string, e string", selection.is_machine(F.col("n"), F.col("e"))) == [True, True, True, False, False]
    rows = [("", "a"), (None, "a"), ("c", "a"), (None, None)]
    assert _values(spark, rows, "c string, e string", selection.identity(F.col("c"), F.col("e"))) == ["a", "a", "c", None]
    people = spark.createDataFrame([("A@x", "z"), ("", "a@X"), (None, "b@x")], "canonical_email string, author_email string")
    assert selection.of_person(people, "a@x").count() == 2


def test_spans(spark):
    rows = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("2024-01-02T23:59:59Z",), ("2024-01-02T23:59:59.500Z",), ("2024-01-03T00:00:00Z",), (None,)], "t string")
    assert selection.between(rows, "t").count() == 5
    assert selection.between(rows, "t", since="2024-01-02").count() == 3
    assert selection.to_end_of_day(rows, "t", "2024-01-02").count() == 3
    now = datetime.datetime(2024, 3, 15, tzinfo=datetime.timezone.utc)
    assert selection.date_range(now, weeks=2, since="2020-01-01") == ("2024-03-01T00:00:00+00:00", None)
    assert selection.date_range(now, until="2024-01-05", configured="c") == ("c", "2024-01-05T23:59:59+00:00")
    assert selection.date_range(now) == (None, None)
    with pytest.raises(ValueError):
        selection.date_range(now, since="5 May")
    assert [selection.weeks_of(g) for g in ("quarterly", "monthly", "weekly")] == [13, 4, 1] and selection.weeks_of("custom", 0) == 1 and selection.weeks_of("custom", 6) == 6


def test_aliases_sizes_and_marks(spark):
    authors = spark.createDataFrame([(1, '["Ann_B", "ann@x"]'), (2, '["annxb"]'), (3, None)], "id long, aliases string")
    assert [r.id for r in selection.by_alias(authors, "ann_b").collect()] == [1]
    assert _values(spark, [("XS",), ("XL",), ("?",), (None,)], "s string", selection.size_number(F.col("s"))) == [1, 5, 0, 0]
    assert _values(spark, [("abcdef",), ("abc",), (None,)], "s string", selection.truncated(F.col("s"), 4)) == ["abcd\n[truncated 2 characters]", "abc", None]


def test_evidence_floor(spark):
    hits = [("a", 0.9), ("a", 0.45), ("a", 0.02), ("a", float("nan")), ("a", None), ("b", 0.0), ("b", -1.0), ("c", float("inf")), (None, 2.0), (None, 0.9)]
    got = selection.evidence(spark.createDataFrame(hits, "query string, score double")).collect()
    assert sorted((r.query or "", r.score) for r in got) == [("", 2.0), ("a", 0.45), ("a", 0.9), ("b", -1.0), ("b", 0.0)]
    assert selection.evidence(spark.createDataFrame([], "query string, score double, x int")).columns == ["query", "score", "x"]


def test_score_bands(spark):
    rows = [(float(i), "M") for i in range(1, 11)]
    got = {r.s: r.band for r in selection.score_bands(spark.createDataFrame(rows, "s double, z string"), "s", "z").collect()}
    assert got == {1.0: 1, 2.0: 2, 3.0: 2, 4.0: 3, 5.0: 3, 6.0: 4, 7.0: 4, 8.0: 5, 9.0: 5, 10.0: 5}
    assert {r.band for r in selection.score_bands(spark.createDataFrame(rows[:4], "s double, z string"), "s", "z").collect()} == {3}


def test_delivery_sources(spark):
    t = datetime.datetime
    deployments = spark.createDataFrame([(1, "c1", t(2024, 1, 2)), (2, "c2", t(2024, 1, 3)), (3, None, t(2024, 1, 4)), (4, "c1", t(2025, 1, 1))], "deploy_id long, git_sha string, triggered_at timestamp")
    commits = spark.createDataFrame([("c1", t(2024, 1, 1)), ("c2", t(2024, 2, 1))], "sha string, ts timestamp")
    pulls = spark.createDataFrame([(t(2024, 1, 1), t(2024, 1, 1, 10)), (t(2024, 1, 1), t(2024, 6, 1)), (t(2024, 1, 1), None)], "created_at timestamp, merged_at timestamp")
    row = lambda *a: tuple(selection.delivery_sources(*a).first())
    assert row(deployments, commits, pulls, "2024-01-01", "2024-12-31", 3) == (1.0, "deployments", 24.0, "measured")
    assert row(deployments, commits.limit(0), pulls, "2024-01-01", "2024-12-31", 3) == (1.0, "deployments", 10.0, "proxy")
    assert row(deployments, commits, pulls, "2023-01-01", "2023-12-31", 4) == (0.5, "merge_proxy", 10.0, "proxy")
    assert row(deployments.limit(0), commits, pulls.limit(0), "2023-01-01", "2023-12-31", 0) == (0.0, "merge_proxy", None, "unmeasurable")


def test_fields_of_providers(spark):
    raws = [
        '{"fields": {"reporter": {"displayName": " Ann "}, "creator": "Bob", "parent": {"key": "P-1"}, "description": {"type": "doc"}, "created": "2024-01-02T03:04:05Z"}, "body": "b <b>c</b>"}',
        '{"fields": {"reporter": {"emailAddress": "e@x"}, "System.Parent": 7}, "createdAt": "x", "created": "2024-01-01"}', '{"user": {"login": ""}, "author": "Al"}', "[]", "no", "", None,
    ]
    got = work_items.fields_of(spark.createDataFrame(list(enumerate(raws)), "id int, raw string")).orderBy("id").collect()
    assert [r.reporter for r in got] == ["Ann", "e@x", "Al", None, None, None, None]
    assert [r.parent for r in got] == ["P-1", "7", None, None, None, None, None]
    assert got[0].description == "b  c" and got[0].created_at == datetime.datetime(2024, 1, 2, 3, 4, 5) and got[1].created_at == datetime.datetime(2024, 1, 1)


def test_attachment_links(spark):
    urls = ["https://github.com/Own/Repo/pull/5", "http://www.github.com/own/repo/pull/5/files", "https://github.com/own/repo/pull/5?x", "https://github.com/own/repo/pull/5x", "https://gitlab.com/own/repo/pull/5", "https://github.com/own/repo/pull/99999999999999999999", "https://github.com//repo/pull/5", None]
    attachments = spark.createDataFrame([("i1", u) for u in urls] + [(None, urls[0]), ("i9", urls[0])], "issue_id string, url string")
    items = spark.createDataFrame([("i1", "K-1"), (None, "K-2")], "linear_id string, identifier string")
    pulls = spark.createDataFrame([("OWN/repo", 5), ("Own/Repo", 5), ("own/repo", 6)], "repository string, pr_number long")
    assert [tuple(r) for r in work_items.attachment_links(attachments, items, pulls).collect()] == [("OWN/repo", 5, "K-1")]


def test_fields_are_read_once(spark):
    """The same as path by path on odd items, with few calls that read the text."""
    raws = ['{"user": "{\\"name\\": \\"x\\"}"}', '{"user": {"name": "", "login": "l"}}', '{"fields": "{\\"reporter\\": \\"x\\"}", "author": "a"}', '{"fields": {"fields": "f", "reporter": {"name": " n "}, "parent": {"id": 7.50}}}', '{"fields": null, "parent": [1], "created": 5}']
    raws += ['{"fields": ["a"], "creator": 1.50, "estimate": "3"}', "[1]", "", '{"user": "a", broken', None, '{"fields": {"System.Parent": 12, "created": "2024-01-02T03:04:05Z"}, "body": "<p> a </p>"}', '{"user": {"login": {"a": 1}}, "author": {"id": 1}}', '{"user": true, "description": {"type": "doc"}, "body": "b"}']
    items = spark.createDataFrame(list(enumerate(raws)), "id int, raw string")
    raw = F.col("raw")
    want = items.select("id", work_items.reporter(raw), work_items.description(raw), work_items.created(raw), work_items.parent(raw), work_items.story_points(raw))
    got = work_items.fields_of(items)
    assert list(map(tuple, got.orderBy("id").collect())) == list(map(tuple, want.orderBy("id").collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") + plan.count("jsontostructs") + plan.count("json_tuple") <= 4


def test_story_points(spark):
    raws = ['{"fields": {"Story Points": "5", "customfield_10004": 8}, "estimate": 3}', '{"fields": {"story_points": 90, "customfield_10016": 2.5}}', '{"estimate": 3}', '{"fields": {"storyPoints": {"v": 1}}, "customfield_13737": " 8 "}', '{"fields": null}', "no", None]
    assert _values(spark, list(enumerate(raws)), "id int, raw string", work_items.story_points(F.col("raw"))) == [5.0, 2.5, 3.0, 8.0, None, None, None]


def test_contributors(spark):
    authors = [(1, "Ann@x", "Ann", '["ann-gh", "100%_a"]'), (2, "bo@x", "ANN", '["ann-gh2"]'), (3, None, None, None), (4, "c@x", "Cy", '["é😀b"]')]
    authors = spark.createDataFrame(authors, "id long, canonical_email string, canonical_name string, aliases string")
    typed = ["ANN@X", "ann", "-GH2", "gh", "%_a", "_%", "😀", "", None, "nobody", "ann"]
    got = {r.query: (r.id, r.how) for r in contributors.find(spark.createDataFrame([(q,) for q in typed], "query string"), authors).collect()}
    none = (None, "none")
    assert got == {"ANN@X": (1, "email"), "ann": (1, "name"), "-GH2": (2, "alias"), "gh": (1, "alias"), "%_a": (1, "alias"), "_%": none, "😀": (4, "alias"), "": none, None: none, "nobody": none}
    assert contributors.find(spark.createDataFrame([("x",)], "query string"), authors.limit(0)).first().how == "none"


def test_alias_hits_against_all_pairs(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abA%_é") for _ in range(n))
    texts, asked = [(i, word(rng.randint(0, 12))) for i in range(60)], [word(rng.randint(1, 5)) for _ in range(60)]
    got = contributors.alias_hits(spark.createDataFrame([(q,) for q in asked], "query string"), spark.createDataFrame(texts, "id long, aliases string")).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == {(q, i) for q in asked for i, t in texts if q.lower() in t.lower()}


def test_walk_states(spark):
    marks = [("a", 1, "start", "h1"), ("a", 2, "complete", "h1"), ("a", 3, "start", "h2"), ("b", 1, "start", None), ("c", 1, "start", "x"), ("c", 1, "complete", "x"), ("d", 1, "start", "x"), ("d", 2, "complete", "y"), ("e", 1, "other", "z")]
    got = upkeep.walk_states(spark.createDataFrame(marks, "repository string, at int, kind string, head string")).collect()
    assert {tuple(r) for r in got} == {("a", False, "h1", 3), ("b", False, None, 1), ("c", False, "x", 1), ("d", True, "y", 2)}


def test_repredict_by_message(spark, monkeypatch):
    """Equal messages are classified once; null ones are empty, merges are told apart, and other columns stay."""
    rows = [(f"s{k}", "r", "fix: crash" if k % 3 else None, None if k % 5 == 4 else k % 2 == 0) for k in range(60)]
    commits = spark.createDataFrame(rows, "sha string, repository string, message string, is_merge boolean")
    sample = commits.select("sha", "repository", F.lit("old").alias("category"), F.col("sha").alias("message"))
    seen, classify = [], evaluation.rule_engine.classify
    monkeypatch.setattr(evaluation.rule_engine, "classify", lambda found, *a, **b: (seen.append(found.count()), classify(found, *a, **b))[1])
    got = evaluation.repredict(sample, commits).collect()
    want = {r.sha: (r.category, r.subcategory, r.confidence, r.method) for r in classify(commits).collect()}
    assert seen == [6] and len(got) == 60
    assert all((r.category, r.subcategory, r.confidence, r.method) == want[r.sha] and r.message == r.sha for r in got)


def test_repredict(spark):
    commits = spark.createDataFrame([("s1", "r", "fix: crash", False), ("s2", "r", "PROJ-1 words", False)], "sha string, repository string, message string, is_merge boolean")
    sample = spark.createDataFrame([("s1", "r", "old", 2.0), ("s1", "r", "old", 3.0)], "sha string, repository string, category string, weight double")
    rows = evaluation.repredict(sample, commits).collect()
    assert sorted(r.weight for r in rows) == [2.0, 3.0] and {r.category for r in rows} != {"old"} and len({r.rules_sha256 for r in rows}) == 1
    other = evaluation.repredict(sample, commits, rule_engine.RULES[:3]).first()
    assert other.rules_sha256 != rows[0].rules_sha256
    with pytest.raises(ValueError):
        evaluation.repredict(sample.limit(0), commits)
    with pytest.raises(ValueError):
        evaluation.repredict(sample.withColumn("repository", F.lit("q")), commits)
