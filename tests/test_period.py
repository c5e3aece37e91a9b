"""The delivery summary of a period, the first longest name, and merges a week: boundary cases by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import report, selection, upkeep
from tidemark.sources import model

T = dt.datetime(2024, 1, 1)


def commits(spark, rows):
    return spark.createDataFrame([(T + dt.timedelta(hours=h), m, c, g) for h, m, c, g in rows], "ts timestamp, message string, category string, is_merge boolean")


def test_period_by_hand(spark):
    rows = [(0, "feat: a", "feature", False), (10, "fix: b", "bugfix", False), (20, 'Revert "a"', "revert", False), (40, "docs", None, False), (200, "fix: c", "bugfix", False), (30, "Merge branch 'x'", "bugfix", True), (24 * 400, "fix: later", "bugfix", False)]
    shas = spark.createDataFrame([("a", T), ("m", T + dt.timedelta(hours=30))], "sha string, ts timestamp")
    deploys = spark.createDataFrame([("a", T + dt.timedelta(hours=5)), ("m", T + dt.timedelta(hours=33)), ("a", T - dt.timedelta(days=90)), ("zz", T + dt.timedelta(hours=50))], "git_sha string, triggered_at timestamp")
    pulls = spark.createDataFrame([(T, T + dt.timedelta(hours=8)), (T, None)], "created_at timestamp, merged_at timestamp")
    r = selection.period_summary(commits(spark, rows), shas, deploys, pulls, "2024-01-01", "2024-12-31").first()
    assert (r.per_week, r.frequency_source, r.lead_hours, r.lead_source) == (1.5, "deployments", 4.0, "measured")
    assert r.failure_rate == 2 / 5 and r.mttr_hours == 95.0 and r.level == "low"
    r = selection.period_summary(commits(spark, rows), shas, deploys, pulls, "1990-01-01", "1990-12-31").first()
    assert (r.per_week, r.frequency_source, r.lead_hours, r.failure_rate, r.mttr_hours, r.level) == (1.0, "merge_proxy", 8.0, 0.0, 0.0, "high")


@pytest.fixture
def given(spark, monkeypatch):
    def use(name, rows, schema):
        monkeypatch.setattr(model, name, lambda *_: spark.createDataFrame(rows, schema))

    return use


def test_names_of_any_kind(spark, given):
    rows = [(f"c{k}", "a@b.cc", name, T + dt.timedelta(days=k), 1, 1, 1, False) for k, name in enumerate(["Al", "Alice Smith", "Alicia Smyt", None, "Al"])] + [("z", "z@b.cc", None, None, 1, 1, 1, False)]
    given("commits", rows, "sha string, author_email string, author_name string, ts timestamp, insertions long, deletions long, files_changed long, is_merge boolean")
    assert {r.author_email: (r.name, r.commits) for r in report.author_summary(spark, "").collect()} == {"a@b.cc": ("Alice Smith", 5), "z@b.cc": (None, 1)}


def test_merges_a_week_before_the_clamp(spark, given):
    rows = [("merged", T, T + dt.timedelta(minutes=5)), ("merged", T, T + dt.timedelta(minutes=5)), ("merged", T, T + dt.timedelta(days=8)), ("open", T, None)]
    given("pull_requests", rows, "state string, created_at timestamp, merged_at timestamp")
    r = report.pr_cycle_stats(spark, "").first()
    assert (r.merged, r.avg_hours, r.median_hours, r.per_week) == (1, 192.0, 192.0, 1.5)
    given("pull_requests", [], "state string, created_at timestamp, merged_at timestamp")
    r = report.pr_cycle_stats(spark, "").first()
    assert (r.merged, r.avg_hours, r.median_hours, r.per_week) == (0, None, None, 0.0)


def test_paths(spark):
    generated = {"a/Cargo.toml": True, "CHANGELOG.md": True, "x/go.sum": True, "a.png": False, "src/main.rs": False, "b/c.svg": True, "README": False}
    tests = {"src/tests.rs": True, "A/Tests/x.rs": True, "x_tests.rs": True, "x_test.py": True, "a.test.b.ts": True, "contest.rs": False, "spec/a": True, "test_x": True, "latest.rs": False, "benches/b.rs": True}
    for paths, rule in ((generated, upkeep.is_generated(F.col("p"))), (tests, F.lower("p").rlike(upkeep.TEST_PATH))):
        got = {r.p: r.x for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", rule.alias("x")).collect()}
        assert got == paths
