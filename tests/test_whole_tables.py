"""Queries over whole tables, on fixtures with gaps, people on one side only and quotes that moved."""

import datetime as dt

import pytest

from tidemark.operators import auditing, report, tracker
from tidemark.sources import model

COMMITS = "id long, sha string, author_id long, author_email string, author_name string, ts timestamp_ntz, repository string, message string, insertions long, deletions long, files_changed long, is_merge boolean, ticketed boolean"


def commit(i, ts, who="dev1", message="feat: x", is_merge=False, ticketed=False):
    return (i, f"c{i}", i, f"{who}@example.com", f"Name {who}", ts, "repo1", message, 1, 1, 1, is_merge, ticketed)


@pytest.fixture
def given(spark, monkeypatch):
    """Puts rows in the place of a table of the model."""

    def put(name, rows, schema):
        frame = spark.createDataFrame(rows, schema)
        monkeypatch.setattr(model, name, lambda *_: frame)

    return put


def test_week_gaps_count_every_commit(spark, given):
    given("commits", [commit(i, dt.datetime(2024, 1, d)) for i, d in ((2, 1), (3, 2), (4, 24), (41, 24))], COMMITS)
    assert {r.week_label: r.commits for r in report.week_gaps(spark, "").collect()} == {"2024-W01": 2, "2024-W02": 0, "2024-W03": 0, "2024-W04": 2}


def test_unlinked_meets_all_people(spark, given):
    given("commits", [commit(i, dt.datetime(2024, 1, 1), who) for i, who in ((4, "a"), (5, "b"), (8, "c"))], COMMITS)
    given("pull_requests", [(1, "a"), (2, "b"), (3, "d"), (4, "e"), (5, "")], "pr_number long, author string")
    assert {(r.who, r.side) for r in tracker.unlinked(spark, "").collect()} == {("d", "pr only"), ("e", "pr only"), ("c", "commit only")}


def test_citations_of_every_document(spark, monkeypatch):
    texts = {k: "\n".join(f"line {j} of {k}" for j in range(k % 6 + 1)) for k in range(1, 40)} | {40: None, 41: "same\nsame", 42: "same\nsame"}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(model, "table", lambda *_: frame)
    got = {r.doc_id: (r.line, r.verdict) for r in auditing.citations(spark, "").collect()}
    assert got.keys() == texts.keys()
    for k, text in texts.items():
        lines = (text or "").split("\n")
        quoted = k * 7 % len(lines)
        line = (quoted + (k % 3 == 0)) % len(lines)
        want = "missing" if k % 4 == 0 else "verified" if lines[line] == lines[quoted] else "moved"
        assert got[k] == (line + 1, want), k
    assert {line for line, _ in got.values()} == {1, 2, 3, 4, 5, 6} and {v for _, v in got.values()} == {"verified", "moved", "missing"}


def test_untracked_has_authors_and_whole_subjects(spark, given):
    day, long = dt.datetime(2024, 1, 1), "feat: a subject that is much longer than forty characters"
    rows = [commit(1, day, message=long + "\r\nbody"), commit(2, day, message="wip\nnext line"), commit(3, day, message="Bump version to 2"), commit(4, day, ticketed=True), commit(5, day, is_merge=True)]
    rows = [r[:4] + (("Dev 100" if r[0] == 1 else "Dev 7"),) + r[5:] for r in rows]
    given("commits", rows, COMMITS)
    assert {(r.sha, r.author, r.subject) for r in report.untracked(spark, "").collect()} == {("c1", "Dev 100", long), ("c2", "Dev 100", "wip")}
