"""Tracker signals: fields by priority, references, scopes, and their place in the cascade."""

from tidemark.operators import rule_engine, signals

ISSUES = "source string, key string, issue_type string, labels array<string>, components array<string>"
MAPPINGS = "source string, field string, value string, category string, confidence double"


def test_fields_by_priority(spark):
    issues = [("keys", "A-1", "Bug", ["infra"], ["api"]), ("keys", "A-2", "Task", ["none", "docs", "infra"], None), ("keys", "A-3", None, None, ["ui", "api"]), ("keys", "A-4", "Task", [], []), ("numbers", "o/r#7", None, ["infra"], None), (None, "A-9", "Bug", None, None)]
    maps = [("keys", "issue_type", "Bug", "bugfix", None), ("keys", "label", "infra", "platform", 0.7), ("keys", "label", "docs", "documentation", None), ("keys", "component", "api", "integration", None), ("numbers", "label", "infra", "ci", 0.8)]
    got = {r.key: (r.category, r.confidence, r.note) for r in signals.resolved(spark.createDataFrame(issues, ISSUES), spark.createDataFrame(maps, MAPPINGS)).collect()}
    assert got == {"A-1": ("bugfix", 0.92, "keys:issue_type:Bug"), "A-2": ("documentation", 0.92, "keys:label:docs"), "A-3": ("integration", 0.92, "keys:component:api"), "o/r#7": ("ci", 0.8, "numbers:label:infra")}


def test_references(spark):
    texts = ["ABC-12 then X-9, abc-1", "UI-12345678 and UI-1234567", "fix (#12) and o/r#5, #0 c#3 #012", "#ff0000", None, ""]
    got = {}
    for r in signals.references(spark.createDataFrame([(t, "me/x") for t in texts] * 2, "message string, repository string")).collect():
        got.setdefault(texts.index(r.message), []).append((r.source, r.place, r.key))
    assert {k: sorted(v) for k, v in got.items()} == {
        0: [("keys", 0, "ABC-12"), ("keys", 1, "X-9")], 1: [("keys", 0, "UI-1234567")], 2: [("numbers", 0, "o/r#5"), ("numbers", 1, "me/x#12")],
    }


def test_place_in_the_cascade(spark):
    commits = [("a", "feat: x ABC-1", False, "r"), ("b", "ABC-1 y (#3)", False, "s"), ("c", "fix: z ABC-1", False, "r"), ("d", "docs: none", False, "r"), ("e", "nothing ABC-2 ABC-1", False, "r"), ("f", "ABC-1", False, None), ("g", None, False, "r"), ("h", "chore: ABC-1", False, "m")]
    rows = spark.createDataFrame(commits, "sha string, message string, is_merge boolean, repository string")
    known = spark.createDataFrame([("keys", "ABC-1", "security", 0.92, "k"), ("numbers", "s#3", "ops", 0.8, "n")], "source string, key string, category string, confidence double, note string")
    bound = spark.createDataFrame([("s", "numbers")], "repository string, source string")
    found = signals.signals(rows, known, bound=bound)
    assert {r.sha: r.signal for r in found.collect()} == {"a": "security", "b": "ops", "c": "security", "e": "security", "f": "security", "h": "security"}
    over, mapped = spark.createDataFrame([("c", "platform")], "sha string, work_type string"), spark.createDataFrame([("h", "infra")], "sha string, map_category string")
    got = {r.sha: (r.category, r.method, r.confidence) for r in rule_engine.classify(rows, overrides=over, mapped=mapped, signals=found).collect()}
    assert got["a"] == ("security", "external_source", 0.92) and got["b"] == ("ops", "external_source", 0.8) and got["c"] == ("platform", "manual", 1.0)
    assert got["d"][1] == "exact" and got["h"] == ("infra", "repo_map", 1.0) and got["g"][0] is None
    floored = {r.sha: (r.category, r.method) for r in rule_engine.classify(rows, mapped=mapped, floor=(["security"], 0.9), signals=found).collect()}
    assert floored["h"] == ("security", "external_source")
