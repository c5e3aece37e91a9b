"""Queries of ``operators.auditing`` with their SQL."""

from __future__ import annotations

from ..operators import auditing
from .linking_sql import _choice, _q

_EDGES = """imports AS (SELECT DISTINCT * FROM (SELECT s_suppkey AS id, (s_suppkey * 3 + 1) % 64 AS next FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, s_suppkey // 3 FROM supplier UNION ALL SELECT s_suppkey, s_suppkey - 1 FROM supplier WHERE s_suppkey % 7 = 5)),
reach AS (SELECT id, next FROM imports UNION SELECT reach.id, imports.next FROM reach JOIN imports ON reach.next = imports.id)"""
_RANK = "CASE t " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in auditing.LICENCES.items()) + " ELSE 4 END"
_SCORED = """scored_parts AS (SELECT *, CASE WHEN points >= 90 THEN 'critical' WHEN points >= 70 THEN 'high' WHEN points >= 40 THEN 'medium' WHEN points > 0 THEN 'low' ELSE 'none' END AS severity FROM (SELECT p_partkey, CAST(floor(p_retailprice * 10) AS BIGINT) % 101 AS points FROM part))"""
_LANES = "lanes AS (" + " UNION ALL ".join(f"SELECT {i} AS lane, path, row_number() OVER (ORDER BY {by} DESC, path) AS turn FROM paths" for i, by in enumerate(("touches", "added", "gone"))) + ")"
_PATHS = "paths AS (SELECT path, count(*) AS touches, sum(insertions) AS added, sum(deletions) AS gone FROM files GROUP BY path)"
_SECONDS = "CAST(floor(epoch(ts)) AS BIGINT)"
_WEEKS = "weeks AS (SELECT id, repository, strftime(ts, '%G-W%V') AS week_label FROM commits)"

#: name: (query, SELECT, further common table expressions)
QUERIES = {
    "import_cycles": (auditing.import_cycles, "SELECT first, count(*) AS modules FROM (SELECT a.id, min(a.next) AS first FROM reach a JOIN reach b ON a.id = b.next AND a.next = b.id GROUP BY a.id) GROUP BY first HAVING count(*) > 1", (_EDGES,)),
    "inbound_degrees": (auditing.inbound_degrees, "SELECT next AS module, count(*) AS importers FROM imports WHERE id <> next GROUP BY next ORDER BY 2 DESC, 1 LIMIT 5", (_EDGES,)),
    "licence_policy": (auditing.licence_policy, f"SELECT CASE WHEN e = '' THEN 'unlicensed' ELSE {auditing.VERDICTS}[CASE WHEN list_min(r) = 1 THEN 1 ELSE list_max(r) END] END AS verdict, count(*) AS packages FROM (SELECT e, list_transform(regexp_split_to_array(e, ' (?:AND|OR) '), lambda t: {_RANK}) AS r FROM (SELECT {_choice(auditing.EXPRESSIONS, 'p_partkey')} AS e FROM part)) GROUP BY 1", ()),
    "advisory_rollup": (auditing.advisory_rollup, "SELECT p_partkey, points, uses, severity FROM scored_parts JOIN (SELECT l_partkey AS p_partkey, count(*) AS uses FROM lineitem GROUP BY 1) USING (p_partkey) ORDER BY points DESC, uses DESC, p_partkey LIMIT 10", (_SCORED,)),
    "severities": (auditing.severities, "SELECT severity, count(*) AS packages FROM scored_parts GROUP BY 1", (_SCORED,)),
    "citations": (auditing.citations, "SELECT doc_id, line, CASE WHEN trim(lines[line]) = quote THEN 'verified' WHEN list_contains(list_transform(lines, lambda x: trim(x)), quote) THEN 'moved' ELSE 'missing' END AS verdict FROM (SELECT doc_id, lines, (quoted + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END) % len(lines) + 1 AS line, CASE WHEN doc_id % 4 = 0 THEN 'no such line' ELSE trim(lines[quoted + 1]) END AS quote FROM (SELECT doc_id, lines, doc_id * 7 % len(lines) AS quoted FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)))", ()),
    "coverage_rollup": (auditing.coverage_rollup, "SELECT repository, count(*) AS n, floor(count(*) FILTER (WHERE ticketed) * 1000.0::DOUBLE / count(*) + 0.5::DOUBLE) / 10.0::DOUBLE AS pct FROM commits WHERE NOT is_merge GROUP BY 1", ()),
    "text_scan": (auditing.text_scan, " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count({c}) AS n, count(*) - count({c}) AS nulls, max(length({c})) AS longest, count(*) FILTER (WHERE regexp_matches({c}, {_q(auditing.DIFF)})) AS diff_like FROM {t}" for t, c in auditing.TEXTS), ()),
    "table_counts": (auditing.table_counts, " UNION ALL ".join(f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS n, (SELECT count(*) FROM (DESCRIBE {t})) AS n_columns" for t in auditing.TABLES), ()),
    "blended_paths": (auditing.blended_paths, "SELECT path, CAST(turn AS INTEGER) AS turn, lane FROM (SELECT path, turn, lane, row_number() OVER (PARTITION BY path ORDER BY turn, lane) AS nth FROM lanes WHERE turn <= 25) WHERE nth = 1 ORDER BY turn, lane LIMIT 25", (_PATHS, _LANES)),
    "scrubbed": (auditing.scrubbed, f"SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), {_q(auditing.SECRETS)}, '<secret>', 'g')) AS text_sha256 FROM documents", ()),
    "period_labels": (auditing.period_labels, "SELECT author_email, a || '..' || CASE WHEN a[1:4] = b[1:4] THEN b[6:] ELSE b END AS period FROM (SELECT author_email, strftime(min(ts), '%G-W%V') AS a, strftime(max(ts), '%G-W%V') AS b FROM commits GROUP BY 1)", ()),
    "parsed_times": (auditing.parsed_times, f"SELECT event_id, CASE event_id % 6 WHEN 3 THEN CAST(epoch(date_trunc('day', ts)) AS BIGINT) WHEN 5 THEN NULL ELSE {_SECONDS} END AS seconds FROM events", ()),
    "project_stats": (auditing.project_stats, f"""SELECT state, count(*) AS n, count(*) - count(target) AS no_target, count(*) FILTER (WHERE state = 'started' AND target < DATE '{auditing.AS_OF}') AS overdue, count(*) FILTER (WHERE done > target) AS late,
      CAST(sum(CASE WHEN done > target THEN date_diff('day', target, done) END) AS DOUBLE) / count(*) FILTER (WHERE done > target) AS mean_days_late, count(*) FILTER (WHERE k % 3 <> 0) * 100.0::DOUBLE / count(*) AS led_pct
      FROM (SELECT *, CASE WHEN k % 7 <> 0 THEN DATE '1997-01-01' + CAST(k % 600 AS INTEGER) END AS target, CASE WHEN state = 'completed' THEN DATE '1997-01-01' + CAST((k * 13) % 650 AS INTEGER) END AS done FROM (SELECT p_partkey AS k, {_choice(['planned', 'started', 'completed', 'completed', 'canceled'], 'p_partkey')} AS state FROM part)) GROUP BY state""", ()),
    "cycle_stats": (auditing.cycle_stats, "SELECT team, count(*) AS cycles, CAST(sum(done) AS BIGINT) * 100.0::DOUBLE / CAST(sum(scope) AS BIGINT) AS pooled_pct, CAST(sum(scope - done) AS BIGINT) / count(*) AS carryover, round(quantile_cont(done * 100.0::DOUBLE / scope, 0.5), 6) AS median_pct FROM (SELECT c_custkey % 6 AS team, c_custkey % 17 AS scope, c_custkey % 17 - least(c_custkey % 4, c_custkey % 17) AS done FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 11 <> 0) WHERE scope > 0 GROUP BY team", ()),
    "population": (auditing.population, "SELECT team_key, state_type, count(*) AS n FROM issues GROUP BY ROLLUP (team_key, state_type)", ()),
    "usage_totals": (auditing.usage_totals, "SELECT event_type, count(*) AS calls, CAST(sum(CAST(props ->> '$.k' AS BIGINT)) AS BIGINT) AS tokens, max(CAST(props ->> '$.k' AS BIGINT)) AS most FROM events GROUP BY 1", ()),
    "pending_partitions": (auditing.pending_partitions, "SELECT DISTINCT repository, week_label FROM weeks EXCEPT SELECT repository, week_label FROM weeks WHERE id % 3 = 0", (_WEEKS,)),
    "soft_deletes": (auditing.soft_deletes, "SELECT team, status, count(*) AS n FROM (SELECT c_mktsegment AS team, CASE WHEN c_custkey % 4 = 0 THEN 'removed' WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'kept' END AS status FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 4 <> 0) GROUP BY 1, 2", ()),
    "renamed_references": (auditing.renamed_references, "SELECT repository, key, count(DISTINCT number) AS \"references\" FROM (SELECT repository, CASE WHEN id % 9 IN (1, 2) THEN 'Q1' WHEN id % 9 = 5 THEN 'P6' ELSE 'P' || (id % 9) END AS key, id % 40 AS number FROM commits) GROUP BY 1, 2", ()),
    "activity_candidates": (auditing.activity_candidates, "SELECT team_key, count(*) AS candidates FROM (SELECT *, coalesce(completed_at, started_at) AS u FROM issues) WHERE (CASE WHEN issue_id % 3 <> 0 AND issue_id % 5 <> 0 THEN u END) IS DISTINCT FROM u AND NOT coalesce((CASE WHEN issue_id % 3 <> 0 AND issue_id % 10 = 0 THEN u END) = u, false) GROUP BY 1", ()),
}
