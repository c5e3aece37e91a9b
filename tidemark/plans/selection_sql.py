"""Queries of ``operators.selection`` and ``operators.work_items`` with their SQL."""

from __future__ import annotations

from ..functions import textfx
from ..operators import contributors, evaluation, selection, upkeep, work_items
from ..operators.classify import FORMER_SQL
from .linking_sql import _q
from .rules_sql import CLASSIFIED

_REVERTED = f"regexp_matches(line, '{textfx.REVERT}')"
_AT = "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')"
_WEEKS = f"""weeks AS (SELECT author_email, isoyear(ts) * 100 + week(ts) AS yw, count(*) AS n, count(*) FILTER (WHERE {_REVERTED}) AS r, count(*) FILTER (WHERE category = 'bugfix') AS b, count(*) FILTER (WHERE ticketed) AS t
  FROM classified WHERE NOT is_merge GROUP BY 1, 2)"""
_SCORED = """scored AS (SELECT *, CASE WHEN raw <= 6 THEN 1 WHEN raw <= 10 THEN 2 WHEN raw <= 14 THEN 3 WHEN raw <= 18 THEN 4 ELSE 5 END AS size FROM (SELECT round(log2(loc + 1) + 1.5::DOUBLE * log2(n + 1) + (1 - 0.3::DOUBLE * least(tests / greatest(loc, 1), 1.0::DOUBLE)), 9) AS raw
  FROM (SELECT CAST(sum(insertions + deletions) AS BIGINT) AS loc, count(DISTINCT path) AS n, CAST(sum(CASE WHEN path LIKE '%\\_test.rs' ESCAPE '\\' THEN insertions + deletions ELSE 0 END) AS BIGINT) AS tests FROM files GROUP BY commit_id)))"""
_BAD = """bad AS (SELECT deploy_id FROM (SELECT d.deploy_id, arg_min(c.message, (c.ts, c.id)) AS m FROM deployments d JOIN activity c ON d.repo = c.repository AND NOT c.is_merge AND c.ts > d.triggered_at AND c.ts <= d.triggered_at + INTERVAL 24 HOUR GROUP BY 1) WHERE starts_with(m, 'hotfix'))"""
_TOOK = "took AS (SELECT triggered_at, status, us // 1000000 AS s FROM (SELECT d.*, date_diff('microsecond', c.ts, d.triggered_at) AS us FROM deployments d JOIN commits c ON d.git_sha = c.sha) WHERE us > -1000000)"
_CYCLES = "cycles AS (SELECT date_diff('microsecond', created_at, merged_at) // 1000000 AS s FROM pull_requests WHERE merged_at IS NOT NULL), cycled AS (SELECT count(*) AS p, CAST(sum(s) FILTER (WHERE s / 3600.0 BETWEEN 0.5 AND 720) AS DOUBLE) / count(*) FILTER (WHERE s / 3600.0 BETWEEN 0.5 AND 720) / 3600.0 AS proxy FROM cycles)"


def _period(name: str, year: int) -> str:
    inside = f"triggered_at BETWEEN TIMESTAMP '{year}-01-01' AND TIMESTAMP '{year}-12-31'"
    return f"""SELECT '{name}' AS period, CASE WHEN d > 0 THEN d ELSE p END / 52 AS per_week, CASE WHEN d > 0 THEN 'deployments' ELSE 'merge_proxy' END AS frequency_source, coalesce(m, proxy) AS lead_hours,
  CASE WHEN m IS NOT NULL THEN 'measured' WHEN proxy IS NOT NULL THEN 'proxy' ELSE 'unmeasurable' END AS lead_source FROM cycled, (SELECT count(*) AS d FROM deployments WHERE {inside}), (SELECT CAST(sum(s) AS DOUBLE) / count(*) / 3600.0 AS m FROM took WHERE {inside})"""


_MACHINE = " OR ".join(f"contains(who, {_q(mark)})" for mark in selection.BOTS)
_ITEMS = """items AS (SELECT *, 'dev' || (o_custkey % 97) AS who FROM orders)"""
_URLS = f"""urls AS (SELECT issue_id, team_key || '-' || issue_id AS identifier, CASE issue_id % 4 WHEN 0 THEN 'http://www.github.com/' WHEN 1 THEN 'https://example.org/' ELSE 'https://github.com/' END || 'Org/Repo' || (issue_id % 25) ||
  CASE issue_id % 6 WHEN 0 THEN '/pull/' || issue_id WHEN 1 THEN '/pull/' || issue_id || '/files#r1' WHEN 2 THEN '/issues/' || issue_id WHEN 3 THEN '/pull/0' ELSE '/pull/' || issue_id || '?a=b' END AS url FROM issues),
named AS (SELECT identifier, lower(regexp_extract(url, {_q(work_items.PULL_REQUEST)}, 1)) AS slug, TRY_CAST(regexp_extract(url, {_q(work_items.PULL_REQUEST)}, 2) AS BIGINT) AS number FROM urls)"""

_ASKED = """asked AS (SELECT DISTINCT query, lower(query) AS low FROM (SELECT CASE c_custkey % 4 WHEN 0 THEN 'dev' || c_custkey || '@EXAMPLE.com' WHEN 1 THEN 'DEV ' || (c_custkey % 24) WHEN 2 THEN 'log_' || (c_custkey % 90) ELSE (c_custkey % 70) || '%' END AS query FROM customer)),
parts AS (SELECT query, min(s_suppkey) AS a FROM asked JOIN supplier ON contains('["log_' || (s_suppkey * 7 % 60) || '%x"]', low) GROUP BY 1)"""

#: name: (query, SELECT, further common table expressions)
QUERIES = {
    "person_commits": (selection.person_commits, "SELECT category, count(*) AS n FROM classified WHERE NOT is_merge AND lower(CASE WHEN id % 7 = 0 THEN 'dev' || (id % 97) || '@example.com' ELSE author_email END) = 'dev7@example.com' GROUP BY 1", (CLASSIFIED,)),
    "author_categories": (selection.author_categories, f"SELECT author_email, category, count(*) AS n FROM (SELECT *, lower(author_name || CASE WHEN author_id % 41 = 0 THEN ' [Bot]' ELSE '' END || ' ' || author_email) AS who FROM classified WHERE NOT is_merge) WHERE NOT ({_MACHINE}) GROUP BY 1, 2", (CLASSIFIED,)),
    "span_commits": (selection.span_commits, f"SELECT repository, count(*) AS n, min(stamp) AS first_at, max(stamp) AS last_at FROM (SELECT repository, {_AT} AS stamp FROM commits) WHERE stamp >= '1995-03-01' AND stamp <= '1996-06-30T23:59:59Z' GROUP BY 1", ()),
    "average_quality": (selection.average_quality, "SELECT author_email, count(*) AS weeks, round(avg(0.35::DOUBLE * (1 - r / n) + 0.40::DOUBLE * (1 - b / n) + 0.25::DOUBLE * (t / n)), 9) AS score FROM weeks WHERE yw BETWEEN 199510 AND 199620 GROUP BY 1", (CLASSIFIED, _WEEKS)),
    "unresolved": (selection.unresolved, "SELECT repository, count(*) AS n, count(*) FILTER (WHERE author_id % 29 = 0) AS unresolved FROM commits WHERE NOT is_merge GROUP BY 1", ()),
    "effort_quintiles": (selection.effort_quintiles, "SELECT CASE WHEN total < 5 THEN size WHEN raw < p[1] THEN 1 WHEN raw < p[2] THEN 2 WHEN raw < p[3] THEN 3 WHEN raw < p[4] THEN 4 ELSE 5 END AS band, count(*) AS n, min(size) AS least, max(size) AS most FROM scored, (SELECT quantile_disc(raw, [0.2, 0.4, 0.6, 0.8]) AS p, count(*) AS total FROM scored) GROUP BY 1", (_SCORED,)),
    "newest_untracked": (selection.newest_untracked, f"SELECT sha, {_AT} AS stamp, CASE WHEN length(l) > 20 THEN l[1:20] || chr(10) || '[truncated ' || (length(l) - 20) || ' characters]' ELSE l END AS subject FROM (SELECT *, split_part(message, chr(10), 1) AS l FROM commits WHERE NOT ticketed) ORDER BY stamp DESC, sha LIMIT 50", ()),
    "evidence_kept": (selection.evidence_kept, "SELECT event_type AS query, count(*) AS n, min(value) AS least FROM events JOIN (SELECT event_type, max(value) AS best FROM events GROUP BY 1) USING (event_type) WHERE best <= 0 OR value >= best * 0.5 GROUP BY 1", ()),
    "delivery_totals": (selection.delivery_totals, """SELECT deployments, weeks, CASE WHEN weeks = 0 THEN 0.0::DOUBLE ELSE deployments / weeks END AS per_week, lead_hours, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE f / n END AS failure_rate, mttr_hours
  FROM (SELECT count(*) FILTER (WHERE status = 'success') AS deployments, count(DISTINCT CASE WHEN status = 'success' THEN strftime(triggered_at, '%Y-W%W') END) AS weeks, count(*) AS n, count(*) FILTER (WHERE deploy_id IN (SELECT deploy_id FROM bad)) AS f FROM deployments WHERE triggered_at >= TIMESTAMP '2024-01-10'),
  (SELECT CAST(sum(s) AS DOUBLE) / count(*) / 3600.0 AS lead_hours FROM took WHERE status = 'success'), (SELECT CAST(sum(date_diff('microsecond', detected_at, resolved_at) // 1000000) AS DOUBLE) / count(resolved_at) / 3600.0 AS mttr_hours FROM incidents)""", (_BAD, _TOOK)),
    "delivery_origin": (selection.delivery_origin, f"{_period('with', 2024)} UNION ALL {_period('without', 1990)}", (_TOOK, _CYCLES)),
    "delivery_period": (selection.delivery_period, f"""SELECT o.*, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE bad / n END AS failure_rate, gap AS mttr_hours,
  CASE WHEN o.per_week >= 1 AND coalesce(lead_hours, 1e300) < 1 AND bad / greatest(n, 1) < 0.15 AND gap < 1 THEN 'elite' WHEN o.per_week >= 0.25 AND coalesce(lead_hours, 1e300) < 168 AND bad / greatest(n, 1) < 0.3 AND gap < 24 THEN 'high'
       WHEN o.per_week >= 0.04 AND coalesce(lead_hours, 1e300) < 720 AND bad / greatest(n, 1) < 0.3 AND gap < 168 THEN 'medium' ELSE 'low' END AS level
  FROM (SELECT period, per_week * 52 / greatest(weeks, 1) AS per_week, frequency_source, lead_hours, lead_source FROM ({_period('with', 2024)}), (SELECT weeks FROM hotfixes) UNION ALL SELECT period, per_week * 52, frequency_source, lead_hours, lead_source FROM ({_period('without', 1990)})) o
  JOIN (SELECT 'with' AS period, n, bad, gap FROM hotfixes UNION ALL SELECT 'without', 0, 0, 0.0) USING (period)""", (_TOOK, _CYCLES, """hotfixes AS (SELECT count(*) AS n, count(DISTINCT strftime(ts, '%G-W%V')) AS weeks, count(*) FILTER (WHERE message LIKE 'hotfix%') AS bad,
  CAST(date_diff('microsecond', min(ts) FILTER (WHERE message LIKE 'hotfix%'), max(ts) FILTER (WHERE message LIKE 'hotfix%')) // 1000000 AS DOUBLE) / (count(*) FILTER (WHERE message LIKE 'hotfix%') - 1) / 3600.0 AS gap FROM activity WHERE NOT is_merge)""")),
    "failure_proxy": (selection.failure_proxy, f"SELECT repository, count(*) AS commits, greatest(count(*) FILTER (WHERE category = 'bugfix'), count(*) FILTER (WHERE {_REVERTED})) / count(*) AS rate FROM classified WHERE NOT is_merge GROUP BY 1", (CLASSIFIED,)),
    "work_item_fields": (work_items.work_item_fields, """SELECT CASE WHEN o_orderkey % 5 < 4 THEN who END AS reporter, count(*) AS n, count(*) FILTER (WHERE o_orderkey % 5 IN (0, 3)) AS described,
  count(DISTINCT CASE o_orderkey % 5 WHEN 0 THEN 'P-' || (o_orderkey % 50) WHEN 1 THEN '' || (o_orderkey % 40) WHEN 2 THEN 'L-' || (o_orderkey % 30) END) AS parents, min(CASE WHEN o_orderkey % 5 < 4 THEN CAST(o_orderdate AS DATE)::TIMESTAMP END) AS first_at, CAST(sum(CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 45 BETWEEN 1 AND 40 THEN o_orderkey % 45 END) AS DOUBLE) AS points FROM items GROUP BY 1""", (_ITEMS,)),
    "pull_request_items": (work_items.pull_request_items, "SELECT repository, count(*) AS links, min(number) AS first, max(identifier) AS last FROM (SELECT DISTINCT 'org/' || repository AS repository, number, identifier FROM named JOIN pull_requests ON slug = 'org/' || repository AND number = pr_number WHERE number > 0) GROUP BY 1", (_URLS,)),
    "contributor_queries": (contributors.contributor_queries, "SELECT query, coalesce(e, n, a) AS id, CASE WHEN e IS NOT NULL THEN 'email' WHEN n IS NOT NULL THEN 'name' WHEN a IS NOT NULL THEN 'alias' ELSE 'none' END AS how FROM asked LEFT JOIN (SELECT 'dev' || s_suppkey || '@example.com' AS low, min(s_suppkey) AS e FROM supplier GROUP BY 1) USING (low) LEFT JOIN (SELECT 'dev ' || (s_suppkey % 12) AS low, min(s_suppkey) AS n FROM supplier GROUP BY 1) USING (low) LEFT JOIN parts USING (query)", (_ASKED,)),
    "walk_states": (upkeep.walk_states_of_events, "SELECT repository, finished, first_head AS head, at_ AS changed_at FROM (SELECT repository, arg_max(k, ROW(ts, k)) = 'purchase' AS finished, arg_max(event_id, ROW(ts, event_id)) FILTER (WHERE k = 'purchase') AS first_head, max(ts) AS at_ FROM (SELECT 'repo' || (user_id % 25) AS repository, event_type AS k, ts, event_id FROM events WHERE event_type IN ('view', 'purchase')) GROUP BY 1)", ()),
    "repredicted": (evaluation.repredicted, "SELECT c.category AS before, n.category AS after, count(*) AS n, c.category IS DISTINCT FROM n.category AS changed FROM former c JOIN classified n USING (sha) GROUP BY 1, 2, 4", (CLASSIFIED, FORMER_SQL)),
}
