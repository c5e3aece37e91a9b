"""Queries of ``operators.upkeep`` with their SQL."""

from __future__ import annotations

from ..operators import upkeep
from .linking_sql import _choice, _q


def _list(values: list[str]) -> str:
    return ", ".join(_q(v) for v in values)


_KINDS = f"""kinds AS (SELECT n, CASE WHEN name IN ({_list(upkeep.GENERATED_NAMES)}) OR split_part(name, '.', -1) IN ({_list(upkeep.GENERATED_ENDINGS)}) THEN 'generated' WHEN regexp_matches(lower(p), {_q(upkeep.TEST_PATH)}) THEN 'test' ELSE 'code' END AS kind
  FROM (SELECT *, split_part(p, '/', -1) AS name FROM (SELECT insertions + deletions AS n, path || CASE insertions % 9 WHEN 0 THEN '.svg' WHEN 1 THEN '/Cargo.lock' WHEN 2 THEN '/tests/a.rs' ELSE '' END AS p FROM files)))"""
_BRANCHES = f"branches AS (SELECT {_choice(['release/', 'release/x/', 'feature/a/b-', 'hotfix-', 'hotix-', 'main'], 'id')} || (id % 5) AS branch FROM commits)"
_WALKS = "walks AS (SELECT repository, CAST(substr(repository, 5) AS INTEGER) AS k FROM commits GROUP BY repository)"
_PAIRS = "both_sides AS (SELECT sha, author_email AS a FROM commits UNION ALL SELECT sha, 'dev' || (author_id % 89) || '@home.org' FROM commits WHERE id % 30 = 4)"

#: name: (query, SELECT, further common table expressions)
QUERIES = {
    "path_kinds": (upkeep.path_kinds, "SELECT kind, count(*) AS touches, CAST(sum(n) AS BIGINT) AS lines FROM kinds GROUP BY 1", (_KINDS,)),
    "branch_matches": (upkeep.branch_matches, "SELECT branch, count(*) AS commits FROM branches WHERE regexp_matches(branch, '^(release/[^/]*|feature/.*|hot[^/]ix-[^/]*)$') GROUP BY 1", (_BRANCHES,)),
    "reread": (upkeep.reread, "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE event_id % 4 <> 0) AS again FROM events JOIN (SELECT event_type, max(ts) AS mark FROM events WHERE event_id % 4 <> 0 GROUP BY 1) USING (event_type) WHERE ts >= mark GROUP BY 1", ()),
    "stale_versions": (upkeep.stale_versions, "SELECT repository, count(*) AS n, count(*) FILTER (WHERE id % 5 < 3 OR id % 31 = 0) AS stale FROM commits GROUP BY 1", ()),
    "walk_plan": (upkeep.walk_plan, "SELECT repository, CASE WHEN k % 5 = 0 OR k % 7 = 1 OR k % 11 = 2 THEN 'full' WHEN k % 3 = 0 THEN 'skip' ELSE 'incremental' END AS plan, CASE WHEN k % 5 = 0 THEN 'never walked' WHEN k % 7 = 1 THEN 'not finished' WHEN k % 11 = 2 THEN 'settings changed' WHEN k % 3 = 0 THEN 'same head' ELSE 'head moved' END AS why FROM walks", (_WALKS,)),
    "shared_commits": (upkeep.shared_commits, "SELECT src, dst, count(*) AS commits, 0.92::DOUBLE AS confidence FROM (SELECT min(a) AS src, max(a) AS dst FROM both_sides GROUP BY sha) WHERE src < dst GROUP BY 1, 2", (_PAIRS,)),
    "merge_risk": (upkeep.merge_risk, "SELECT author_email, commits, count(*) OVER (PARTITION BY author_email[1:4]) > 1 AS at_risk FROM (SELECT author_email, count(*) AS commits FROM commits WHERE NOT is_merge GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)", ()),
}
