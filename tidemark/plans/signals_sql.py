"""The SQL of tracker signals over the model's commits: references unnested, joined to mapped issues, above the verdicts of words and patterns."""

from __future__ import annotations

from ..operators import rule_engine as engine
from ..operators import signals
from . import rules_sql
from .rules_sql import _map, _q

_MAPPED = ", ".join(f"({_q(s)}, {_q(f)}, {signals.FIELDS.index(f)}, {_q(v)}, {_q(c)}, {signals.CONFIDENCE if n is None else n}::DOUBLE)" for s, f, v, c, n in signals.MAPPED)
_ISSUES = f"""mapped (source, fname, field, value, category, confidence) AS (VALUES {_MAPPED}),
said AS (SELECT 'numbers' AS source, 'repo' || (issue_id % 25) || '#' || issue_id AS key, 1 AS field, unnest(regexp_extract_all(title, '\\[([^\\]]+)\\]', 1)) AS value, unnest(range(10)) AS place FROM issues WHERE title LIKE '[%'
  UNION ALL SELECT 'numbers', 'repo' || (issue_id % 25) || '#' || issue_id, 2, state_type, 100 FROM issues
  UNION ALL SELECT 'keys', 'PROJ-' || n_nationkey, 0, r_name, 0 FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'keys', 'PROJ-' || n_nationkey, 1, n_name, 1 FROM nation),
known AS (SELECT source, key, arg_min({{'c': category, 's': confidence, 'n': source || ':' || fname || ':' || value}}, (field, place)) AS k FROM said JOIN mapped USING (source, field, value) GROUP BY 1, 2),
refs AS (SELECT sha, 1 AS rank, 'keys' AS source, unnest(regexp_extract_all(message, '\\b([A-Z][A-Z0-9]{{0,9}}-[0-9]+)', 1)) AS key, unnest(range(10)) AS place FROM commits WHERE message LIKE '%-%'
  UNION ALL SELECT sha, 2, 'numbers', repository || '#' || unnest(regexp_extract_all(message, '(?:^|[\\s(])#([0-9]+)', 1)), unnest(range(10)) FROM commits WHERE contains(message, '#')),
sig AS (SELECT sha, arg_min(k, (rank, place)) AS k FROM refs JOIN known USING (source, key) GROUP BY sha)"""
_SELECT = f"""SELECT sha, rule_id, category, confidence, method, {_map(engine.TOP_LEVEL, "category", "unknown")} AS top_level
FROM (SELECT sha, CASE WHEN use THEN k.n ELSE rule_id END AS rule_id, CASE WHEN use THEN k.c ELSE category END AS category, CASE WHEN use THEN k.s ELSE confidence END AS confidence, CASE WHEN use THEN 'external_source' ELSE method END AS method
      FROM (SELECT *, k IS NOT NULL AND method <> 'manual' AS use FROM named LEFT JOIN sig USING (sha)))"""

QUERIES = {"signalled_commits": (signals.signalled_commits, _SELECT, (rules_sql.MORE, _ISSUES))}
