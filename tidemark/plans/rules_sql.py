"""The SQL of the whole cascade over the model's commits: words as a table joined to the distinct messages, patterns as one ordered expression."""

from __future__ import annotations

from ..operators import rule_engine as engine


def _q(value) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def _map(values: dict, key: str, missing: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in values.items()) + f" ELSE {_q(missing)} END"


_WORDS = ", ".join(f"({_q(w.lower())}, {k}, {r[3]})" for k, r in enumerate(engine.RULES) for w in r[5])
_RULES = ", ".join(f"({k}, {_q(r[0])}, {_q(r[1])}, {_q(r[2])}, {r[4]}::DOUBLE)" for k, r in enumerate(engine.RULES))
_PATTERNS = "CASE " + " ".join(f"WHEN regexp_matches(message, {_q(p)}) THEN {k}" for _, k, p in sorted((-r[3], k, p) for k, r in enumerate(engine.RULES) for p in r[6])) + " END"
_EDGE = "regexp_matches(substr(low, {}, 1), '[\\pL\\pN_]')"

TOLD = f"""messages AS (SELECT message, lower(message) AS low FROM commits GROUP BY message),
words (word, k, priority) AS (VALUES {_WORDS}), rules (k, rule_id, category, subcategory, confidence) AS (VALUES {_RULES}),
hits AS (SELECT message, low, word, k, priority, strpos(low, word) AS spot FROM messages JOIN words ON contains(low, word)),
whole AS (SELECT * FROM hits WHERE NOT (regexp_matches(word, '^[\\pL\\pN_]') AND spot > 1 AND {_EDGE.format("spot - 1")}) AND NOT (regexp_matches(word, '[\\pL\\pN_]$') AND {_EDGE.format("spot + length(word)")})),
exact AS (SELECT message, arg_min(k, ROW(-priority, spot)) AS k FROM whole GROUP BY message),
told AS (SELECT message, coalesce(exact.k, {_PATTERNS}) AS k, CASE WHEN exact.k IS NULL THEN 'regex' ELSE 'exact' END AS method FROM messages LEFT JOIN exact USING (message))"""
MORE = f"""{TOLD},
judged AS (SELECT sha, message, id % 19 = 0 AS manual, rule_id, category, subcategory, confidence, method FROM commits JOIN told USING (message) JOIN rules USING (k)),
named AS (SELECT sha, message, CASE WHEN manual THEN 'manual_override' ELSE rule_id END AS rule_id, CASE WHEN manual THEN 'platform' ELSE category END AS category, CASE WHEN NOT manual THEN subcategory END AS subcategory,
  CASE WHEN manual THEN 1.0::DOUBLE ELSE confidence END AS confidence, CASE WHEN manual THEN 'manual' ELSE method END AS method FROM judged)"""
#: Every commit with its verdict and the first line of its message in lower case.
CLASSIFIED = f"""{TOLD},
classified AS (SELECT commits.*, lower(split_part(commits.message, chr(10), 1)) AS line, rule_id, category, subcategory, confidence, method, {_map(engine.TOP_LEVEL, "category", "unknown")} AS top_level,
  {_map(engine.BUCKET, "category", engine.NO_BUCKET)} AS bucket FROM commits JOIN told ON told.message = commits.message JOIN rules ON rules.k = told.k)"""
SELECT = f"""SELECT sha, rule_id, category, subcategory, confidence, method, {_map(engine.TOP_LEVEL, "category", "unknown")} AS top_level, {_map(engine.BUCKET, "category", engine.NO_BUCKET)} AS bucket, nullif(regexp_extract(message, '\\b[A-Z][A-Z0-9]+-[0-9]+\\b'), '') AS ticket_id
FROM named"""
