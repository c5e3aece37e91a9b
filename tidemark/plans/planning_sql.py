"""Queries of ``operators.planning`` with their SQL."""

from __future__ import annotations

from ..functions.planning import BOT_PARTS, BOT_WORDS
from ..operators import planning
from .rules_sql import CLASSIFIED


def _pick(values: list[str], n: int) -> str:
    return f"CASE issue_id % {n} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_BOT = "(" + " OR ".join(f"contains(lower(reporter), '{p}')" for p in BOT_PARTS) + f" OR regexp_matches(lower(reporter), '(^|[^\\pL\\pN])({'|'.join(BOT_WORDS)})([^\\pL\\pN]|$)'))"
_TICKETS = f"""tickets AS (SELECT issue_id, team_key, coalesce(children, 0) AS children, issue_id % 700 AS words, issue_id % 14 AS comments, issue_id % 17 AS transitions, estimate * 8 AS points,
  {_pick(planning.REPORTERS, 6)} AS reporter, {_pick(planning.TYPES, 5)} AS item_type, date_diff('day', CAST(created_at AS DATE), DATE '1998-08-02') AS age_days
  FROM issues LEFT JOIN (SELECT l_orderkey AS issue_id, count(*) AS children FROM lineitem GROUP BY 1) USING (issue_id)),
valued AS (SELECT *, lower(item_type) IN ('epic', 'feature', 'initiative') AND age_days < 7 AS late, floor(greatest(1.0::DOUBLE, least(50.0::DOUBLE, 1.0::DOUBLE + least(children, 10) * 2.0::DOUBLE + least(words / 40.0::DOUBLE, 12.0::DOUBLE)
  + least(comments, 10) * 0.8::DOUBLE + least(transitions, 12) * 0.5::DOUBLE + CASE WHEN points BETWEEN 0.5 AND 40 THEN least(points * 0.4::DOUBLE, 3.0::DOUBLE) ELSE 0.0::DOUBLE END)) * 100 + 0.5::DOUBLE) / 100.0::DOUBLE AS value FROM tickets),
scored AS (SELECT issue_id, CASE WHEN late THEN 'deferred_recent' ELSE 'scored' END AS status, CASE WHEN NOT late THEN value END AS score,
  CASE WHEN late THEN NULL WHEN value >= 30 THEN 'HIGH' WHEN value >= 15 THEN 'MEDIUM' ELSE 'LOW' END AS bucket FROM valued)"""
_SEEN = """members AS (SELECT n_regionkey AS domain, lower(n_name) AS member, n_nationkey FROM nation),
seen AS (SELECT DISTINCT domain, CASE c_custkey % 4 WHEN 0 THEN substr(member, 2) || 'x' WHEN 1 THEN reverse(member) WHEN 2 THEN member || 'son' ELSE substr(member, 1, 2) || substr(member, 4) END AS name FROM customer JOIN members ON c_nationkey = n_nationkey)"""
_EDGES = """edges AS (SELECT id, id // 2 AS parent FROM commits WHERE id > 1 UNION ALL SELECT id, id - 1 FROM commits WHERE is_merge AND id > 1),
reached AS (SELECT id AS tag, id FROM commits WHERE id % 1000 = 0 UNION SELECT tag, parent FROM reached JOIN edges USING (id))"""
_RIGHT = "sum(CASE WHEN id % 8 = 3 AND category <> 'maintenance' THEN 0 ELSE 1 END)"

#: name: (query, SELECT, further common table expressions)
QUERIES = {
    "ticket_effort": (planning.ticket_effort, "SELECT * FROM scored", (_TICKETS,)),
    "effort_summary": (planning.effort_summary, "SELECT status, bucket, count(*) AS n FROM scored GROUP BY 1, 2", (_TICKETS,)),
    "ticket_meaning": (planning.ticket_meaning, f"SELECT team_key, CASE WHEN {_BOT} THEN CASE WHEN issue_id % 4 < 2 THEN 'bot_filed' ELSE 'auto_generated' END WHEN issue_id % 9 <= 5 AND (issue_id % 3 = 0 OR words < 1) THEN 'terse_title' ELSE 'none' END AS reason, count(*) AS n FROM tickets GROUP BY 1, 2", (_TICKETS,)),
    "fuzzy_members": (planning.fuzzy_members, "SELECT domain, name, member, score FROM (SELECT *, row_number() OVER (PARTITION BY domain, name ORDER BY score DESC, member) AS place FROM (SELECT domain, name, member, round(jaro_winkler_similarity(name, member), 9) AS score FROM seen JOIN members USING (domain)) WHERE score >= 0.85::DOUBLE) WHERE place = 1", (_SEEN,)),
    "reachability": (planning.reachability, "SELECT id, count(*) AS tags, min(tag) AS first_tag FROM reached GROUP BY id", (_EDGES,)),
    "precision_curve": (planning.precision_curve, f"SELECT confidence, n, n * 100.0::DOUBLE / max(n) OVER () AS coverage_pct, hits * 100.0::DOUBLE / n AS precision_pct FROM (SELECT confidence, CAST(sum(k) OVER w AS BIGINT) AS n, CAST(sum(h) OVER w AS BIGINT) AS hits FROM (SELECT confidence, count(*) AS k, {_RIGHT} AS h FROM classified WHERE NOT is_merge GROUP BY 1) WINDOW w AS (ORDER BY confidence DESC ROWS UNBOUNDED PRECEDING))", (CLASSIFIED,)),
    "boilerplate": (planning.boilerplate, r"SELECT repository, regexp_matches(split_part(message, chr(10), 1), '^[Mm]erge branch|^[Mm]erge pull request|^[Bb]ump version|^[Uu]pdate package-lock|^[Uu]pdate yarn\.lock|[Gg]enerated by|[Aa]uto-generated') OR insertions + deletions > 5000 AS boilerplate, count(*) AS n FROM commits GROUP BY 1, 2", ()),
}
