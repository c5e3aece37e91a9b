"""Queries of ``operators.evaluation`` with their SQL; the clusters of findings depend on order and are tested against plain Python."""

from __future__ import annotations

from ..operators import evaluation
from .rules_sql import CLASSIFIED
from .linking_sql import _LINKS

_STRATUM = """CASE WHEN rule_id = 'catch-all' THEN 'catch_all' WHEN rule_id IS NULL OR lower(category) IN ('uncategorized', 'unknown') THEN 'unknown' WHEN method = 'exact' THEN 'exact'
  WHEN method = 'regex' AND confidence >= 0.9::DOUBLE THEN 'regex_high' WHEN method = 'regex' AND confidence BETWEEN 0.55::DOUBLE AND 0.7::DOUBLE THEN 'regex_mid' WHEN method = 'regex' THEN 'regex_other'
  WHEN method IN ('weighted_sum', 'fuzzy') THEN method ELSE 'other' END"""
_POPULATION = f"population AS (SELECT *, {_STRATUM} AS stratum FROM classified WHERE NOT is_merge AND ts >= (SELECT max(ts) FROM commits WHERE NOT is_merge) - INTERVAL 700 DAY)"
_SIZES = "sizes AS (SELECT stratum, count(*) AS n FROM {0} GROUP BY 1)"
_FILLED = """ranked AS (SELECT *, n * (count(*) OVER () - row_number() OVER (ORDER BY n, stratum) + 1) <= 200 - coalesce(sum(n) OVER (ORDER BY n, stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS whole FROM sizes),
opened AS (SELECT *, CAST(200 - sum(CASE WHEN whole THEN n ELSE 0 END) OVER () AS BIGINT) AS rest, greatest(count(*) FILTER (WHERE NOT whole) OVER (), 1) AS k, row_number() OVER (PARTITION BY whole ORDER BY stratum) AS turn FROM ranked),
filled AS (SELECT stratum, n, CASE WHEN whole THEN n ELSE rest // k + CASE WHEN turn <= rest % k THEN 1 ELSE 0 END END AS share FROM opened)"""
_CAPPED = "capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stratum, author_email ORDER BY md5('s1:' || sha), sha) AS nth FROM population) WHERE nth <= 40)"
_JUDGED = "judged AS (SELECT stratum, count(*) AS population, count(*) FILTER (WHERE id % 9 = 0) AS n, count(*) FILTER (WHERE id % 9 = 0 AND (id % 8 <> 3 OR category = 'maintenance')) AS correct FROM population GROUP BY 1), weighed AS (SELECT *, population / sum(population) OVER () AS w, correct / n AS p FROM judged WHERE n > 0)"
_Z = f"{evaluation.Z}::DOUBLE"
_MERGES = f"scaled AS (SELECT {_STRATUM} AS stratum, count(*) AS population, count(*) FILTER (WHERE id % 7 = 0) AS n, count(*) FILTER (WHERE id % 7 = 0 AND is_merge) AS merges FROM classified GROUP BY 1)"

#: name: (query, SELECT or None, further common table expressions)
QUERIES = {
    "strata": (evaluation.strata, "SELECT stratum, count(*) AS n, min(confidence) AS least, max(confidence) AS most FROM population GROUP BY 1", (CLASSIFIED, _POPULATION)),
    "allocation_by_stratum": (evaluation.allocation_by_stratum, "SELECT * FROM filled", (CLASSIFIED, _POPULATION, _SIZES.format("population"), _FILLED)),
    "stratified_draw": (evaluation.stratified_draw, "SELECT stratum, CAST(place AS INTEGER) AS place, sha, author_email FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('s1:' || sha), sha) AS place FROM capped) JOIN filled USING (stratum) WHERE place <= share", (CLASSIFIED, _POPULATION, _CAPPED, _SIZES.format("capped"), _FILLED)),
    "stratum_accuracy": (evaluation.stratum_accuracy, f"SELECT round(e, 9) AS estimate, round(greatest(e - {_Z} * s, 0.0::DOUBLE), 9) AS low, round(least(e + {_Z} * s, 1.0::DOUBLE), 9) AS high, c / (SELECT CAST(sum(population) AS DOUBLE) FROM judged) AS covered FROM (SELECT sum(w * p) AS e, sqrt(sum(w * w * p * (1 - p) / n)) AS s, CAST(sum(population) AS DOUBLE) AS c FROM weighed)", (CLASSIFIED, _POPULATION, _JUDGED)),
    "merge_scaling": (evaluation.merge_scaling, "SELECT stratum, population, removed, population - removed AS kept FROM (SELECT *, CASE WHEN n > 0 THEN CAST(least(floor(population * merges / greatest(n, 1) + 0.5::DOUBLE), population) AS BIGINT) ELSE 0 END AS removed FROM scaled)", (CLASSIFIED, _MERGES)),
    "ticket_coverage": (evaluation.ticket_coverage, "SELECT author, count(*) AS n, count(ticket) AS linked, count(*) FILTER (WHERE source = 'branch') AS by_branch, count(ticket) * 100.0::DOUBLE / count(*) AS pct FROM pull_requests LEFT JOIN links ON pr_number = id GROUP BY author", (_LINKS,)),
    "finding_trends": (evaluation.finding_trends, None, ()),
}
