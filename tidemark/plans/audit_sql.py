"""The SQL of spreads rounded by exact binary value, and of an audit's outcomes."""

from __future__ import annotations

from ..operators import distributions, sweep

# x = m / 2 ** k with whole m: ten times it is cut at bit k, the rest compared with a half
_ROUNDED = """parts AS (SELECT *, 53 - CAST(floor(log2(abs(x))) AS INTEGER) AS k FROM marks WHERE abs(x) >= 0.01),
wholes AS (SELECT *, CAST(abs(x) * pow(2, k) AS BIGINT) * 10 AS ten FROM parts), cuts AS (SELECT *, ten >> k AS cut, ten & ((1::BIGINT << k) - 1) AS rest, 1::BIGINT << (k - 1) AS half FROM wholes),
rounded AS (SELECT * EXCLUDE (x, k, ten, cut, rest, half), sign(x) * (cut + CASE WHEN rest > half OR (rest = half AND cut % 2 = 1) THEN 1 ELSE 0 END) / 10.0::DOUBLE AS v FROM cuts UNION ALL SELECT * EXCLUDE (x), 0.0::DOUBLE FROM marks WHERE abs(x) < 0.01)"""


def _spread(group: str, rows: str) -> tuple[str, tuple]:
    # interpolated as lower + (upper - lower) * fraction
    at = lambda p: f"(n - 1) * {p}::DOUBLE"
    mark = lambda p: f"vs[CAST(floor({at(p)}) AS BIGINT) + 1] + (vs[least(CAST(floor({at(p)}) AS BIGINT) + 2, n)] - vs[CAST(floor({at(p)}) AS BIGINT) + 1]) * ({at(p)} - floor({at(p)}))"
    marks = " UNION ALL ".join(f"SELECT {group}, n, '{name}' AS mark, {mark(p)} AS x FROM lists" for p, name in distributions.MARKS)
    more = f"lists AS (SELECT {group}, count(v) AS n, list_sort(list(v)) AS vs FROM ({rows}) WHERE v IS NOT NULL GROUP BY {group}), marks AS ({marks})"
    columns = ", ".join(f"max(v) FILTER (WHERE mark = '{name}') AS {name}" for _, name in distributions.MARKS)
    return f"SELECT {group}, n, {columns} FROM rounded GROUP BY {group}, n", (more, _ROUNDED)


_LEADS = "SELECT team_key, year(completed_at) AS y, date_diff('microsecond', created_at, completed_at) // 1000000 * 1000.0::DOUBLE / 86400000.0::DOUBLE AS v FROM issues WHERE completed_at IS NOT NULL"
_TEXTS = "SELECT unnest([lang, '(all)']) AS lang, length(text) / 1000.0::DOUBLE AS v FROM documents"
_TICKET = "coalesce(nullif(regexp_extract(message, '\\b([A-Z][A-Z0-9]+-[0-9]+)\\b', 1), ''), nullif(regexp_extract(message, '(#[0-9]+)', 1), ''))"
_LEAD_ROWS = "SELECT count(*) FROM (SELECT date_diff('microsecond', c.ts, d.triggered_at) AS us FROM deployments d JOIN commits c ON d.git_sha = c.sha WHERE status = 'success') WHERE us > -1000000"
_COUNTS = {
    "collect": "SELECT count(*) FROM commits", "correlate": f"SELECT count({_TICKET}) FROM commits", "classify": "SELECT count(DISTINCT category) FROM classified WHERE NOT is_merge", "issue sync": "SELECT count(*) FROM issues",
    "deployments": "SELECT count(*) FROM deployments", "incidents": "SELECT count(*) FROM incidents", "rollbacks": "SELECT count(*) FROM deployments WHERE status = 'rolled back'", "delivery": _LEAD_ROWS,
    "pr metrics": "SELECT count(DISTINCT author) FROM pull_requests", "report": "SELECT count(DISTINCT strftime(ts, '%G-W%V')) FROM commits WHERE NOT is_merge",
}
_NAMES = ["collect", "correlate", "classify", "key sync", "issue sync", "deployments", "incidents", "rollbacks", "delivery", "recovery", "pr metrics", "report"]
_BAD = {"key sync": ("skipped", "no tracker of keyed issues is set up"), "rollbacks": ("failed", "no rows"), "recovery": ("failed", "needs rollbacks")}


def _row(place: int, name: str) -> str:
    status, reason = _BAD.get(name, ("succeeded", None))
    rows = f"({_COUNTS[name]})" if name in _COUNTS else "CAST(NULL AS BIGINT)"
    return f"SELECT CAST({place} AS BIGINT) AS place, '{name}' AS stage, '{status}' AS status, {'NULL' if reason is None else chr(39) + reason + chr(39)} AS reason, {rows} AS n_rows"


def queries(classified: str) -> dict:
    return {
        "lead_spread": (distributions.lead_spread, *_spread("team_key, y", _LEADS)),
        "text_spread": (distributions.text_spread, *_spread("lang", _TEXTS)),
        "audit_sweep": (sweep.audit_sweep, " UNION ALL ".join(_row(k, n) for k, n in enumerate(_NAMES)), (classified,)),
    }
