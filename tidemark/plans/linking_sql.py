"""Queries of ``operators.linking`` with their SQL."""

from __future__ import annotations

from ..functions import linking as fx
from ..operators import linking
from .rules_sql import CLASSIFIED


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _choice(values: list[str], n: str) -> str:
    return f"CASE {n} % {len(values)} " + " ".join(f"WHEN {i} THEN {_q(v)}" for i, v in enumerate(values)) + " END"


def _found(text: str, pattern: str) -> str:
    return f"nullif(regexp_extract({text}, {_q(pattern)}, 1), '')"


def _project(key: str) -> str:
    return f"CASE WHEN split_part({key}, '-', 1) NOT IN ({', '.join(map(_q, fx.NOT_PROJECTS))}) THEN {key} END"


def _subject(text: str) -> str:
    key = _found(f"regexp_replace(split_part({text}, chr(10), 1), {_q(fx.SUBJECT_LEAD)}, '')", fx.KEY_AT_START)
    return f"coalesce({_found(text, fx.BOARD_ITEM)}, {_project(key)}, {_found(text, fx.BARE_NUMBER)})"


_BRANCH = f"list_filter(list_transform(string_split(regexp_replace(trim(branch), '^refs/heads/', ''), '/'), lambda s: {_project(_found('s', fx.KEY_IN_SEGMENT))}), lambda k: k IS NOT NULL)[1]"
_LINKS = f"""sources AS (SELECT id, message, CASE id % 6 WHEN 0 THEN 'refs/heads/feature/PROJ-' || id || '-thing' WHEN 1 THEN 'fix/ADR-0029-followup' WHEN 2 THEN 'fix/' || id || '-harvest' WHEN 3 THEN 'ENG-' || id WHEN 4 THEN 'main' ELSE 'team/x/OPS-' || id || '_b' END AS branch,
  CASE id % 4 WHEN 0 THEN 'Closes #' || id WHEN 1 THEN 'see #' || id WHEN 2 THEN 'Rework. fixed  #' || id || ' too' END AS body, CASE id % 7 WHEN 0 THEN 'fix(x): [PROJ-9] title' WHEN 1 THEN 'UTF-8 AB#17 title' ELSE 'plain title' END AS title FROM commits),
keyed AS (SELECT id, {_subject('message')} AS c, {_BRANCH} AS b, {_subject('title')} AS t, {_found('body', fx.CLOSING)} AS d FROM sources),
links AS (SELECT id, coalesce(c, b, t, d) AS ticket, CASE WHEN c IS NOT NULL THEN 'commit' WHEN b IS NOT NULL THEN 'branch' WHEN t IS NOT NULL THEN 'title' WHEN d IS NOT NULL THEN 'body' END AS source FROM keyed)"""
_ITEMS = """items AS (SELECT 'ENG-' || issue_id AS ticket, 'linear' AS tracker, issue_id FROM issues WHERE issue_id % 2 = 1 UNION ALL SELECT 'PROJ-' || issue_id, 'jira', issue_id FROM issues WHERE issue_id % 3 = 0 UNION ALL SELECT '#' || issue_id, 'github', issue_id FROM issues WHERE issue_id % 5 = 2)"""
_KINDS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in linking.ISSUE_TYPES.items())
_WHERE = {"trailer": f"array_to_string(regexp_extract_all(m, {_q(fx.TRAILER)}, 1), chr(10))", "message": "m", "email": "e"}
_MARKS = "CASE " + " ".join(f"WHEN regexp_matches({_WHERE[scope]}, {_q(p)}) THEN {{'tool': '{tool}', 'mode': '{mode}', 'method': '{scope}'}}" for want in ("full_agentic", "ide_assisted") for tool, mode, scope, p in fx.MARKS if mode == want)
_MARKS += f" ELSE {{'tool': NULL, 'mode': CASE WHEN regexp_matches(m, {_q(fx.STRIPPED)}) OR regexp_matches(m, {_q(fx.TITLE_ONLY)}) THEN 'unknown' ELSE 'none' END, 'method': NULL}} END"
_MARKED = f"""marked AS (SELECT id, {_MARKS} AS x FROM (SELECT id, CASE WHEN id % 3 = 0 THEN message ELSE message || chr(10) || chr(10) || 'Body text.' || chr(10) || {_choice(linking.TRAILERS, '(id // 3)')} || chr(10) END AS m,
  CASE WHEN id % 50 = 7 THEN 'devin-ai-integration[bot]@users.x' ELSE author_email END AS e FROM commits))"""


def _points(name: str, bag: list[str]) -> str:
    hits = " + ".join(f"CAST(contains(t, '{w}') AS INTEGER)" for w in bag) or "0"
    return (f"{{'points': [{', '.join(map(str, fx.BY_HITS))}][least({hits}, 3) + 1] + CASE WHEN regexp_matches(trim(message), '^[A-Z][A-Z0-9]+-[0-9]+') THEN {fx.TICKET} ELSE 0 END"
            f" + CASE WHEN n < 12 THEN {fx.SHORT.get(name, 0)} WHEN n > 80 THEN {fx.LONG.get(name, 0)} ELSE 0 END + CASE WHEN is_merge OR starts_with(t, 'merge ') THEN {65 if name == 'merge' else -5} ELSE 0 END, 'category': '{name}'}}")  # fmt: skip


_VOTES = f"""votes AS (SELECT id, [{', '.join(_points(*b) for b in fx.BAGS.items())}] AS s FROM (SELECT *, lower(trim(message)) AS t, strlen(trim(message)) AS n FROM commits)),
best AS (SELECT id, CASE WHEN len(list_filter(s, lambda x: x.points = list_max(s).points)) = 1 AND list_max(s).points >= {fx.LEAST} THEN list_max(s) END AS v FROM votes)"""
_WORDS = "ruled_words AS (" + " UNION ALL ".join(f"SELECT id, {-p} AS p, length(regexp_extract(lower(message), '(?s)^(.*?)\\b{w}\\b', 1)) AS pos, '{i}' AS rule_id, '{c}' AS category, {x}::DOUBLE AS confidence FROM commits WHERE regexp_matches(lower(message), '\\b{w}\\b')" for i, c, w, p, x in linking.WORDS) + ")"
_PATHS = f"mapped(prefix, category) AS (VALUES {', '.join(map(str, linking.PATHS))}), paths AS (SELECT path, count(*) AS n FROM files GROUP BY path)"
_ADDRESSES = """addresses AS (SELECT email, split_part(email, '@', 1) AS local, split_part(email, '@', 2) AS domain FROM (SELECT DISTINCT CASE c_custkey % 5 WHEN 0 THEN l || '@host' || (c_custkey % 7) || '.local' WHEN 1 THEN (c_custkey % 1000) || '+' || l || '@users.noreply.github.com'
  WHEN 2 THEN l || '@exmaple.com' ELSE l || '@example.com' END AS email FROM (SELECT *, 'dev' || (c_custkey % 37) AS l FROM customer))),
odd AS (SELECT email AS src, CASE WHEN domain = 'users.noreply.github.com' THEN split_part(local, '+', 2) ELSE local END AS local, CASE WHEN domain LIKE '%.local' THEN 'machine' WHEN domain = 'users.noreply.github.com' THEN 'login' WHEN levenshtein(domain, 'example.com') BETWEEN 1 AND 2 THEN 'typo' END AS reason FROM addresses)"""
_NORM = "trim(regexp_replace(lower({0}), '[.\\-_\\s]+', ' ', 'g'))"
_SPELLED = """spelled AS (SELECT DISTINCT n_regionkey AS domain, 'dev' || CASE s_suppkey % 3 WHEN 0 THEN '.' WHEN 1 THEN '-' ELSE '_' END || replace(lower(n_name), '_', '.') || CASE WHEN s_suppkey % 4 = 3 THEN 'x' ELSE '' END AS local FROM supplier JOIN nation ON s_nationkey = n_nationkey),
members AS (SELECT n_regionkey AS domain, 'Dev ' || lower(n_name) AS member FROM nation)"""

#: name: (query, SELECT, further common table expressions)
QUERIES = {
    "ticket_links": (linking.ticket_links, "SELECT * FROM links", (_LINKS,)),
    "ticketed_stats": (linking.ticketed_stats, "SELECT coalesce(source, 'none') AS source, count(*) AS n, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM links) AS pct FROM links GROUP BY 1", (_LINKS,)),
    "commit_pull_requests": (linking.commit_pull_requests, "SELECT commit_id, min(pr_number) AS first_pr, max(pr_number) AS last_pr, count(*) AS pull_requests FROM (SELECT pr_number, unnest(list_distinct([pr_number, pr_number + 1, pr_number * 2])) AS commit_id FROM pull_requests WHERE state = 'merged') WHERE commit_id IN (SELECT id FROM commits) GROUP BY 1", ()),
    "correlation_counts": (linking.correlation_counts, "SELECT 'commits' AS what, count(*) AS n, count(*) FILTER (WHERE ticket IN (SELECT ticket FROM items)) AS linked FROM links UNION ALL SELECT tracker, count(*), count(*) FILTER (WHERE ticket IN (SELECT ticket FROM links WHERE ticket IS NOT NULL)) FROM items GROUP BY tracker", (_LINKS, _ITEMS)),
    "issue_type_categories": (linking.issue_type_categories, f"SELECT CASE lower(kind) {_KINDS} ELSE '(none)' END AS category, count(*) AS n FROM (SELECT id, arg_min({_choice(['Story', 'bug', 'Task', 'Tech Debt', 'spike', 'oddity'], 'issue_id')}, (tracker, issue_id)) AS kind FROM links JOIN items USING (ticket) GROUP BY id) GROUP BY 1", (_LINKS, _ITEMS)),
    "authorship_marks": (linking.authorship_marks, "SELECT id, x.tool AS tool, x.mode AS mode, x.method AS method FROM marked", (_MARKED,)),
    "weighted_votes": (linking.weighted_votes, "SELECT id, v.category AS category, CASE WHEN v.points > 95 THEN 95 ELSE v.points END / 100.0::DOUBLE AS confidence FROM best", (_VOTES,)),
    "exact_words": (linking.exact_words, "SELECT id, rule_id, category, confidence FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p, pos, rule_id) AS place FROM ruled_words) WHERE place = 1", (_WORDS,)),
    "path_map": (linking.path_map, "SELECT coalesce(category, '(unmapped)') AS category, CAST(sum(n) AS BIGINT) AS touches, count(*) AS paths FROM (SELECT path, n, (SELECT arg_max(category, length(prefix)) FROM mapped WHERE path = prefix OR starts_with(path, prefix || '/')) AS category FROM paths) GROUP BY 1", (_PATHS,)),
    "excerpts": (linking.excerpts, "SELECT doc_id, length(x) AS n_chars, sha256(x) AS excerpt_sha256 FROM (SELECT doc_id, CASE WHEN length(t) > 200 THEN substr(t, 1, 200) || '…' ELSE t END AS x FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '<email>', 'g') AS t FROM documents))", ()),
    "identity_suggestions": (linking.identity_suggestions, "SELECT src, a.email AS dst, CASE WHEN reason = 'typo' THEN 0.88::DOUBLE ELSE 0.9::DOUBLE END AS confidence, reason FROM odd JOIN addresses a ON odd.local = a.local WHERE reason IS NOT NULL AND src <> a.email AND (a.domain = 'example.com' OR reason = 'login')", (_ADDRESSES,)),
    "normalised_members": (linking.normalised_members, f"SELECT domain, local, member, score FROM (SELECT *, row_number() OVER (PARTITION BY domain, local ORDER BY score DESC, member) AS place FROM (SELECT domain, local, member, round(jaro_winkler_similarity({_NORM.format('local')}, {_NORM.format('member')}), 9) AS score FROM spelled JOIN members USING (domain)) WHERE score >= 0.82) WHERE place = 1", (_SPELLED,)),
    "review_candidates": (linking.review_candidates, "SELECT pr_number, repository, updated_at FROM (SELECT *, coalesce(merged_at, created_at) AS updated_at, CASE WHEN pr_number % 3 <> 0 THEN created_at + to_days(CAST(pr_number % 30 AS INTEGER)) END AS checked_at FROM pull_requests) WHERE checked_at IS NULL OR updated_at > checked_at ORDER BY updated_at DESC, pr_number DESC LIMIT 50", ()),
    "picked_commits": (linking.picked_commits, """SELECT author_email, CAST(place AS INTEGER) AS place, id, category, size FROM (SELECT *, row_number() OVER (PARTITION BY author_email ORDER BY turn, CASE WHEN turn = 9 THEN size END DESC NULLS LAST, ts DESC, id DESC) AS place FROM (SELECT *, insertions + deletions AS size,
      CASE WHEN row_number() OVER (PARTITION BY author_email, category ORDER BY ts DESC, id DESC) > 1 THEN 9 WHEN category = 'bugfix' THEN 1 WHEN category = 'feature' THEN 2 WHEN category = 'refactor' THEN 3 ELSE 9 END AS turn FROM classified WHERE NOT is_merge)) WHERE place <= 5""", (CLASSIFIED,)),
}
