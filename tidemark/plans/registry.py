"""All queries over the engineering-activity model, with the SQL that gives the same rows in another engine."""

from __future__ import annotations

from ..functions import textfx
from ..operators import delivery, report, tracker
from .rules_sql import CLASSIFIED
from ..sources.model import PRELUDE
from . import audit_sql, auditing_sql, evaluation_sql, linking_sql, planning_sql, rules_sql, selection_sql, signals_sql, text_sql, upkeep_sql

_ISO = "strftime({0}, '%G-W%V')"
_CAL = "strftime({0}, '%Y-W%W')"
_REVERT = f"regexp_matches(split_part(message, chr(10), 1), '{textfx.REVERT}')"


def _if(condition: str) -> str:
    return f"CAST(count(*) FILTER (WHERE {condition}) AS BIGINT)"


_ACTIVITY = f"""SELECT {_ISO.format('ts')} AS week_label, author_email, repository, count(*) AS commits, CAST(sum(insertions) AS BIGINT) AS insertions, CAST(sum(deletions) AS BIGINT) AS deletions, CAST(sum(files_changed) AS BIGINT) AS files,
  {_if('ticketed')} AS ticketed, {_if('is_ai_assisted')} AS ai_assisted, {_if(_REVERT)} AS reverts, {_if("category = 'bugfix'")} AS bugfixes, {_if("category = 'feature'")} AS features FROM classified WHERE NOT is_merge GROUP BY 1, 2, 3"""
_HOURS = "date_diff('microsecond', created_at, merged_at) // 1000000"
_CYCLE = f"SELECT *, {_HOURS} AS s, ({_HOURS}) / 3600.0 AS h FROM pull_requests WHERE state = 'merged'"
_CYCLES = f"""SELECT count(*) FILTER (WHERE kept) AS merged, CAST(sum(s) FILTER (WHERE kept) AS DOUBLE) / count(*) FILTER (WHERE kept) / 3600.0 AS avg_hours, list_sort(list(CAST(h AS DOUBLE)) FILTER (WHERE kept))[CAST(floor(count(*) FILTER (WHERE kept) / 2) AS BIGINT) + 1] AS median_hours,
  count(*) / count(DISTINCT {_ISO.format('merged_at')}) AS per_week FROM (SELECT *, h BETWEEN 0.5 AND 720 AS kept FROM ({_CYCLE}))"""
_EFFORT = """efforts AS (SELECT *, log2(loc + 1) + 1.5::DOUBLE * log2(n_files + 1) + (1 - 0.3::DOUBLE * least(test_loc / greatest(loc, 1), 1.0::DOUBLE)) AS score
  FROM (SELECT commit_id, CAST(sum(insertions + deletions) AS BIGINT) AS loc, count(DISTINCT path) AS n_files, CAST(sum(CASE WHEN regexp_matches(path, '_test\\.rs$') THEN insertions + deletions ELSE 0 END) AS BIGINT) AS test_loc FROM files GROUP BY commit_id))"""
_FAILED = """failures AS (SELECT deploy_id, repo, f.id AS commit_id FROM (SELECT d.deploy_id, d.repo, arg_min({'id': c.id, 'm': c.message}, (c.ts, c.id)) AS f FROM deployments d JOIN activity c
  ON d.repo = c.repository AND NOT c.is_merge AND c.ts > d.triggered_at AND c.ts <= d.triggered_at + INTERVAL 24 HOUR GROUP BY 1, 2) WHERE starts_with(f.m, 'hotfix'))"""
_LEADS = "leads AS (SELECT deploy_id, repo, s / 3600.0 AS lead_hours FROM (SELECT d.*, date_diff('microsecond', c.ts, d.triggered_at) // 1000000 AS s, date_diff('microsecond', c.ts, d.triggered_at) AS us FROM deployments d JOIN commits c ON d.git_sha = c.sha WHERE status = 'success') WHERE us > -1000000)"
_MTTR = "mttr AS (SELECT repo, count(*) AS incidents, CAST(sum(date_diff('microsecond', detected_at, resolved_at) // 1000000) AS DOUBLE) / count(*) / 3600.0 AS mttr_hours FROM incidents WHERE resolved_at IS NOT NULL GROUP BY repo)"
_JUDGED = "judged AS (SELECT *, CASE WHEN id % 8 = 3 THEN 'maintenance' ELSE category END AS label FROM classified WHERE NOT is_merge), cells AS (SELECT category AS predicted, label, count(*) AS n FROM judged GROUP BY 1, 2)"
_PEOPLE = "people AS (SELECT s_suppkey AS id, s_nationkey AS domain, 'dev' || (s_suppkey * 7 % 60) AS local, 'Dev ' || (s_suppkey % 12) AS name FROM supplier)"
_TOUCHED = "touched AS (SELECT f.*, c.author_email FROM files f JOIN commits c ON f.commit_id = c.id)"
_Z = "1.959963984540054::DOUBLE"

#: name: (query, SELECT, further common table expressions)
_ALL = {
    "author_summary": (report.author_summary, "SELECT author_email, arg_min(author_name, ROW(-strlen(author_name), ts, author_name)) AS name, count(*) AS commits, CAST(sum(insertions) AS BIGINT) AS insertions, CAST(sum(deletions) AS BIGINT) AS deletions, CAST(sum(files_changed) AS BIGINT) AS files, min(ts) AS first_at, max(ts) AS last_at FROM commits WHERE NOT is_merge GROUP BY author_email", ()),
    "repository_summary": (report.repository_summary, "SELECT repository, count(*) AS commits, count(DISTINCT author_email) AS authors, CAST(sum(insertions) AS BIGINT) AS insertions, CAST(sum(deletions) AS BIGINT) AS deletions FROM commits WHERE NOT is_merge GROUP BY repository", ()),
    "repository_top_categories": (report.repository_top_categories, "SELECT * FROM (SELECT repository, category, n, CAST(row_number() OVER (PARTITION BY repository ORDER BY n DESC, category) AS INTEGER) AS place FROM (SELECT repository, category, count(*) AS n FROM classified WHERE NOT is_merge GROUP BY 1, 2)) WHERE place <= 5", (CLASSIFIED,)),
    "weekly_activity": (report.weekly_activity, _ACTIVITY, (CLASSIFIED,)),
    "category_totals": (report.category_totals, "SELECT category, count(*) AS n FROM classified WHERE NOT is_merge GROUP BY category", (CLASSIFIED,)),
    "week_totals": (report.week_totals, f"SELECT {_ISO.format('ts')} AS week_label, count(*) AS commits, count(DISTINCT author_email) AS developers FROM commits WHERE NOT is_merge GROUP BY 1", ()),
    "weekly_metrics": (report.weekly_metrics, f"SELECT {_ISO.format('ts')} AS week_label, count(*) AS total, " + ", ".join(f"{_if(chr(99) + 'ategory = ' + repr(k))} AS {k}" for k in ("feature", "bugfix", "refactor", "documentation", "test", "maintenance")) + " FROM classified WHERE NOT is_merge GROUP BY 1", (CLASSIFIED,)),
    "weekly_categorization": (report.weekly_categorization, f"SELECT week_label, category, n, n * 100.0::DOUBLE / CAST(sum(n) OVER (PARTITION BY week_label) AS BIGINT) AS pct FROM (SELECT {_ISO.format('ts')} AS week_label, category, count(*) AS n FROM classified WHERE NOT is_merge GROUP BY 1, 2)", (CLASSIFIED,)),
    "pr_cycle_stats": (report.pr_cycle_stats, _CYCLES, ()),
    "weekly_velocity": (report.weekly_velocity, f"SELECT w.week_label, coalesce(prs, 0) AS prs_merged, commits / developers AS commits_per_developer, avg_hours AS overall_avg_hours FROM (SELECT {_ISO.format('ts')} AS week_label, count(*) AS commits, count(DISTINCT author_email) AS developers FROM commits WHERE NOT is_merge GROUP BY 1) w LEFT JOIN (SELECT {_ISO.format('merged_at')} AS week_label, count(*) AS prs FROM pull_requests WHERE state = 'merged' GROUP BY 1) m USING (week_label), ({_CYCLES}) c", ()),
    "pr_metrics": (report.pr_metrics, f"SELECT CASE WHEN author = '' THEN '(unknown)' ELSE author END AS author, count(*) AS opened, {_if(chr(115) + 'tate = ' + repr('merged'))} AS merged, {_if(chr(115) + 'tate = ' + repr('merged'))} / count(*) AS merge_rate, coalesce(CAST(sum(s) FILTER (WHERE s >= 0) AS DOUBLE) / count(*) FILTER (WHERE s >= 0) / 3600.0, 0.0) AS avg_hours FROM (SELECT *, CASE WHEN state = 'merged' THEN CAST(trunc(date_diff('microsecond', created_at, merged_at) / 1000000.0) AS BIGINT) END AS s FROM pull_requests) GROUP BY 1", ()),
    "pr_drilldown": (report.pr_drilldown, f"SELECT author, n, hs[CAST(floor(n / 2) AS BIGINT) + 1] AS median_hours, CASE WHEN n >= 20 THEN hs[CAST(floor(n * 95 / 100) AS BIGINT) + 1] END AS p95_hours FROM (SELECT author, count(*) AS n, list_sort(list(CAST(h AS DOUBLE))) AS hs FROM ({_CYCLE}) WHERE h BETWEEN 0.5 AND 720 GROUP BY author)", ()),
    "effort_histogram": (report.effort_histogram, "SELECT CASE WHEN score <= 6 THEN 'XS' WHEN score <= 10 THEN 'S' WHEN score <= 14 THEN 'M' WHEN score <= 18 THEN 'L' ELSE 'XL' END AS size, count(*) AS n FROM efforts GROUP BY 1", (_EFFORT,)),
    "effort_bands": (report.effort_bands, "SELECT CASE WHEN loc < p20 THEN 'XS' WHEN loc < p40 THEN 'S' WHEN loc < p60 THEN 'M' WHEN loc < p80 THEN 'L' ELSE 'XL' END AS band, count(*) AS n, min(loc) AS least, max(loc) AS most FROM efforts, (SELECT quantile_disc(loc, 0.2) AS p20, quantile_disc(loc, 0.4) AS p40, quantile_disc(loc, 0.6) AS p60, quantile_disc(loc, 0.8) AS p80 FROM efforts) GROUP BY 1", (_EFFORT,)),
    "commit_summary": (report.commit_summary, f"SELECT author_email, count(*) AS commits, {_if('ticketed')} AS ticketed, min(ts) AS first_at, max(ts) AS last_at, array_to_string(list_sort(list(DISTINCT repository)), ',') AS repositories FROM commits WHERE NOT is_merge GROUP BY author_email", ()),
    "period_trends": (report.period_trends, f"SELECT author_email, CAST(date_diff('day', anchor, monday) // 28 AS BIGINT) AS period, count(*) AS commits, {_if(chr(99) + 'ategory = ' + repr('bugfix'))} AS bugfixes, CAST(sum(insertions) AS BIGINT) AS insertions FROM (SELECT *, CAST(date_trunc('week', ts) AS DATE) AS monday, min(CAST(date_trunc('week', ts) AS DATE)) OVER (PARTITION BY author_email) AS anchor FROM classified WHERE NOT is_merge) GROUP BY 1, 2", (CLASSIFIED,)),
    "weekly_quality": (report.weekly_quality, f"SELECT *, CASE WHEN score <= 0.20::DOUBLE THEN 'XS' WHEN score <= 2.0::DOUBLE * 0.20::DOUBLE THEN 'S' WHEN score <= 3.0::DOUBLE * 0.20::DOUBLE THEN 'M' WHEN score <= 4.0::DOUBLE * 0.20::DOUBLE THEN 'L' ELSE 'XL' END AS size FROM (SELECT author_email, week_label, repository, commits, reverts, bugfixes, ticketed, 0.35::DOUBLE * (1 - least(reverts / commits, 1.0::DOUBLE)) + 0.40::DOUBLE * (1 - least(bugfixes / commits, 1.0::DOUBLE)) + 0.25::DOUBLE * least(ticketed / commits, 1.0::DOUBLE) AS score FROM ({_ACTIVITY}))", (CLASSIFIED,)),
    "quality_summary": (report.quality_summary, f"SELECT commits, bugfixes, reverts, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - 0.4::DOUBLE * bugfixes / commits - 0.6::DOUBLE * reverts / commits)) AS score, CASE WHEN commits > bugfixes THEN bugfixes / (commits - bugfixes) ELSE 0.0::DOUBLE END AS defect_ratio FROM (SELECT commits, greatest(b, reverts) AS bugfixes, reverts FROM (SELECT count(*) AS commits, {_if(chr(99) + 'ategory = ' + repr('bugfix'))} AS b, {_if(_REVERT)} AS reverts FROM classified WHERE NOT is_merge))", (CLASSIFIED,)),
    "weekly_engineer": (report.weekly_engineer, f"SELECT week_label, author_email, repository, greatest(commits - reverts, 0) AS net, CASE WHEN commits > reverts THEN ai_assisted * 100.0::DOUBLE / (commits - reverts) ELSE 0.0::DOUBLE END AS agentic_pct FROM ({_ACTIVITY})", (CLASSIFIED,)),
    "developer_activity": (report.developer_activity, "SELECT author_email, commits, prs, lines, files_per_commit, categorised, weeks, commits / weeks AS commits_per_week, work_type, " + " + ".join(["0.0::DOUBLE"] + [f"{w}::DOUBLE * (CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 0.0::DOUBLE ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END)" for c, w in (("commits", 0.22), ("prs", 0.26), ("lines", 0.26), ("files_per_commit", 0.11), ("categorised", 0.15))]) + f" AS score FROM (SELECT author_email, count(*) AS commits, CAST(0 AS BIGINT) AS prs, CAST(sum(insertions + deletions) AS BIGINT) AS lines, CAST(sum(files_changed) AS DOUBLE) / count(*) AS files_per_commit, count(category) AS categorised, count(DISTINCT {_ISO.format('ts')}) AS weeks FROM classified WHERE NOT is_merge GROUP BY author_email) JOIN (SELECT author_email, category AS work_type FROM (SELECT author_email, category, row_number() OVER (PARTITION BY author_email ORDER BY count(*) DESC, category) AS place FROM classified WHERE NOT is_merge GROUP BY 1, 2) WHERE place = 1) USING (author_email)", (CLASSIFIED,)),
    "coverage": (report.coverage, f"SELECT coalesce(repository, '(all)') AS repository, count(*) AS total, {_if('confidence > 0.3::DOUBLE')} AS classified, {_if('confidence > 0.3::DOUBLE')} * 100.0::DOUBLE / count(*) AS pct FROM classified GROUP BY ROLLUP (repository)", (CLASSIFIED,)),
    "bus_factor": (report.bus_factor, "SELECT subsystem, max(total) AS touches, count(*) AS authors, max(n) * 100.0::DOUBLE / max(total) AS top_pct, min(CASE WHEN run * 2 >= total THEN place END) AS bus_factor FROM (SELECT subsystem, n, CAST(sum(n) OVER (PARTITION BY subsystem ORDER BY n DESC, author_email ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run, row_number() OVER (PARTITION BY subsystem ORDER BY n DESC, author_email) AS place, CAST(sum(n) OVER (PARTITION BY subsystem) AS BIGINT) AS total FROM (SELECT split_part(path, '/', 1) AS subsystem, author_email, count(*) AS n FROM touched GROUP BY 1, 2)) GROUP BY subsystem", (_TOUCHED,)),
    "single_author_paths": (report.single_author_paths, "SELECT path, count(DISTINCT author_email) AS authors, min(author_email) AS author, count(*) AS touches FROM touched GROUP BY path HAVING count(DISTINCT author_email) = 1", (_TOUCHED,)),
    "monthly_trajectory": (report.monthly_trajectory, "SELECT strftime(ts, '%Y-%m') AS month, count(DISTINCT author_email) AS authors, count(DISTINCT sha) AS commits FROM commits GROUP BY 1 ORDER BY 1 DESC LIMIT 12", ()),
    "churn": (report.churn, "SELECT path, count(DISTINCT commit_id) AS commits, count(DISTINCT author_email) AS authors, CAST(sum(insertions) AS BIGINT) AS insertions, CAST(sum(deletions) AS BIGINT) AS deletions, CASE WHEN count(DISTINCT commit_id) >= 20 THEN 'red' WHEN count(DISTINCT commit_id) >= 5 THEN 'amber' ELSE 'green' END AS severity FROM touched GROUP BY path ORDER BY commits DESC, path LIMIT 20", (_TOUCHED,)),
    "debt_rollup": (report.debt_rollup, "SELECT tier, dimension, repository, count(*) AS n FROM (SELECT repository, CASE WHEN insertions > 400 THEN 'high' WHEN insertions > 150 THEN 'medium' ELSE 'low' END AS tier, top_level AS dimension FROM classified WHERE NOT is_merge) GROUP BY GROUPING SETS ((tier), (dimension), (repository, tier), (tier, dimension), ())", (CLASSIFIED,)),
    "untracked": (report.untracked, f"SELECT sha, name AS author, repository, ts, regexp_replace(split_part(message, chr(10), 1), '\\r$', '') AS subject FROM commits JOIN (SELECT author_email, arg_min(author_name, ROW(-strlen(author_name), ts, author_name)) AS name FROM commits WHERE NOT is_merge GROUP BY 1) USING (author_email) WHERE NOT is_merge AND NOT ticketed AND NOT (regexp_matches(split_part(message, chr(10), 1), '{textfx.BOILERPLATE}') OR insertions + deletions > 5000)", ()),
    "classified_commits": (report.classified_commits, rules_sql.SELECT, (rules_sql.MORE,)),
    "bucket_counts": (report.bucket_counts, "SELECT bucket, count(*) AS n, count(DISTINCT author_email) AS authors FROM classified WHERE NOT is_merge GROUP BY bucket", (CLASSIFIED,)),
    "tickets": (report.tickets, f"SELECT sha, coalesce(nullif(regexp_extract(message, '\\b([A-Z][A-Z0-9]+-[0-9]+)\\b', 1), ''), nullif(regexp_extract(message, '(#[0-9]+)', 1), '')) AS ticket, {_REVERT} AS is_revert, CAST(len(string_split(trim(message), ' ')) AS BIGINT) AS words FROM commits", ()),
    "week_drift": (report.week_drift, f"SELECT week_label, repositories, lag(repositories) OVER (ORDER BY week_label) AS before, repositories - lag(repositories) OVER (ORDER BY week_label) AS drift FROM (SELECT {_ISO.format('ts')} AS week_label, count(DISTINCT repository) AS repositories FROM commits GROUP BY 1)", ()),
    "week_gaps": (report.week_gaps, f"SELECT {_ISO.format('monday')} AS week_label, coalesce(n, 0) AS commits FROM (SELECT unnest(generate_series(min(date_trunc('week', ts)), max(date_trunc('week', ts)), INTERVAL 7 DAY)) AS monday FROM commits) LEFT JOIN (SELECT date_trunc('week', ts) AS monday, count(*) AS n FROM commits GROUP BY 1) USING (monday)", ()),
    "repository_trend": (report.repository_trend, "SELECT repository, slope, CASE WHEN slope > 0.1 THEN 'improving' WHEN slope < -0.1 THEN 'declining' ELSE 'stable' END AS trend FROM (SELECT repository, CASE WHEN n * sxx - sx * sx = 0 THEN 0.0::DOUBLE ELSE CAST(n * sxy - sx * sy AS DOUBLE) / (n * sxx - sx * sx) END AS slope FROM (SELECT repository, count(*) AS n, CAST(sum(x) AS BIGINT) AS sx, CAST(sum(y) AS BIGINT) AS sy, CAST(sum(x * y) AS BIGINT) AS sxy, CAST(sum(x * x) AS BIGINT) AS sxx FROM (SELECT repository, row_number() OVER (PARTITION BY repository ORDER BY year(ts) * 12 + month(ts)) - 1 AS x, count(*) AS y FROM commits GROUP BY repository, year(ts) * 12 + month(ts)) GROUP BY 1))", ()),
    "deploy_frequency": (delivery.deploy_frequency, f"SELECT repo, {_CAL.format('triggered_at')} AS week_label, count(*) AS deployments FROM deployments WHERE status = 'success' GROUP BY 1, 2", ()),
    "lead_times": (delivery.lead_times, "SELECT deploy_id, repo, CAST(lead_hours AS DOUBLE) AS lead_hours FROM leads", (_LEADS,)),
    "deployment_failures": (delivery.deployment_failures, "SELECT deploy_id, repo, commit_id FROM failures", (_FAILED,)),
    "change_failure_rate": (delivery.change_failure_rate, f"SELECT {_CAL.format('triggered_at')} AS week_label, count(*) AS deployments, count(commit_id) AS failures, count(commit_id) * 100.0::DOUBLE / count(*) AS cfr_pct FROM deployments LEFT JOIN failures USING (deploy_id) GROUP BY 1", (_FAILED,)),
    "recovery_time": (delivery.recovery_time, "SELECT * FROM mttr", (_MTTR,)),
    "delivery_summary": (delivery.delivery_summary, f"SELECT repo, deployments, per_week, coalesce(leads, 0) AS leads, lead_hours, cfr_pct, mttr_hours, CASE WHEN per_week >= 1 AND coalesce(lead_hours, 1e300) < 1 AND cfr_pct / 100 < 0.15 AND coalesce(mttr_hours, 0) < 1 THEN 'elite' WHEN per_week >= 0.25 AND coalesce(lead_hours, 1e300) < 168 AND cfr_pct / 100 < 0.3 AND coalesce(mttr_hours, 0) < 24 THEN 'high' WHEN per_week >= 0.04 AND coalesce(lead_hours, 1e300) < 720 AND cfr_pct / 100 < 0.3 AND coalesce(mttr_hours, 0) < 168 THEN 'medium' ELSE 'low' END AS level FROM (SELECT *, deployments / weeks AS per_week, coalesce(failures, 0) * 100.0::DOUBLE / deployments AS cfr_pct FROM (SELECT repo, count(*) AS deployments, count(DISTINCT {_CAL.format('triggered_at')}) AS weeks FROM deployments GROUP BY 1) LEFT JOIN (SELECT repo, count(*) AS leads, CAST(round(sum(lead_hours * 3600)) AS BIGINT) / count(*) / 3600.0::DOUBLE AS lead_hours FROM leads GROUP BY 1) USING (repo) LEFT JOIN (SELECT repo, count(*) AS failures FROM failures GROUP BY 1) USING (repo) LEFT JOIN mttr USING (repo))", (_LEADS, _FAILED, _MTTR)),
    "bugfix_gap": (delivery.bugfix_gap, "SELECT repository, count(*) AS n, CASE WHEN count(*) < 2 THEN 0.0::DOUBLE ELSE CAST(date_diff('microsecond', min(ts), max(ts)) // 1000000 AS DOUBLE) / (count(*) - 1) / 3600.0 END AS gap_hours FROM activity WHERE message LIKE 'hotfix%' GROUP BY repository", ()),
    "latest_events": (delivery.latest_events, "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place = 1", ()),
    "completions_per_quarter": (tracker.completions_per_quarter, "SELECT team, quarter_label, count(*) AS n FROM (SELECT unnest([team_key, '(all)']) AS team, year(completed_at) || '-Q' || quarter(completed_at) AS quarter_label FROM issues WHERE completed_at IS NOT NULL) GROUP BY 1, 2", ()),
    "stable_teams": (tracker.stable_teams, f"SELECT team_key, prior, recent, CASE WHEN prior > 0 THEN (recent - prior) * 100.0::DOUBLE / prior END AS change_pct, qs = 8 AS stable FROM (SELECT team_key, {_if('q < last - 4')} AS prior, {_if('q >= last - 4')} AS recent, count(DISTINCT q) AS qs FROM (SELECT team_key, q, max(q) OVER () AS last FROM (SELECT team_key, year(completed_at) * 4 + quarter(completed_at) - 1 AS q FROM issues WHERE completed_at IS NOT NULL)) WHERE q < last AND q >= last - 8 GROUP BY team_key)", ()),
    "lead_by_year": (tracker.lead_by_year, "SELECT year(completed_at) AS y, count(*) AS n, round(quantile_cont(d, 0.5), 6) AS p50, round(quantile_cont(d, 0.75), 6) AS p75, round(quantile_cont(d, 0.9), 6) AS p90 FROM (SELECT *, CAST(date_diff('microsecond', created_at, completed_at) // 1000000 AS DOUBLE) / 86400.0 AS d FROM issues WHERE completed_at IS NOT NULL) GROUP BY 1", ()),
    "cancel_rate": (tracker.cancel_rate, "SELECT y, c + x + d AS closed, c AS completed, x AS canceled, d AS duplicate, CASE WHEN c + x + d > 0 THEN x * 100.0::DOUBLE / (c + x + d) END AS cancel_pct FROM (SELECT year(created_at) AS y, count(*) FILTER (WHERE state_type = 'completed') AS c, count(*) FILTER (WHERE state_type = 'canceled') AS x, count(*) FILTER (WHERE state_type = 'duplicate') AS d FROM issues GROUP BY 1)", ()),
    "title_tags": (tracker.title_tags, r"SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(regexp_extract(title, '^((?:\[[^\]]+\])*)', 1), '\[([^\]]+)\]', 1)) AS tag FROM issues) GROUP BY tag", ()),
    "concentration": (tracker.concentration, "SELECT team_key, CAST(sum(n) AS BIGINT) AS completions, " + ", ".join(f"CAST(sum(CASE WHEN place <= {k} THEN n ELSE 0 END) AS BIGINT) * 100.0::DOUBLE / CAST(sum(n) AS BIGINT) AS top{k}_pct" for k in (1, 3, 5)) + " FROM (SELECT *, row_number() OVER (PARTITION BY team_key ORDER BY n DESC, assignee_id) AS place FROM (SELECT team_key, assignee_id, count(*) AS n FROM issues WHERE state_type = 'completed' AND assignee_id IS NOT NULL GROUP BY 1, 2)) GROUP BY team_key", ()),
    "contributors_per_year": (tracker.contributors_per_year, "SELECT year(completed_at) AS y, count(DISTINCT assignee_id) AS contributors FROM issues WHERE completed_at IS NOT NULL GROUP BY 1", ()),
    "field_use": (tracker.field_use, "SELECT team_key, count(*) AS n, count(assignee_id) * 100.0::DOUBLE / count(*) AS assigned_pct, count(estimate) * 100.0::DOUBLE / count(*) AS estimated_pct, count(started_at) * 100.0::DOUBLE / count(*) AS started_pct FROM issues GROUP BY team_key", ()),
    "closed_weekly": (tracker.closed_weekly, f"SELECT assignee_id, team_key, {_ISO.format('completed_at')} AS week_label, count(*) AS closed, array_to_string(list_sort(list(issue_id)), ',') AS keys FROM issues WHERE completed_at >= TIMESTAMP '1996-01-01' AND completed_at < TIMESTAMP '1998-01-01' AND assignee_id IS NOT NULL GROUP BY 1, 2, 3", ()),
    "majority_author": (tracker.majority_author, "SELECT repository, author_email, n FROM (SELECT *, row_number() OVER (PARTITION BY repository ORDER BY n DESC, author_email) AS place FROM (SELECT repository, author_email, CAST(sum(files_changed) AS BIGINT) AS n FROM commits GROUP BY 1, 2)) WHERE place = 1", ()),
    "near_identities": (tracker.near_identities, "SELECT id, other, edits, CASE WHEN edits = 1 THEN 0.85::DOUBLE ELSE 0.78::DOUBLE END AS confidence FROM (SELECT a.id, b.id AS other, levenshtein(a.local, b.local) AS edits FROM people a JOIN people b ON a.domain = b.domain AND a.id < b.id) WHERE edits BETWEEN 1 AND 2", (_PEOPLE,)),
    "same_names": (tracker.same_names, "SELECT name, count(*) AS n, min(id) AS keep, count(DISTINCT domain) AS domains, CASE WHEN count(DISTINCT domain) = 1 THEN 0.95::DOUBLE ELSE 0.90::DOUBLE END AS confidence FROM people GROUP BY name HAVING count(*) > 1", (_PEOPLE,)),
    "alias_cascade": (tracker.alias_cascade, "SELECT author_email, author_name, coalesce(e, m) AS author_id, CASE WHEN e IS NOT NULL THEN 'email' WHEN m IS NOT NULL THEN 'name' ELSE 'none' END AS how FROM (SELECT DISTINCT author_email, author_name FROM commits) LEFT JOIN (SELECT author_email, min(author_id) AS e FROM commits WHERE author_id % 3 = 0 GROUP BY 1) USING (author_email) LEFT JOIN (SELECT author_name, min(author_id) AS m FROM commits WHERE author_id % 5 = 1 GROUP BY 1) USING (author_name)", ()),
    "precision_by_rule": (tracker.precision_by_rule, f"SELECT rule_id, n, hits, ((p + {_Z} * {_Z} / (2.0::DOUBLE * n)) - {_Z} * sqrt(p * (1 - p) / n + {_Z} * {_Z} / (4.0::DOUBLE * n * n))) / (1 + {_Z} * {_Z} / n) AS low, ((p + {_Z} * {_Z} / (2.0::DOUBLE * n)) + {_Z} * sqrt(p * (1 - p) / n + {_Z} * {_Z} / (4.0::DOUBLE * n * n))) / (1 + {_Z} * {_Z} / n) AS high FROM (SELECT rule_id, count(*) AS n, {_if('label = category')} AS hits, {_if('label = category')} / count(*) AS p FROM judged GROUP BY rule_id)", (CLASSIFIED, _JUDGED)),
    "confusion": (tracker.confusion, "SELECT predicted, label, n FROM cells", (CLASSIFIED, _JUDGED)),
    "kappa": (tracker.kappa, "SELECT observed, expected, CASE WHEN expected < 1 THEN (observed - expected) / (1 - expected) END AS kappa FROM (SELECT CAST(same AS DOUBLE) / t AS observed, CAST(c AS DOUBLE) / (t * t) AS expected FROM (SELECT CAST(sum(n) AS BIGINT) AS t, CAST(sum(n) FILTER (WHERE predicted = label) AS BIGINT) AS same FROM cells), (SELECT CAST(sum(a * b) AS BIGINT) AS c FROM (SELECT predicted AS k, CAST(sum(n) AS BIGINT) AS a FROM cells GROUP BY 1) JOIN (SELECT label AS k, CAST(sum(n) AS BIGINT) AS b FROM cells GROUP BY 1) USING (k)))", (CLASSIFIED, _JUDGED)),
    "allocation": (tracker.allocation, "SELECT repository, n, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, repository) <= 1000 - CAST(sum(base) OVER () AS BIGINT) THEN 1 ELSE 0 END AS share FROM (SELECT repository, n, n * 1000 // total AS base, n * 1000 % total AS rest FROM (SELECT repository, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM commits GROUP BY repository))", ()),
    "unlinked": (tracker.unlinked, "SELECT who, 'pr only' AS side FROM (SELECT who FROM p EXCEPT SELECT who FROM c) UNION ALL SELECT who, 'commit only' FROM (SELECT who FROM c EXCEPT SELECT who FROM p)", ("c AS (SELECT DISTINCT split_part(author_email, '@', 1) AS who FROM commits), p AS (SELECT DISTINCT author AS who FROM pull_requests WHERE author <> '')",)),
    "identities": (tracker.identities, "SELECT split_part(author_email, '@', 1) AS who FROM commits UNION SELECT author FROM pull_requests WHERE author <> ''", ()),
    "page_text": (tracker.page_text, "SELECT page_id, length(t) AS n_chars, CAST(CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS BIGINT) AS words FROM (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM pages)", ()),
    "redacted": (tracker.redacted, "SELECT doc_id, sha256(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '<email>', 'g')) AS text_sha256 FROM documents", ()),
    "freshness": (tracker.freshness, "SELECT event_type, count(*) AS n, CAST(date_diff('microsecond', max(ts), TIMESTAMP '2024-02-15') // 1000000 AS DOUBLE) / 3600.0 AS age_hours, (date_diff('microsecond', max(ts), TIMESTAMP '2024-02-15') // 1000000) / 3600.0 > 48 AS stale FROM events GROUP BY event_type", ()),
} | planning_sql.QUERIES | linking_sql.QUERIES | auditing_sql.QUERIES | evaluation_sql.QUERIES | upkeep_sql.QUERIES | selection_sql.QUERIES | audit_sql.queries(CLASSIFIED) | signals_sql.QUERIES | text_sql.QUERIES


def queries() -> dict:
    return {name: query for name, (query, _, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: f"WITH RECURSIVE {', '.join([PRELUDE, *more])}\n{select}" for name, (_, select, more) in _ALL.items() if select}
