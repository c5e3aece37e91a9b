"""Scores and verdicts on tickets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of names, and whole words of names, that tell an automation account.
BOT_PARTS = ["[bot]", "dependabot", "renovate", "github-actions", "jenkins", "automation", "service-account", "serviceaccount", "svc-", "noreply", "codecov", "snyk", "sonarqube"]
BOT_WORDS = ["bot", "bots", "robot", "system", "automation", "ci"]
#: Types of ticket that are scored from an age of seven days on.
LATE_TYPES, LATE_DAYS = ["epic", "feature", "initiative"], 7


def is_bot(name: Column) -> Column:
    name = F.lower(name)
    part = F.lit(False)
    for p in BOT_PARTS:
        part = part | F.contains(name, F.lit(p))
    return F.coalesce(part | F.arrays_overlap(F.split(name, r"[^\p{L}\p{N}]+"), F.array(*[F.lit(w) for w in BOT_WORDS])), F.lit(False))


def exclusion(reporter: Column, moved_by_human: Column, title_words: Column, body_words: Column) -> Column:
    """Why a ticket isn't meaningful work: the reporter comes before the length of the title."""
    return F.when(is_bot(reporter), F.when(moved_by_human, "bot_filed").otherwise("auto_generated")).when((title_words <= 5) & (body_words < 1), "terse_title").otherwise("none")


def effort(children: Column, words: Column, comments: Column, transitions: Column, points: Column) -> Column:
    """1 to 50, to two decimals: each term has a cap; story points outside 0.5 to 40 count nothing."""
    point = F.when(points.between(0.5, 40), F.least(points * 0.4, F.lit(3.0))).otherwise(0.0)
    raw = 1.0 + F.least(children, F.lit(10)) * 2.0 + F.least(words / 40.0, F.lit(12.0)) + F.least(comments, F.lit(10)) * 0.8 + F.least(transitions, F.lit(12)) * 0.5 + point
    return F.floor(F.greatest(F.least(raw, F.lit(50.0)), F.lit(1.0)) * 100 + 0.5) / 100.0


def effort_bucket(score: Column) -> Column:
    return F.when(score.isNull(), F.lit(None).cast("string")).when(score >= 30, "HIGH").when(score >= 15, "MEDIUM").otherwise("LOW")


def deferred(item_type: Column, age_days: Column) -> Column:
    """Types that are broken down over time wait; an unknown age doesn't."""
    return F.coalesce(F.lower(item_type).isin(LATE_TYPES) & (age_days < LATE_DAYS), F.lit(False))
