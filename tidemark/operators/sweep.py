"""An audit's stages run in order over frames: a stage that fails is a row of the outcome, not the end of the run."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import textfx
from ..sources import model
from ..sources.rounds import cut
from . import delivery, report

OUTCOME = "place long, stage string, status string, reason string, n_rows long"
LONGEST = 200


class Stage(NamedTuple):
    """``run`` gets the tables of the stages before it by name and returns its own. ``needs`` are stages it can't do without; ``some_rows``: no rows are a failure; ``skip``: why it isn't attempted."""

    name: str
    run: Callable[[dict[str, DataFrame]], DataFrame] | None
    needs: tuple[str, ...] = ()
    some_rows: bool = False
    skip: str | None = None


def sweep(spark: SparkSession, stages: list[Stage]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(outcomes, tables of the stages that succeeded). Each stage's rows are written before the next starts, so an error in any task is its own stage's, and its rows are counted once.

    A stage whose needs failed fails for that reason, without running. Two stages of one name are an error of the caller."""
    if len({s.name for s in stages}) < len(stages):
        raise ValueError("stages need different names")
    tables, outcomes = {}, []
    for place, stage in enumerate(stages):
        missing = [n for n in stage.needs if n not in tables]
        status, reason, rows = "succeeded", None, None
        if stage.skip is not None:
            status, reason = "skipped", stage.skip
        elif missing:
            status, reason = "failed", f"needs {', '.join(missing)}"
        else:
            try:
                table = cut(stage.run(dict(tables)))
                rows = table.count()
                if stage.some_rows and not rows:
                    status, reason = "failed", "no rows"
                else:
                    tables[stage.name] = table
            except Exception as error:  # noqa: BLE001 - whatever a stage fails by is its outcome
                status, reason = "failed", f"{type(error).__name__}: {error}"
        outcomes.append((place, stage.name, status, reason, rows))
    return spark.createDataFrame(outcomes, OUTCOME), tables


def gap_lines(outcomes: DataFrame, secrets: list[str] = ()) -> DataFrame:
    """(place, line): what a reader has to know of stages that failed, then of those not attempted; none for success. Reasons lose addresses and the given secrets, and end after LONGEST characters of their first line."""
    reason = textfx.first_line(F.coalesce("reason", F.lit("")))
    for secret in sorted(filter(None, secrets), key=len, reverse=True):
        reason = F.replace(reason, F.lit(secret), F.lit("<secret>"))
    reason = textfx.redact_emails(reason)
    reason = F.when(F.length(reason) > LONGEST, F.concat(F.left(reason, F.lit(LONGEST)), F.lit("…"))).otherwise(reason)
    said = F.when(F.col("status") == "failed", "did not complete").when(F.col("status") == "skipped", "was not attempted")
    line = F.concat(F.lit("Stage `"), F.col("stage"), F.lit("` "), said, F.lit(" ("), reason, F.lit("): its data is not assessed; read what depends on it as unassessed, not as clean."))
    rank = F.when(F.col("status") == "failed", 0).otherwise(1)
    return outcomes.where(said.isNotNull()).select((rank * 1000000 + F.col("place")).alias("place"), line.alias("line"))


def audit_sweep(spark, sf_dir):
    """The outcome of a whole audit of the model: collection, correlation, classification, trackers, deployments, incidents, delivery, pull requests, reports."""
    keyed = lambda t: t["collect"].withColumn("key", textfx.ticket(F.col("message"))).where("key is not null").select("sha", "key")
    stages = [
        Stage("collect", lambda t: model.commits(spark, sf_dir), some_rows=True),
        Stage("correlate", keyed, ("collect",)),
        Stage("classify", lambda t: report.category_totals(spark, sf_dir), ("collect",)),
        Stage("key sync", None, skip="no tracker of keyed issues is set up"),
        Stage("issue sync", lambda t: model.issues(spark, sf_dir)),
        Stage("deployments", lambda t: model.deployments(spark, sf_dir), some_rows=True),
        Stage("incidents", lambda t: model.incidents(spark, sf_dir)),
        Stage("rollbacks", lambda t: t["deployments"].where("status = 'rolled back'"), ("deployments",), some_rows=True),
        Stage("delivery", lambda t: delivery.lead_times(spark, sf_dir), ("deployments", "incidents")),
        Stage("recovery", lambda t: t["rollbacks"], ("rollbacks",)),
        Stage("pr metrics", lambda t: report.pr_metrics(spark, sf_dir)),
        Stage("report", lambda t: report.week_totals(spark, sf_dir), ("classify",)),
    ]
    return sweep(spark, stages)[0]
