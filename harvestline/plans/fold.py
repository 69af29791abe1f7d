"""Status, events and metrics of all sources from the ledger, in one go."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from harvestline.operators import ops_metrics, status as st
from harvestline.operators.ledger import failure_streaks, fold_runs
from harvestline.operators.specs import with_defaults, with_violations
from harvestline.plans.staging import stage


@dataclass(frozen=True)
class Folded:
    status: DataFrame
    events: DataFrame
    metrics: DataFrame


def fold(runs: DataFrame, specs: DataFrame, requests: DataFrame, as_of: datetime) -> Folded:
    """Everything about the sources that follows from their runs, as of a given time."""
    full = stage(with_violations(with_defaults(specs)), "specs")
    folded = stage(fold_runs(runs), "folded")
    streaks = failure_streaks(runs, folded)
    asked = requests.withColumn(
        "run_id",
        st.one_off_run_id(F.col("source_id"), F.col("kind"), F.col("request_id")),
    ).where(F.col("kind") == "backfill")
    running = (
        asked.join(
            runs.where(F.col("result") == "Running").select("source_id", "run_id"),
            ["source_id", "run_id"],
            "left_semi",
        )
        .groupBy("source_id")
        .agg(F.min("request_id").alias("request_id"))
    )
    status = stage(
        st.status_rows(full.drop("watermark"), folded, streaks, running), "status"
    )
    at = F.lit(as_of)
    metrics = (
        ops_metrics.run_counters(runs)
        .unionByName(ops_metrics.duration_histogram(runs))
        .unionByName(ops_metrics.resume_lag(status, full, at))
        .unionByName(ops_metrics.gauges(status))
    )
    return Folded(
        status=status,
        events=st.events(runs, requests, status, full, at),
        metrics=ops_metrics.forget_deleted(metrics, full),
    )
