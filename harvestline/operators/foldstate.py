"""The fold of a ledger as a state that grows with what is new.

A run that succeeded is never run again, so it is settled: it may be folded into
a state of one row a source and left alone.  A run that failed or still goes on
can be followed by another attempt, so its row stays open until one succeeds.
The fold of a whole ledger is the state of what is settled, merged with the fold
of the open rows and the newer ones; merging is sums and latest values, so it
doesn't matter in how many steps or in what order runs were settled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from harvestline.operators.ledger import RUN_FIELDS, latest_attempt, run_order

# What a state keeps the latest of, each with when it happened.
LATEST = (
    "finished_run",
    "running_run",
    "successful_run",
    "shaped_run",
    "resumed",
    "backfill",
    "trigger",
)


def newest_attempts(rows: DataFrame) -> DataFrame:
    """The newest of each run's ledger rows; batches number a run's attempts."""
    return latest_attempt(rows, F.struct("attempt", "created_at"))


def settled(runs: DataFrame) -> DataFrame:
    """Runs that no later attempt can replace."""
    return runs.where(F.col("result") == "Succeeded")


def still_open(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("result") != "Succeeded")


def fold_state(runs: DataFrame) -> DataFrame:
    """One row a source: ``rows``, and of each of ``LATEST`` a struct ``at, value``.

    ``runs`` holds each run once.  Combines map-side; no source's runs meet in one task.
    """
    at = run_order()
    filled = lambda name: F.coalesce(F.col(name), F.lit("")) != ""
    finished, ok = F.col("result") != "Running", F.col("result") == "Succeeded"
    run = F.struct(*RUN_FIELDS)

    def latest(value: Column, condition: Column, name: str) -> Column:
        return F.max_by(F.struct(at.alias("at"), value.alias("value")), F.when(condition, at)).alias(name)

    return runs.groupBy("source_id").agg(
        F.coalesce(F.sum(F.when(finished, F.col("rows_ingested"))), F.lit(0)).alias("rows"),
        latest(run, finished, "finished_run"),
        latest(run, ~finished, "running_run"),
        latest(run, ok, "successful_run"),
        latest(
            F.struct("run_id", "schema_fingerprint"), ok & filled("schema_fingerprint"), "shaped_run"
        ),
        latest(F.col("watermark"), ok & ~filled("backfill_id") & filled("watermark"), "resumed"),
        latest(F.col("backfill_id"), ok & filled("backfill_id"), "backfill"),
        latest(F.col("run_id"), F.col("kind") == "trigger", "trigger"),
    )


def merge_states(states: DataFrame) -> DataFrame:
    """One row a source of any number of states with no run in two of them."""
    return states.groupBy("source_id").agg(
        F.sum("rows").alias("rows"),
        *[F.max_by(name, F.col(name)["at"]).alias(name) for name in LATEST],
    )


def resolve(state: DataFrame) -> DataFrame:
    """A state as ``fold_runs`` gives it."""
    value = lambda name: F.col(name)["value"]
    return state.select(
        "source_id",
        F.col("rows").alias("total_rows_ingested"),
        value("finished_run").alias("last_finished_run"),
        value("running_run").alias("running_run"),
        value("successful_run").alias("last_successful_run"),
        F.col("successful_run")["at"].alias("last_success"),
        value("shaped_run")["schema_fingerprint"].alias("schema_fingerprint"),
        value("resumed").alias("watermark"),
        value("backfill").alias("last_completed_backfill_id"),
        value("trigger").alias("last_trigger_run_id"),
    )
