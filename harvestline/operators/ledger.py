"""Runs, their outcomes, and the fold over them.

The ledger is append-only and status is a pure function of it, so folding again
never counts a run twice.  Nothing here gathers a source's runs in one task:
folds combine map-side and order-dependent columns are cut into time buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from harvestline.functions.text import blank_to_null
from harvestline.model import SHAPE_CHANGE
from harvestline.operators.drift import change_text, is_empty
from harvestline.operators.sequences import lag_in_buckets, running_since_reset

REPORT = (
    "rowsIngested bigint, rowsRejected bigint, rowsSkipped bigint, requestCount bigint,"
    " watermark string, schemaFingerprint string,"
    " schemaChange struct<added:array<string>,removed:array<string>,changed:array<string>>,"
    " backfillID string, error string"
)


def run_time() -> Column:
    """When a run counts as having happened."""
    return F.coalesce("completed_at", "started_at", "created_at")


def run_order() -> Column:
    """Oldest first, ties by run id."""
    return F.struct(run_time().alias("run_time"), F.col("run_id").alias("run_id"))


def month_bucket(time: Column) -> Column:
    return F.year(time) * 12 + F.month(time)


def latest_attempt(attempts: DataFrame, order: Column | None = None) -> DataFrame:
    """The newest attempt of each run."""
    newest = F.struct(F.coalesce("started_at", "created_at"), "attempt") if order is None else order
    rest = [c for c in attempts.columns if c not in ("source_id", "run_id")]
    return (
        attempts.groupBy("source_id", "run_id")
        .agg(F.max_by(F.struct(*rest), newest).alias("row"))
        .select("source_id", "run_id", *[F.col(f"row.{c}").alias(c) for c in rest])
    )


def failure_message(error: Column, change: Column, job_message: Column, job_reason: Column, failed: Column) -> Column:
    """L2: reported error, else the shape change, else why the job failed."""
    empty_list = F.array().cast("array<string>")
    lists = [F.coalesce(change[k], empty_list) for k in SHAPE_CHANGE.fieldNames()]
    drift = F.when(
        change.isNotNull() & ~is_empty(*lists),
        F.concat(F.lit("record shape changed: "), change_text(*lists)),
    )
    job = F.when(
        failed,
        F.coalesce(
            blank_to_null(job_message), blank_to_null(job_reason), F.lit("run did not complete")
        ),
    )
    return F.coalesce(blank_to_null(error), drift, job)


def runs_from_reports(jobs: DataFrame, attempts: DataFrame) -> DataFrame:
    """Ledger rows out of job outcomes and the reports attempts left behind.

    ``jobs``: ``(source_id, run_id, kind, backfill_id, created_at, started_at,
    completed_at, job_result, job_message, job_reason)``, result NULL while it
    runs.  ``attempts``: ``(source_id, run_id, attempt, created_at, started_at,
    report)``.  A missing or unreadable report leaves the counts at zero and the
    outcome to the job.
    """
    newest = latest_attempt(attempts).select(
        "source_id", "run_id", "attempt", F.from_json("report", REPORT).alias("r")
    )
    joined = jobs.join(newest, ["source_id", "run_id"], "left")
    succeeded = F.col("job_result") == "Complete"
    failed = F.col("job_result") == "Failed"
    result = F.when(succeeded, "Succeeded").when(failed, "Failed").otherwise("Running")
    report = F.col("r")
    count = lambda name: F.coalesce(report[name], F.lit(0)).alias
    return joined.select(
        "source_id",
        "run_id",
        "attempt",
        "kind",
        F.coalesce(blank_to_null(report["backfillID"]), F.col("backfill_id")).alias("backfill_id"),
        "created_at",
        "started_at",
        "completed_at",
        result.alias("result"),
        count("rowsIngested")("rows_ingested"),
        count("rowsRejected")("rows_rejected"),
        count("rowsSkipped")("rows_skipped"),
        count("requestCount")("request_count"),
        report["watermark"].alias("watermark"),
        report["schemaFingerprint"].alias("schema_fingerprint"),
        report["schemaChange"].alias("schema_change"),
        report["error"].alias("error"),
        failure_message(
            report["error"],
            report["schemaChange"],
            F.col("job_message"),
            F.col("job_reason"),
            F.coalesce(failed, F.lit(False)),
        ).alias("message"),
    )


def member_runs(runs: DataFrame, specs: DataFrame) -> DataFrame:
    """Runs of live sources, owned directly or through the source's scheduler.

    Needs ``owner_kind``, ``owner_name`` and ``label_source`` on the runs.
    """
    name = F.col("live_id")
    direct = (F.col("owner_kind") == "source") & (F.col("owner_name") == name)
    scheduled = (
        (F.col("owner_kind") == "scheduler")
        & (F.col("owner_name") == name)
        & (F.col("label_source") == name)
    )
    live = specs.select(F.col("source_id").alias("live_id"))
    return runs.join(live, (F.col("owner_name") == name) & (direct | scheduled), "left_semi")


def unaccounted(runs: DataFrame, accounted: DataFrame) -> DataFrame:
    """Finished runs not counted before, for an incremental fold."""
    finished = runs.where(F.col("result") != "Running")
    return finished.join(accounted, ["source_id", "run_id"], "left_anti")


def _when(condition: Column, value: Column) -> Column:
    return F.when(condition, value)


RUN_FIELDS = (
    "run_id",
    "kind",
    "backfill_id",
    "started_at",
    "completed_at",
    "result",
    "rows_ingested",
    "rows_rejected",
    "request_count",
    "message",
)


def fold_runs(runs: DataFrame) -> DataFrame:
    """One row a source over its whole ledger, in one pass.

    The resume point is that of the last successful run that was not a backfill
    and reported one: the last, not the greatest.
    """
    order = run_order()
    run = F.struct(*RUN_FIELDS)
    finished = F.col("result") != "Running"
    ok = F.col("result") == "Succeeded"
    is_backfill = F.coalesce(F.col("backfill_id"), F.lit("")) != ""
    latest = lambda value, condition: F.max_by(value, _when(condition, order))
    return runs.groupBy("source_id").agg(
        F.coalesce(F.sum(_when(finished, F.col("rows_ingested"))), F.lit(0)).alias(
            "total_rows_ingested"
        ),
        latest(run, finished).alias("last_finished_run"),
        latest(run, ~finished).alias("running_run"),
        latest(run, ok).alias("last_successful_run"),
        F.max(_when(ok, order)).alias("last_success"),
        latest(
            F.col("schema_fingerprint"),
            ok & (F.coalesce(F.col("schema_fingerprint"), F.lit("")) != ""),
        ).alias("schema_fingerprint"),
        latest(
            F.col("watermark"), ok & ~is_backfill & (F.coalesce(F.col("watermark"), F.lit("")) != "")
        ).alias("watermark"),
        latest(F.col("backfill_id"), ok & is_backfill).alias("last_completed_backfill_id"),
        latest(F.col("run_id"), F.col("kind") == "trigger").alias("last_trigger_run_id"),
    )


def failure_streaks(runs: DataFrame, folded: DataFrame) -> DataFrame:
    """Failed runs since the last success of each source, of any kind."""
    since = folded.select("source_id", "last_success")
    failed = runs.where(F.col("result") == "Failed").select(
        "source_id", run_order().alias("at")
    )
    late = failed.join(since, "source_id").where(
        F.col("last_success").isNull() | (F.col("at") > F.col("last_success"))
    )
    counts = late.groupBy("source_id").agg(F.count("*").alias("n"))
    return since.join(counts, "source_id", "left").select(
        "source_id", F.coalesce("n", F.lit(0)).cast("int").alias("consecutive_failures")
    )


def running_failures(runs: DataFrame) -> DataFrame:
    """The streak as it stood after each finished run."""
    finished = runs.where(F.col("result") != "Running").withColumn("run_time", run_time())
    return running_since_reset(
        finished,
        ["source_id"],
        ["run_time", "run_id"],
        F.col("result") == "Failed",
        F.col("result") == "Succeeded",
        month_bucket(F.col("run_time")),
        "streak",
    )


def fingerprint_changes(runs: DataFrame) -> DataFrame:
    """Successful runs whose shape differs from the one accepted before."""
    shaped = runs.where(
        (F.col("result") == "Succeeded") & (F.coalesce("schema_fingerprint", F.lit("")) != "")
    ).withColumn("run_time", run_time())
    lagged = lag_in_buckets(
        shaped,
        ["source_id"],
        ["run_time", "run_id"],
        {"schema_fingerprint": "previous_fingerprint"},
        month_bucket(F.col("run_time")),
    )
    return lagged.where(F.col("schema_fingerprint") != F.col("previous_fingerprint"))
