"""Status, conditions, events and pending requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from harvestline.functions.text import short_digest
from harvestline.model import DEFAULT_SUSPEND_AFTER, ONE_OFF_ID_HEX
from harvestline.operators.ledger import RUN_FIELDS, fingerprint_changes, run_time


def one_off_run_id(source_id: Column, kind: Column, request_id: Column) -> Column:
    """The same request always maps to the same run."""
    return F.concat_ws("-", source_id, kind, short_digest(request_id, ONE_OFF_ID_HEX))


def _condition(kind: str, status: bool, reason: str, message: Column | str) -> Column:
    message = F.lit(message) if isinstance(message, str) else message
    return F.struct(
        F.lit(kind).alias("type"),
        F.lit("True" if status else "False").alias("status"),
        F.lit(reason).alias("reason"),
        message.alias("message"),
    )


def suspended_sources(specs: DataFrame, streaks: DataFrame) -> DataFrame:
    """L4: ``source_id, why`` of the sources that are not scheduled: after failures, or as requested."""
    streak = F.coalesce(F.col("consecutive_failures"), F.lit(0))
    limit = F.coalesce(F.col("suspend_after"), F.lit(DEFAULT_SUSPEND_AFTER))
    why = F.when((limit > 0) & (streak >= limit), "failures").when(F.col("suspend"), "requested")
    return specs.join(streaks, "source_id", "left").select("source_id", why.alias("why")).where(F.col("why").isNotNull())


def due_runs(specs: DataFrame, suspended: DataFrame, pending: DataFrame) -> DataFrame:
    """``source_id, kind, request_id`` of the runs that are due.

    A scheduled run of every source that isn't suspended, and what was asked for
    by name: suspending stops the schedule, not a backfill or a trigger.
    """
    scheduled = specs.join(suspended, "source_id", "left_anti").select(
        "source_id", F.lit("scheduled").alias("kind"), F.lit(None).cast("string").alias("request_id")
    )
    asked = pending.join(specs.select("source_id"), "source_id", "left_semi")
    return scheduled.unionByName(asked.select("source_id", "kind", "request_id").distinct())


def status_rows(
    specs: DataFrame, folded: DataFrame, streaks: DataFrame, backfilling: DataFrame
) -> DataFrame:
    """Current status of every source.

    ``folded`` and ``streaks`` come from the ledger; ``backfilling``:
    ``(source_id, request_id)`` of backfills in progress.  A source that has
    never run has a status too.  ``specs`` may carry ``violations``.
    """
    joined = (
        specs.join(folded, "source_id", "left")
        .join(streaks, "source_id", "left")
        .join(
            backfilling.select("source_id", F.col("request_id").alias("backfill_running")),
            "source_id",
            "left",
        )
    )
    streak = F.coalesce(F.col("consecutive_failures"), F.lit(0))
    limit = F.coalesce(F.col("suspend_after"), F.lit(DEFAULT_SUSPEND_AFTER))
    auto = (limit > 0) & (streak >= limit)
    suspended = F.coalesce(F.col("suspend"), F.lit(False))
    invalid = (
        F.size("violations") > 0 if "violations" in specs.columns else F.lit(False)
    )
    why = (
        F.array_join("violations", "; ") if "violations" in specs.columns else F.lit("")
    )
    running = F.col("running_run").isNotNull()
    # Reasons and messages of the conditions, up to ``progress``.
    stopped = F.format_string("scheduling stopped after %d consecutive failures", streak)
    scheduled = F.concat(F.lit('scheduled as "'), F.col("schedule"), F.lit('"'))
    failing = F.format_string("%d consecutive failed runs", streak)
    state = (
        F.when(invalid, "invalid")
        .when(auto, "auto")
        .when(suspended, "suspended")
        .when(streak > 0, "failing")
        .otherwise("healthy")
    )
    phase = (
        F.when(F.col("state").isin("invalid", "auto", "failing"), "Degraded")
        .when(F.col("state") == "suspended", "Suspended")
        .when(running, "Running")
        .otherwise("Scheduled")
    )
    by_state = (
        F.when(F.col("state") == "invalid", F.array(_condition("Ready", False, "InvalidSpec", why)))
        .when(
            F.col("state") == "auto",
            F.array(
                _condition("Scheduled", False, "AutoSuspended", stopped),
                _condition("Degraded", True, "ConsecutiveFailures", stopped),
                _condition("Ready", False, "AutoSuspended", stopped),
            ),
        )
        .when(
            F.col("state") == "suspended",
            F.array(
                _condition("Scheduled", False, "Suspended", "spec.suspend is true"),
                _condition("Degraded", False, "Suspended", "not scheduling runs"),
                _condition("Ready", True, "Suspended", "suspended as requested"),
            ),
        )
        .when(
            F.col("state") == "failing",
            F.array(
                _condition("Scheduled", True, "CronJobReady", scheduled),
                _condition("Degraded", True, "RunFailed", failing),
                _condition("Ready", False, "RunFailed", "the last run failed"),
            ),
        )
        .otherwise(
            F.array(
                _condition("Scheduled", True, "CronJobReady", scheduled),
                _condition("Degraded", False, "NoFailures", "runs are succeeding"),
                _condition("Ready", True, "Scheduled", "ready to ingest"),
            )
        )
    )
    progress = F.when(F.col("state") == "invalid", F.array().cast(_CONDITIONS)).otherwise(
        F.array(
            F.when(
                F.col("backfill_running").isNotNull(),
                _condition(
                    "Backfilling",
                    True,
                    "BackfillRunning",
                    F.concat(F.lit('backfill "'), F.col("backfill_running"), F.lit('" in progress')),
                ),
            ).otherwise(
                _condition("Backfilling", False, "NoBackfill", "no backfill in progress")
            )
        ).cast(_CONDITIONS)
    )
    # End of fixed values.
    return joined.withColumn("state", state).select(
        "source_id",
        phase.alias("phase"),
        F.concat(by_state.cast(_CONDITIONS), progress).alias("conditions"),
        F.coalesce("running_run", "last_finished_run").alias("last_run"),
        "last_successful_run",
        streak.alias("consecutive_failures"),
        "watermark" if "watermark" not in specs.columns else folded["watermark"],
        F.coalesce("total_rows_ingested", F.lit(0)).alias("total_rows_ingested"),
        "schema_fingerprint",
        "last_completed_backfill_id",
        "last_trigger_run_id",
        (auto & ~invalid).alias("auto_suspended"),
        (suspended & ~auto & ~invalid).alias("suspend_requested"),
    )


_CONDITIONS = "array<struct<type:string,status:string,reason:string,message:string>>"


def pending_requests(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """Requests that have not started yet, with the id their run will have.

    A request id runs once: a run that exists, in whatever state, or a completed
    backfill of that id, settles it.
    """
    asked = requests.withColumn(
        "run_id", one_off_run_id(F.col("source_id"), F.col("kind"), F.col("request_id"))
    )
    done = runs.where(
        (F.col("result") == "Succeeded") & F.col("backfill_id").isNotNull()
    ).select("source_id", F.lit("backfill").alias("kind"), F.col("backfill_id").alias("request_id"))
    return asked.join(runs.select("source_id", "run_id"), ["source_id", "run_id"], "left_anti").join(
        done, ["source_id", "kind", "request_id"], "left_anti"
    )


def events(
    runs: DataFrame, requests: DataFrame, status: DataFrame, specs: DataFrame, as_of: Column
) -> DataFrame:
    """The event log, ``(source_id, at, severity, reason, message)``."""
    run_id, text = F.col("run_id"), F.coalesce(F.col("message"), F.lit(""))

    def rows(df: DataFrame, at: Column, severity: str, reason: str, message: Column) -> DataFrame:
        return df.select(
            "source_id",
            at.alias("at"),
            F.lit(severity).alias("severity"),
            F.lit(reason).alias("reason"),
            message.alias("message"),
        )

    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    is_backfill = F.coalesce(F.col("backfill_id"), F.lit("")) != ""
    failed = rows(
        runs.where(F.col("result") == "Failed"),
        run_time(),
        "Warning",
        "RunFailed",
        F.concat(F.lit("run "), run_id, F.lit(" failed: "), text),
    )
    drifted = rows(
        fingerprint_changes(runs),
        F.col("run_time"),
        "Warning",
        "SchemaDrift",
        F.concat(F.lit("record shape changed in run "), run_id, F.lit(": "), text),
    )
    completed = rows(
        runs.where((F.col("result") == "Succeeded") & is_backfill),
        run_time(),
        "Normal",
        "BackfillCompleted",
        F.concat(
            F.lit("backfill "),
            quoted(F.col("backfill_id")),
            F.lit(" ingested "),
            F.col("rows_ingested").cast("string"),
            F.lit(" rows"),
        ),
    )
    started = requests.withColumn(
        "run_id", one_off_run_id(F.col("source_id"), F.col("kind"), F.col("request_id"))
    ).join(
        runs.select("source_id", "run_id", F.coalesce("started_at", "created_at").alias("begun")),
        ["source_id", "run_id"],
    )
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    backfills = rows(
        started.where(F.col("kind") == "backfill"),
        F.col("begun"),
        "Normal",
        "BackfillStarted",
        F.concat(
            F.lit("started backfill "),
            quoted(F.col("request_id")),
            F.lit(" over ["),
            blank("from_value"),
            F.lit(", "),
            blank("to_value"),
            F.lit("]"),
        ),
    )
    triggered = rows(
        started.where(F.col("kind") == "trigger"),
        F.col("begun"),
        "Normal",
        "RunTriggered",
        F.concat(F.lit("started run "), run_id),
    )
    suspended = rows(
        status.where("auto_suspended"),
        as_of,
        "Warning",
        "AutoSuspended",
        F.format_string(
            "scheduling stopped after %d consecutive failures", F.col("consecutive_failures")
        ),
    )
    log = failed.unionByName(drifted).unionByName(completed).unionByName(backfills)
    log = log.unionByName(triggered).unionByName(suspended)
    if "violations" in specs.columns:
        log = log.unionByName(
            rows(
                specs.where(F.size("violations") > 0),
                as_of,
                "Warning",
                "InvalidSpec",
                F.array_join("violations", "; "),
            )
        )
    return log


def status_text(status: DataFrame) -> Column:
    """Everything about a status that is worth writing it again for."""
    stable = [c for c in status.columns if c not in ("source_id", "observed_at")]
    if "conditions" in stable:
        plain = F.transform(
            "conditions",
            lambda c: F.struct(c["type"], c["status"], c["reason"], c["message"]),
        )
    return F.to_json(
        F.struct(*[plain.alias(c) if c == "conditions" else F.col(c) for c in stable])
    )


def changed_status(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of ``after`` that differ from ``before``, transition times aside."""
    old = before.select("source_id", status_text(before).alias("old"))
    new = after.withColumn("new", status_text(after))
    return new.join(old, "source_id", "left").where(~F.col("new").eqNullSafe(F.col("old"))).drop(
        "new", "old"
    )


def run_struct() -> Column:
    return F.struct(*RUN_FIELDS)
