"""The run ledger folded into status, events and metrics."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from harvestline.operators import ledger, ops_metrics, status as st
from harvestline.operators.specs import with_defaults
from harvestline.plans.staging import shared_folder, stage
from harvestline.plans.store import Store
from harvestline.queries import inputs
from harvestline.queries.book import Book
from harvestline.sources.requests import plan_requests

BOOK = Book()

_AS_OF = datetime(2002, 1, 1)
_AS_OF_SQL = "TIMESTAMP '2002-01-01 00:00:00'"
_LG = f"WITH {inputs.LEDGER_CTE}"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.staged_once(
        spark, sf_dir, "order-ledger", lambda: inputs.order_ledger(spark, sf_dir)
    )


def _plain(df: DataFrame) -> DataFrame:
    """Instants as local timestamps, the form the other engine reads them in."""
    return df.select(
        *[
            F.col(f.name).cast("timestamp_ntz").alias(f.name)
            if f.dataType.typeName() == "timestamp"
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


# --- jobs and the reports their attempts left ---------------------------------------------

_JOBS = """j AS (SELECT *, 1 + n % 3 AS attempts FROM lg),
  reported AS (SELECT *, NOT (n % 11 = 0 OR n % 13 = 0) AS readable FROM j)"""


def _jobs(runs: DataFrame) -> DataFrame:
    n = F.substring("run_id", 2, 9).cast("bigint")
    failed = F.col("result") == "Failed"
    return runs.select(
        "source_id",
        "run_id",
        "kind",
        "backfill_id",
        "created_at",
        "started_at",
        "completed_at",
        F.when(F.col("result") == "Succeeded", "Complete")
        .when(failed, "Failed")
        .alias("job_result"),
        F.when(failed & (n % 4 == 1), "BackoffLimitExceeded: gone").alias("job_message"),
        F.when(failed & (n % 4 == 3), "DeadlineExceeded").alias("job_reason"),
        n.alias("n"),
    )


def _attempts(jobs: DataFrame) -> DataFrame:
    """One to three attempts a run; only the last one's counts are real."""
    n, k = F.col("n"), F.col("k")
    last = k == n % 3 + 1
    rows = jobs.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), n % 3 + 1)).alias("k"))
    report = F.to_json(
        F.struct(
            F.when(last, n % 1000).otherwise(999999).alias("rowsIngested"),
            (n % 7).alias("rowsRejected"),
            (n % 20 + 1).alias("requestCount"),
            F.when(
                n % 10 == 0,
                F.struct(F.array(F.lit("tenant")).alias("added")),
            ).alias("schemaChange"),
            F.when((F.col("job_result") == "Failed") & (n % 2 == 0), "upstream returned 500").alias(
                "error"
            ),
        )
    )
    return rows.select(
        "source_id",
        "run_id",
        k.cast("int").alias("attempt"),
        F.col("created_at"),
        F.timestamp_micros(F.unix_micros("created_at") + k * 1_000_000).alias("started_at"),
        F.when(last & (n % 11 == 0), F.lit("panic: out of memory"))
        .when(last & (n % 13 == 0), F.lit(None))
        .otherwise(report)
        .alias("report"),
    )


@BOOK.add(
    "latest_attempt",
    f"""{_LG}, {_JOBS}
    SELECT source_id, run_id, CAST(attempts AS INTEGER) AS attempt,
      created_at + to_seconds(attempts) AS started_at FROM j""",
)
def latest_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = _attempts(_jobs(_runs(spark, sf_dir)))
    return _plain(
        ledger.latest_attempt(attempts).select("source_id", "run_id", "attempt", "started_at")
    )


@BOOK.add(
    "run_outcome",
    f"""{_LG}, {_JOBS}
    SELECT source_id, run_id, result,
      CASE WHEN readable THEN n % 1000 ELSE 0 END AS rows_ingested,
      CASE WHEN readable THEN n % 20 + 1 ELSE 0 END AS request_count,
      CASE WHEN readable AND error IS NOT NULL THEN error
        WHEN readable AND n % 10 = 0 THEN 'record shape changed: added tenant'
        WHEN result = 'Failed' THEN CASE n % 4 WHEN 1 THEN 'BackoffLimitExceeded: gone'
          WHEN 3 THEN 'DeadlineExceeded' ELSE 'run did not complete' END END AS message
    FROM reported""",
)
def run_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = _jobs(_runs(spark, sf_dir))
    return ledger.runs_from_reports(jobs, _attempts(jobs)).select(
        "source_id", "run_id", "result", "rows_ingested", "request_count", "message"
    )


# --- folds --------------------------------------------------------------------------------

_OK = "result = 'Succeeded'"
_FOLD = f"""fold AS (SELECT source_id,
    coalesce(sum(rows_ingested) FILTER (result <> 'Running'), 0) AS total_rows_ingested,
    arg_max(run_id, (run_time, run_id)) FILTER (result <> 'Running') AS last_finished,
    arg_max(run_id, (run_time, run_id)) FILTER (result = 'Running') AS running,
    arg_max(run_id, (run_time, run_id)) FILTER ({_OK}) AS last_successful,
    max(strftime(run_time, '%Y%m%d%H%M%S') || run_id) FILTER ({_OK}) AS last_ok,
    arg_max(schema_fingerprint, (run_time, run_id)) FILTER ({_OK} AND schema_fingerprint IS NOT NULL)
      AS schema_fingerprint,
    arg_max(watermark, (run_time, run_id))
      FILTER ({_OK} AND backfill_id IS NULL AND watermark IS NOT NULL) AS watermark,
    arg_max(backfill_id, (run_time, run_id)) FILTER ({_OK} AND backfill_id IS NOT NULL)
      AS last_completed_backfill_id
  FROM runs GROUP BY source_id),
streak AS (SELECT f.source_id, CAST(count(r.run_id) AS INTEGER) AS consecutive_failures
  FROM fold f LEFT JOIN runs r ON r.source_id = f.source_id AND r.result = 'Failed'
    AND (f.last_ok IS NULL OR strftime(r.run_time, '%Y%m%d%H%M%S') || r.run_id > f.last_ok)
  GROUP BY f.source_id)"""


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(ledger.fold_runs(_runs(spark, sf_dir)), "folded")


@BOOK.add(
    "status_fold",
    f"""{_LG}, {_FOLD} SELECT source_id, CAST(total_rows_ingested AS BIGINT) AS total_rows_ingested,
      last_finished, running, last_successful, schema_fingerprint, watermark,
      last_completed_backfill_id FROM fold""",
)
def status_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.fold_runs(_runs(spark, sf_dir)).select(
        "source_id",
        "total_rows_ingested",
        F.col("last_finished_run.run_id").alias("last_finished"),
        F.col("running_run.run_id").alias("running"),
        F.col("last_successful_run.run_id").alias("last_successful"),
        "schema_fingerprint",
        "watermark",
        "last_completed_backfill_id",
    )


@BOOK.add("failure_streak", f"{_LG}, {_FOLD} SELECT * FROM streak")
def failure_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.failure_streaks(_runs(spark, sf_dir), _folded(spark, sf_dir))


@BOOK.add(
    "running_failures",
    f"""{_LG}, g AS (SELECT *, sum(CASE WHEN {_OK} THEN 1 ELSE 0 END)
        OVER (PARTITION BY source_id ORDER BY run_time, run_id) AS grp
        FROM runs WHERE result <> 'Running')
    SELECT source_id, run_id, CAST(sum(CASE WHEN result = 'Failed' THEN 1 ELSE 0 END)
      OVER (PARTITION BY source_id, grp ORDER BY run_time, run_id) AS BIGINT) AS streak FROM g""",
)
def running_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.running_failures(_runs(spark, sf_dir)).select("source_id", "run_id", "streak")


_CHANGES = f"""shaped AS (SELECT *, lag(schema_fingerprint)
    OVER (PARTITION BY source_id ORDER BY run_time, run_id) AS previous_fingerprint
  FROM runs WHERE {_OK} AND schema_fingerprint IS NOT NULL),
changes AS (SELECT * FROM shaped WHERE schema_fingerprint <> previous_fingerprint)"""


@BOOK.add(
    "fingerprint_changes",
    f"""{_LG}, {_CHANGES} SELECT source_id, run_id, schema_fingerprint, previous_fingerprint
    FROM changes""",
)
def fingerprint_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.fingerprint_changes(_runs(spark, sf_dir)).select(
        "source_id", "run_id", "schema_fingerprint", "previous_fingerprint"
    )


@BOOK.add(
    "incremental_fold",
    f"""{_LG}, {_FOLD} SELECT f.source_id, CAST(total_rows_ingested AS BIGINT) AS total_rows_ingested,
      last_finished, running, last_successful, schema_fingerprint, watermark,
      last_completed_backfill_id, consecutive_failures
    FROM fold f JOIN streak s ON s.source_id = f.source_id""",
)
def incremental_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches of the ledger, the first two folded into snapshots; a third of the first's
    runs had failed with other counts before, and half of the second's were still going on."""
    store = Store(spark, f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}")
    runs = _runs(spark, sf_dir).withColumn("table_name", F.lit(None).cast("string"))
    n = F.substring("run_id", 2, 9).cast("bigint")
    failed = {"result": F.lit("Failed"), "rows_ingested": F.lit(7).cast("bigint"), "attempt": F.lit(0)}
    going = {"result": F.lit("Running"), "completed_at": F.lit(None).cast("timestamp"), "attempt": F.lit(0)}
    batches = [
        runs.where(n % 3 == 0).unionByName(runs.where(n % 9 == 1).withColumns(failed)),
        runs.where(n % 3 == 1).unionByName(runs.where(n % 6 == 2).withColumns(going)),
        runs.where(n % 3 == 2),
    ]
    for i, batch in enumerate(batches):
        if i:
            store.snapshot()
        store.append_runs(batch.withColumn("batch_id", F.lit(f"b{i}")))
    return store.folded().join(store.streaks(), "source_id").select(
        "source_id",
        "total_rows_ingested",
        F.col("last_finished_run.run_id").alias("last_finished"),
        F.col("running_run.run_id").alias("running"),
        F.col("last_successful_run.run_id").alias("last_successful"),
        "schema_fingerprint",
        "watermark",
        "last_completed_backfill_id",
        "consecutive_failures",
    )


# --- status -------------------------------------------------------------------------------

_STATUS = f"""{inputs.LEDGER_SPECS_CTE}, {_FOLD},
st0 AS (SELECT sp.*, f.running, f.watermark, coalesce(k.consecutive_failures, 0) AS streak,
    CASE WHEN sp.suspend_after > 0 AND coalesce(k.consecutive_failures, 0) >= sp.suspend_after
      THEN 'auto' WHEN suspend THEN 'suspended'
      WHEN coalesce(k.consecutive_failures, 0) > 0 THEN 'failing' ELSE 'healthy' END AS state
  FROM sp LEFT JOIN fold f ON f.source_id = sp.source_id
    LEFT JOIN streak k ON k.source_id = sp.source_id),
status AS (SELECT source_id, streak, watermark, format, CASE state WHEN 'suspended' THEN 'Suspended'
    WHEN 'healthy' THEN CASE WHEN running IS NOT NULL THEN 'Running' ELSE 'Scheduled' END
    ELSE 'Degraded' END AS phase, state, state = 'auto' AS auto_suspended,
    state = 'suspended' AS suspend_requested FROM st0)"""


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    folded = _folded(spark, sf_dir)
    specs = stage(with_defaults(inputs.ledger_specs(spark, sf_dir)), "specs")
    none = specs.select("source_id", F.lit("x").alias("request_id")).where("false")
    return st.status_rows(
        specs.drop("watermark"), folded, ledger.failure_streaks(runs, folded), none
    )


@BOOK.add(
    "phase",
    f"""{_LG}, {_STATUS} SELECT source_id, phase, CASE state
      WHEN 'auto' THEN 'Scheduled=False/AutoSuspended Degraded=True/ConsecutiveFailures Ready=False/AutoSuspended'
      WHEN 'suspended' THEN 'Scheduled=False/Suspended Degraded=False/Suspended Ready=True/Suspended'
      WHEN 'failing' THEN 'Scheduled=True/CronJobReady Degraded=True/RunFailed Ready=False/RunFailed'
      ELSE 'Scheduled=True/CronJobReady Degraded=False/NoFailures Ready=True/Scheduled' END
      || ' Backfilling=False/NoBackfill' AS conditions
    FROM status""",
)
def phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.array_join(
        F.transform(
            "conditions", lambda c: F.concat(c["type"], F.lit("="), c["status"], F.lit("/"), c["reason"])
        ),
        " ",
    )
    return _status(spark, sf_dir).select("source_id", "phase", text.alias("conditions"))


@BOOK.add(
    "auto_suspend",
    f"""{_LG}, {_STATUS} SELECT source_id, streak AS consecutive_failures, auto_suspended,
      suspend_requested FROM status""",
)
def auto_suspend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _status(spark, sf_dir).select(
        "source_id", "consecutive_failures", "auto_suspended", "suspend_requested"
    )


_REQUESTS = """req AS (
  SELECT 's' || lpad(CAST(c_custkey % 25 AS STRING), 2, '0') AS source_id,
    CASE WHEN c_custkey % 2 = 0 THEN 'backfill' ELSE 'trigger' END AS kind,
    CASE WHEN c_custkey % 4 = 0 THEN 'b' || CAST(c_custkey % 80 AS STRING)
      ELSE 'q' || CAST(c_custkey AS STRING) END AS request_id,
    '2024-01-01T00:00:00Z' AS from_value, CAST(NULL AS STRING) AS to_value
  FROM customer),
asked AS (SELECT *, source_id || '-' || kind || '-' || substr(sha256(request_id), 1, 8) AS run_id
  FROM req),
begun AS (SELECT DISTINCT source_id, run_id, kind, request_id, TIMESTAMP '2001-09-01 00:00:00' AS begun_at
  FROM asked WHERE substr(sha256(request_id), 1, 1) < '4')"""


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    return inputs.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("s"), F.lpad((n % 25).cast("string"), 2, "0")).alias("source_id"),
        F.when(n % 2 == 0, "backfill").otherwise("trigger").alias("kind"),
        F.when(n % 4 == 0, F.concat(F.lit("b"), (n % 80).cast("string")))
        .otherwise(F.concat(F.lit("q"), n.cast("string")))
        .alias("request_id"),
        F.lit("2024-01-01T00:00:00Z").alias("from_value"),
        F.lit(None).cast("string").alias("to_value"),
    )


def _runs_with_one_offs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger plus a run, still going, for about a quarter of the requests."""
    asked = _requests(spark, sf_dir).where(F.substring(F.sha2("request_id", 256), 1, 1) < "4")
    begun = asked.select(
        "source_id",
        st.one_off_run_id(F.col("source_id"), F.col("kind"), F.col("request_id")).alias("run_id"),
        "kind",
        F.lit(datetime(2001, 9, 1)).alias("started_at"),
        F.lit("Running").alias("result"),
    ).distinct()
    return _runs(spark, sf_dir).unionByName(begun, allowMissingColumns=True)


@BOOK.add(
    "pending_requests",
    f"""{_LG}, {_REQUESTS} SELECT DISTINCT source_id, kind, request_id, run_id FROM asked a
    WHERE NOT EXISTS (SELECT 1 FROM begun b WHERE b.run_id = a.run_id)
      AND NOT (kind = 'backfill' AND EXISTS (SELECT 1 FROM runs r WHERE r.source_id = a.source_id
        AND r.result = 'Succeeded' AND r.backfill_id = a.request_id))""",
)
def pending_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending = st.pending_requests(_requests(spark, sf_dir), _runs_with_one_offs(spark, sf_dir))
    return pending.select("source_id", "kind", "request_id", "run_id").distinct()


@BOOK.add(
    "due_requests",
    f"""{_LG}, {_STATUS}, {_REQUESTS}
    SELECT source_id, 'scheduled' AS kind, CAST(NULL AS STRING) AS request_id, 'https://vendor.invalid/x'
        || coalesce('?since=' || replace(watermark, ':', '%3A'), '') AS url
      FROM status WHERE state NOT IN ('auto', 'suspended')
    UNION ALL SELECT DISTINCT source_id, kind, request_id,
        'https://vendor.invalid/x?since=2024-01-01T00%3A00%3A00Z' FROM asked a
      WHERE source_id IN (SELECT source_id FROM sp) AND NOT EXISTS (SELECT 1 FROM begun b WHERE b.run_id = a.run_id)
        AND NOT (kind = 'backfill' AND EXISTS (SELECT 1 FROM runs r WHERE r.source_id = a.source_id
          AND r.result = 'Succeeded' AND r.backfill_id = a.request_id))""",
)
def due_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First requests of all runs that are due; suspended sources have none but those asked for by name."""
    runs, folded = _runs(spark, sf_dir), _folded(spark, sf_dir)
    specs = stage(with_defaults(inputs.ledger_specs(spark, sf_dir)), "specs")
    off = st.suspended_sources(specs, ledger.failure_streaks(runs, folded))
    pending = st.pending_requests(_requests(spark, sf_dir), _runs_with_one_offs(spark, sf_dir))
    due = st.due_runs(specs, off, pending)
    # One spec a run, so that each has its own bounds.
    run = F.concat_ws(" ", "source_id", "kind", "request_id")
    each = due.join(specs, "source_id").withColumn("of", F.col("source_id")).withColumn("source_id", run)
    asked = F.when(F.col("kind") != "scheduled", F.lit("2024-01-01T00:00:00Z"))
    resumed = folded.select(F.col("source_id").alias("of"), F.col("watermark").alias("resume_point"))
    bounds = each.select("source_id", "of", asked.alias("asked")).join(resumed, "of", "left").select(
        "source_id", F.coalesce("asked", "resume_point").alias("from_value"), F.lit(None).cast("string").alias("to_value")
    )
    steps = each.select("source_id", F.lit(0).alias("page_index"), *[F.lit(None).cast("string").alias(c) for c in ("cursor", "next_url")])
    planned = plan_requests(each, bounds, steps)
    return planned.join(each.select("source_id", "of", "kind", "request_id"), "source_id").select(
        F.col("of").alias("source_id"), "kind", "request_id", "url"
    )


@BOOK.add(
    "event_log",
    f"""{_LG}, {_STATUS}, {_CHANGES}, {_REQUESTS}
    SELECT source_id, run_time AS "at", 'Warning' AS severity, 'RunFailed' AS reason,
      'run ' || run_id || ' failed: ' || message AS message FROM runs WHERE result = 'Failed'
    UNION ALL SELECT source_id, run_time, 'Warning', 'SchemaDrift',
      'record shape changed in run ' || run_id || ': ' || coalesce(message, '') FROM changes
    UNION ALL SELECT source_id, run_time, 'Normal', 'BackfillCompleted',
      'backfill "' || backfill_id || '" ingested ' || CAST(rows_ingested AS STRING) || ' rows'
      FROM runs WHERE {_OK} AND backfill_id IS NOT NULL
    UNION ALL SELECT source_id, begun_at, 'Normal',
      CASE kind WHEN 'backfill' THEN 'BackfillStarted' ELSE 'RunTriggered' END,
      CASE kind WHEN 'backfill'
        THEN 'started backfill "' || request_id || '" over [2024-01-01T00:00:00Z, ]'
        ELSE 'started run ' || run_id END FROM begun
    UNION ALL SELECT source_id, {_AS_OF_SQL}, 'Warning', 'AutoSuspended',
      'scheduling stopped after ' || CAST(streak AS STRING) || ' consecutive failures'
      FROM status WHERE auto_suspended""",
)
def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = st.events(
        _runs_with_one_offs(spark, sf_dir),
        _requests(spark, sf_dir).distinct(),
        _status(spark, sf_dir),
        inputs.ledger_specs(spark, sf_dir),
        F.lit(_AS_OF),
    )
    return _plain(log)


@BOOK.add(
    "status_changed",
    f"{_LG}, {_STATUS} SELECT source_id, phase FROM status WHERE source_id < 's05' OR streak > 0",
)
def status_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses that differ once five rows are missing and failing ones had a lower streak before."""
    now = stage(_status(spark, sf_dir), "status")
    before = now.where(F.col("source_id") >= "s05").withColumn(
        "consecutive_failures",
        F.greatest(F.col("consecutive_failures") - 1, F.lit(0)),
    )
    return st.changed_status(before, now).select("source_id", "phase")


# --- membership and accounting ------------------------------------------------------------


@BOOK.add(
    "membership",
    f"""{_LG}, {inputs.LEDGER_SPECS_CTE} SELECT source_id, run_id FROM runs
    WHERE source_id IN (SELECT source_id FROM sp) AND (n % 4 = 0 OR n % 4 = 1)""",
)
def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter owned directly, a quarter through the scheduler, the rest mislabelled or strangers."""
    n = F.substring("run_id", 2, 9).cast("bigint")
    owned = _runs(spark, sf_dir).select(
        "source_id",
        "run_id",
        F.when(n % 4 == 0, "source").when(n % 4 == 3, "stranger").otherwise("scheduler").alias(
            "owner_kind"
        ),
        F.col("source_id").alias("owner_name"),
        F.when(n % 4 == 2, "other").otherwise(F.col("source_id")).alias("label_source"),
    )
    return ledger.member_runs(owned, inputs.ledger_specs(spark, sf_dir)).select("source_id", "run_id")


@BOOK.add(
    "unaccounted",
    f"{_LG} SELECT source_id, run_id FROM runs WHERE result <> 'Running' AND n % 3 = 0",
)
def unaccounted(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    done = runs.where(F.substring("run_id", 2, 9).cast("bigint") % 3 != 0)
    return ledger.unaccounted(runs, done.select("source_id", "run_id")).select("source_id", "run_id")


# --- metrics ------------------------------------------------------------------------------


def _flat(metrics: DataFrame) -> DataFrame:
    """Labels as sorted text."""
    text = F.array_join(
        F.transform(
            F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit("="), e["value"])
        ),
        ",",
    )
    return metrics.select("metric", "source_id", text.alias("labels"), "value")


_COUNTERS = """fin AS (SELECT * FROM runs WHERE result <> 'Running'),
counters AS (
  SELECT 'rows_ingested_total' AS metric, source_id, '' AS labels,
    CAST(sum(rows_ingested) AS DOUBLE) AS value FROM fin GROUP BY source_id HAVING sum(rows_ingested) > 0
  UNION ALL SELECT 'rows_rejected_total', source_id, '', CAST(sum(rows_rejected) AS DOUBLE)
    FROM fin GROUP BY source_id HAVING sum(rows_rejected) > 0
  UNION ALL SELECT 'upstream_requests_total', source_id, '', CAST(sum(request_count) AS DOUBLE)
    FROM fin GROUP BY source_id
  UNION ALL SELECT 'runs_total', source_id,
    'kind=' || CASE WHEN backfill_id IS NOT NULL THEN 'backfill' ELSE 'scheduled' END
    || ',result=' || lower(result), CAST(count(*) AS DOUBLE) FROM fin
    GROUP BY source_id, backfill_id IS NOT NULL, lower(result),
      CASE WHEN backfill_id IS NOT NULL THEN 'backfill' ELSE 'scheduled' END
  UNION ALL SELECT 'schema_changes_total', source_id,
    CASE WHEN removed IS NULL THEN 'kind=additive' ELSE 'kind=breaking' END,
    CAST(count(*) AS DOUBLE) FROM fin WHERE added IS NOT NULL
    GROUP BY source_id, CASE WHEN removed IS NULL THEN 'kind=additive' ELSE 'kind=breaking' END)"""


@BOOK.add("metric_counters", f"{_LG}, {_COUNTERS} SELECT * FROM counters")
def metric_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(ops_metrics.run_counters(_runs(spark, sf_dir)))


@BOOK.add(
    "forget_deleted",
    f"""{_LG}, {inputs.LEDGER_SPECS_CTE}, {_COUNTERS} SELECT * FROM counters
    WHERE source_id IN (SELECT source_id FROM sp)""",
)
def forget_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = ops_metrics.run_counters(_runs(spark, sf_dir))
    return _flat(ops_metrics.forget_deleted(metrics, inputs.ledger_specs(spark, sf_dir)))


@BOOK.add(
    "duration_histogram",
    f"""{_LG}, d AS (SELECT source_id, epoch_us(completed_at) - epoch_us(started_at) AS us
        FROM runs WHERE completed_at IS NOT NULL),
      le AS (SELECT unnest([1, 5, 15, 30, 60, 300, 900, 1800, 3600, 7200]) AS le)
    SELECT 'run_duration_seconds_bucket' AS metric, source_id, 'le=' || CAST(le AS STRING) AS labels,
      CAST(count(*) FILTER (us <= CAST(le AS BIGINT) * 1000000) AS DOUBLE) AS value FROM d, le GROUP BY source_id, le
    UNION ALL SELECT 'run_duration_seconds_bucket', source_id, 'le=+Inf', CAST(count(*) AS DOUBLE)
      FROM d GROUP BY source_id
    UNION ALL SELECT 'run_duration_seconds_sum', source_id, '', CAST(sum(us) // 1000000 AS DOUBLE)
      FROM d GROUP BY source_id
    UNION ALL SELECT 'run_duration_seconds_count', source_id, '', CAST(count(*) AS DOUBLE)
      FROM d GROUP BY source_id""",
)
def duration_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(ops_metrics.duration_histogram(_runs(spark, sf_dir)))


@BOOK.add(
    "watermark_lag",
    f"""{_LG}, {_STATUS} SELECT 'watermark_lag_seconds' AS metric, source_id, '' AS labels,
      CAST((epoch_us({_AS_OF_SQL}) - epoch_us(strptime(watermark, '%Y-%m-%dT%H:%M:%SZ'))) // 1000000
        AS DOUBLE) AS value
    FROM status WHERE format = 'RFC3339' AND watermark IS NOT NULL""",
)
def watermark_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = with_defaults(inputs.ledger_specs(spark, sf_dir))
    return _flat(ops_metrics.resume_lag(_status(spark, sf_dir), specs, F.lit(_AS_OF)))


@BOOK.add(
    "gauges",
    f"""{_LG}, {_STATUS}
    SELECT 'consecutive_failures' AS metric, source_id, '' AS labels, CAST(streak AS DOUBLE) AS value
      FROM status
    UNION ALL SELECT 'suspended', source_id, 'reason=requested',
      CASE WHEN suspend_requested THEN 1.0 ELSE 0.0 END FROM status
    UNION ALL SELECT 'suspended', source_id, 'reason=failures',
      CASE WHEN auto_suspended THEN 1.0 ELSE 0.0 END FROM status""",
)
def gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(ops_metrics.gauges(stage(_status(spark, sf_dir), "status")))
