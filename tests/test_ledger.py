"""Folding the ledger."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from conftest import rows_of, spec
from harvestline import model as m
from harvestline.operators import ledger, ops_metrics, status as st
from harvestline.operators.specs import config_digest, with_defaults, with_violations
from harvestline.plans.fold import fold

T0 = datetime(2026, 1, 1)


def run_row(source, n, result, kind="scheduled", backfill=None, rows=0, watermark=None, fp=None, change=None, error=None, seconds=60, message=None):
    start = T0 + timedelta(hours=n)
    end = start + timedelta(seconds=seconds) if result == "Succeeded" else None
    return (source, f"r{n:05d}", 1, kind, backfill, start, start, end, result, rows, 0, 0, 1, watermark, fp, change, error, message or error)


def test_fold(spark, specs_df):
    runs = spark.createDataFrame(
        [
            # A backfill adds its rows and moves nothing else; a failure's rows count too.
            run_row("a", 1, "Succeeded", rows=3, watermark="2026-06-01T00:00:00Z", fp="f1"),
            run_row("a", 2, "Succeeded", "backfill", "january", rows=100, watermark="2020-01-01T00:00:00Z"),
            run_row("a", 3, "Failed", rows=5, error="boom"),
            # Two failures reach the limit; the resume point stands.
            run_row("b", 1, "Succeeded", rows=1, watermark="2026-05-01T00:00:00Z", fp="f1"),
            run_row("b", 2, "Failed", error="x"),
            run_row("b", 3, "Failed", error="x"),
            # A success clears the streak; the last value counts, not the greatest.
            run_row("c", 1, "Succeeded", watermark="2026-03-01T00:00:00Z", fp="f1"),
            run_row("c", 2, "Failed", error="x"),
            run_row("c", 3, "Succeeded", watermark="2026-02-01T00:00:00Z", fp="f2", message="record shape changed: added t"),
            run_row("c", 4, "Running"),
            run_row("gone", 1, "Failed", error="x"),
        ],
        m.RUNS,
    )
    specs = specs_df(
        spec("a"), spec("b", suspend_after=2), spec("c"), spec("idle"), spec("bad", url="ftp://x"),
    )
    asked = spark.createDataFrame([("c", "trigger", "t1", None, None)], m.REQUESTS)
    out = fold(runs, specs, asked, datetime(2026, 6, 1, 2))
    s = {r.source_id: r for r in out.status.collect()}
    assert set(s) == {"a", "b", "c", "idle", "bad"}
    assert (s["a"].total_rows_ingested, s["a"].watermark, s["a"].last_completed_backfill_id) == (108, "2026-06-01T00:00:00Z", "january")
    assert (s["a"].phase, s["a"].consecutive_failures, s["a"].auto_suspended) == ("Degraded", 1, False)
    assert (s["b"].phase, s["b"].consecutive_failures, s["b"].auto_suspended) == ("Degraded", 2, True)
    assert s["b"].watermark == "2026-05-01T00:00:00Z"
    by_type = {c.type: (c.status, c.reason) for c in s["b"].conditions}
    assert by_type == {"Scheduled": ("False", "AutoSuspended"), "Degraded": ("True", "ConsecutiveFailures"), "Ready": ("False", "AutoSuspended"), "Backfilling": ("False", "NoBackfill")}
    assert (s["c"].phase, s["c"].consecutive_failures, s["c"].watermark, s["c"].schema_fingerprint) == ("Running", 0, "2026-02-01T00:00:00Z", "f2")
    assert (s["c"].last_run.run_id, s["c"].last_run.result, s["c"].last_successful_run.run_id) == ("r00004", "Running", "r00003")
    assert (s["idle"].phase, s["idle"].total_rows_ingested) == ("Scheduled", 0)
    assert s["bad"].phase == "Degraded" and s["bad"].conditions[0].reason == "InvalidSpec"

    events = {(r.source_id, r.reason): r.message for r in out.events.collect()}
    assert events[("a", "BackfillCompleted")] == 'backfill "january" ingested 100 rows'
    assert events[("a", "RunFailed")] == "run r00003 failed: boom"
    assert events[("c", "SchemaDrift")] == "record shape changed in run r00003: record shape changed: added t"
    assert events[("b", "AutoSuspended")] == "scheduling stopped after 2 consecutive failures"
    assert ("bad", "InvalidSpec") in events

    metrics = {(r.metric, r.source_id, tuple(sorted(r.labels.items()))): r.value for r in out.metrics.collect()}
    assert metrics[("watermark_lag_seconds", "a", ())] == 7200.0
    assert metrics[("runs_total", "a", (("kind", "backfill"), ("result", "succeeded")))] == 1
    assert metrics[("suspended", "b", (("reason", "failures"),))] == 1
    assert metrics[("run_duration_seconds_bucket", "a", (("le", "30"),))] == 0
    assert metrics[("run_duration_seconds_bucket", "a", (("le", "60"),))] == 2
    assert not any(k[1] == "gone" for k in metrics)

    # Folding again gives the same; a changed streak is noticed, an equal status is not.
    assert st.changed_status(out.status, fold(runs, specs, asked, datetime(2026, 6, 1, 2)).status).isEmpty()
    lower = out.status.withColumn("consecutive_failures", F.lit(0))
    assert rows_of(st.changed_status(lower, out.status), "source_id") == [("a",), ("b",)]


def test_bucketed_sequences_equal_brute_force(spark):
    """One source holds most runs, over months, with gaps; order ties are broken by id."""
    rng = random.Random(7)
    rows = []
    for i in range(600):
        source = "hot" if rng.random() < 0.8 else rng.choice("xyz")
        start = T0 + timedelta(days=rng.choice([0, 1, 40, 41, 130]), hours=rng.randrange(5))
        result = rng.choice(["Succeeded", "Failed", "Failed"])
        end = start if result == "Succeeded" else None
        fp = rng.choice(["f1", "f2", None])
        rows.append((source, f"r{i:05d}", 1, "scheduled", None, start, start, end, result, 0, 0, 0, 0, None, fp, None, None, None))
    runs = spark.createDataFrame(rows, m.RUNS).repartition(7)
    ordered = sorted(rows, key=lambda r: (r[7] or r[6], r[1]))
    streak, want_streak, last, want_changes = {}, {}, {}, {}
    for r in ordered:
        s = r[0]
        streak[s] = 0 if r[8] == "Succeeded" else streak.get(s, 0) + 1
        want_streak[r[1]] = streak[s]
        if r[8] == "Succeeded" and r[14]:
            if s in last and last[s] != r[14]:
                want_changes[r[1]] = last[s]
            last[s] = r[14]
    got = {r.run_id: r.streak for r in ledger.running_failures(runs).collect()}
    assert got == want_streak
    got = {r.run_id: r.previous_fingerprint for r in ledger.fingerprint_changes(runs).collect()}
    assert got == want_changes
    final = {r.source_id: r.consecutive_failures for r in ledger.failure_streaks(runs, ledger.fold_runs(runs)).collect()}
    assert final == streak


def test_outcomes_from_reports(spark):
    jobs = [
        ("s", "ok", "scheduled", None, T0, T0, T0, "Complete", None, None),
        ("s", "reported", "scheduled", None, T0, T0, None, "Failed", "job says", "Backoff"),
        ("s", "reason", "scheduled", None, T0, T0, None, "Failed", None, "Backoff"),
        ("s", "silent", "scheduled", None, T0, T0, None, "Failed", None, None),
        ("s", "drifted", "scheduled", None, T0, T0, None, "Failed", "job says", None),
        ("s", "going", "backfill", "b1", T0, T0, None, None, None, None),
    ]
    jobs = spark.createDataFrame(jobs, "source_id string, run_id string, kind string, backfill_id string, created_at timestamp, started_at timestamp, completed_at timestamp, job_result string, job_message string, job_reason string")
    at = [T0 + timedelta(seconds=i) for i in range(3)]
    reports = [
        ("s", "ok", 1, T0, at[0], '{"rowsIngested":9}'),
        ("s", "ok", 2, T0, at[1], '{"rowsIngested":42,"requestCount":3,"watermark":"w","backfillID":"b9"}'),
        ("s", "reported", 1, T0, at[0], '{"error":"upstream returned 500","schemaChange":{"added":["t"]}}'),
        ("s", "reason", 1, T0, at[0], '{"error":"old attempt"}'),
        ("s", "reason", 2, T0, at[2], "panic: out of memory"),
        ("s", "drifted", 1, T0, at[0], '{"schemaChange":{"added":["t"],"changed":["a(number->string)"]}}'),
    ]
    attempts = spark.createDataFrame(reports, "source_id string, run_id string, attempt int, created_at timestamp, started_at timestamp, report string")
    got = {r.run_id: r for r in ledger.runs_from_reports(jobs, attempts).collect()}
    assert (got["ok"].rows_ingested, got["ok"].request_count, got["ok"].backfill_id, got["ok"].message) == (42, 3, "b9", None)
    assert got["reported"].message == "upstream returned 500"
    assert (got["reason"].message, got["reason"].rows_ingested) == ("Backoff", 0)
    assert got["silent"].message == "run did not complete"
    assert got["drifted"].message == "record shape changed: added t; changed a(number->string)"
    assert (got["going"].result, got["going"].message) == ("Running", None)


def test_pending_requests(spark):
    requests = spark.createDataFrame(
        [("s", "backfill", "january", "a", "b"), ("s", "backfill", "old", None, None), ("s", "trigger", "1", None, None), ("s", "trigger", "2", None, None)],
        m.REQUESTS,
    )
    begun = st.one_off_run_id(F.lit("s"), F.lit("trigger"), F.lit("1"))
    runs = spark.createDataFrame([run_row("s", 1, "Succeeded", "backfill", "old")], m.RUNS).unionByName(
        spark.createDataFrame([run_row("s", 2, "Failed", "trigger")], m.RUNS).withColumn("run_id", begun)
    )
    assert rows_of(st.pending_requests(requests, runs), "kind", "request_id") == [("backfill", "january"), ("trigger", "2")]


def test_specs(specs_df):
    specs = specs_df(
        spec("ok"),
        spec("bad", drift="Shrug", destination={"type": "BigQuery"}, pagination={"type": "Cursor", "page_size": 0}),
    )
    full = with_violations(with_defaults(specs))
    got = {r.source_id: r for r in full.collect()}
    assert got["ok"].violations == []
    assert got["bad"].violations == [
        "destination: bigQuery must be set when type is BigQuery", "drift: unknown", "pagination.page_size: below 1"
    ]
    assert (got["ok"].drift, got["ok"].suspend_after, got["ok"].source.method, got["ok"].watermark.format) == ("Warn", 5, "GET", "RFC3339")
    digests = [r.config_digest for r in config_digest(full).collect()]
    assert all(len(d) == 16 for d in digests) and len(set(digests)) == 2


def test_histogram_ignores_unfinished_and_negative(spark):
    runs = spark.createDataFrame(
        [run_row("s", 1, "Succeeded", seconds=5), run_row("s", 2, "Succeeded", seconds=-5), run_row("s", 3, "Failed")], m.RUNS
    )
    got = {(r.metric, r.labels.get("le")): r.value for r in ops_metrics.duration_histogram(runs).collect()}
    assert got[("run_duration_seconds_count", None)] == 1
    assert got[("run_duration_seconds_bucket", "1")] == 0 and got[("run_duration_seconds_bucket", "5")] == 1
