"""Operational metrics as a long table.

``(metric, source_id, labels, value)``; labels hold only what an operator
declared, never anything a vendor sent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from harvestline.functions.ordering import key_seconds, order_key
from harvestline.model import DURATION_BUCKETS
from harvestline.operators.drift import is_breaking, is_empty

_NO_LABELS = "map<string,string>"


def _labels(**names: Column | str) -> Column:
    if not names:
        return F.create_map().cast(_NO_LABELS)
    flat = []
    for key, value in names.items():
        flat += [F.lit(key), F.lit(value) if isinstance(value, str) else value]
    return F.create_map(*flat).cast(_NO_LABELS)


def _series(df: DataFrame, metric: Column | str, labels: Column, value: Column) -> DataFrame:
    metric = F.lit(metric) if isinstance(metric, str) else metric
    return df.select(
        metric.alias("metric"),
        "source_id",
        labels.alias("labels"),
        value.cast("double").alias("value"),
    )


def run_counters(runs: DataFrame) -> DataFrame:
    """Totals of finished runs; a series exists once it has something to count."""
    finished = runs.where(F.col("result") != "Running")
    totals = finished.groupBy("source_id").agg(
        F.sum("rows_ingested").alias("rows_ingested_total"),
        F.sum("rows_rejected").alias("rows_rejected_total"),
        F.sum("request_count").alias("upstream_requests_total"),
    )
    names = ("rows_ingested_total", "rows_rejected_total", "upstream_requests_total")
    sums = totals.unpivot(["source_id"], list(names), "metric", "value").where(F.col("value") > 0)
    sums = _series(sums, F.col("metric"), _labels(), F.col("value"))

    kind = F.when(F.coalesce("backfill_id", F.lit("")) != "", "backfill").otherwise("scheduled")
    outcome = F.when(F.col("result") == "Succeeded", "succeeded").otherwise("failed")
    counted = finished.groupBy(
        "source_id", outcome.alias("outcome"), kind.alias("run_kind")
    ).agg(F.count("*").alias("n"))
    by_result = _series(
        counted, "runs_total", _labels(result=F.col("outcome"), kind=F.col("run_kind")), F.col("n")
    )
    return sums.unionByName(by_result).unionByName(shape_change_counters(finished))


def shape_change_counters(runs: DataFrame) -> DataFrame:
    """Reported shape changes, additive and breaking apart."""
    none = F.array().cast("array<string>")
    part = lambda k: F.coalesce(F.col(f"schema_change.{k}"), none)
    changed = runs.where(~is_empty(part("added"), part("removed"), part("changed")))
    kind = F.when(is_breaking(part("removed"), part("changed")), "breaking").otherwise("additive")
    counted = changed.groupBy("source_id", kind.alias("change_kind")).agg(F.count("*").alias("n"))
    return _series(
        counted, "schema_changes_total", _labels(kind=F.col("change_kind")), F.col("n")
    )


def duration_histogram(runs: DataFrame) -> DataFrame:
    """Cumulative buckets, sum and count of run durations.

    One pass with one conditional count per bucket; only runs with both a start
    and an end count, so failed runs without an end do not.
    """
    seconds = (F.unix_micros("completed_at") - F.unix_micros("started_at")) / F.lit(1e6)
    timed = runs.where(F.col("result") != "Running").select(
        "source_id", seconds.alias("seconds")
    ).where(F.col("seconds") >= 0)
    folded = timed.groupBy("source_id").agg(
        *[F.count_if(F.col("seconds") <= le).alias(f"le_{le}") for le in DURATION_BUCKETS],
        F.count("*").alias("n"),
        F.sum("seconds").alias("total"),
    )
    buckets = F.array(
        *[
            F.struct(F.lit(str(le)).alias("le"), F.col(f"le_{le}").alias("n"))
            for le in DURATION_BUCKETS
        ],
        F.struct(F.lit("+Inf").alias("le"), F.col("n").alias("n")),
    )
    by_bucket = folded.select("source_id", F.inline(buckets))
    return (
        _series(by_bucket, "run_duration_seconds_bucket", _labels(le=F.col("le")), F.col("n"))
        .unionByName(_series(folded, "run_duration_seconds_sum", _labels(), F.col("total")))
        .unionByName(_series(folded, "run_duration_seconds_count", _labels(), F.col("n")))
    )


def resume_lag(status: DataFrame, specs: DataFrame, as_of: Column) -> DataFrame:
    """Age of the resume point; opaque and unreadable ones report nothing."""
    formats = specs.where(F.col("watermark").isNotNull()).select(
        "source_id", F.coalesce(F.col("watermark.format"), F.lit("")).alias("format")
    )
    read = status.select("source_id", F.col("watermark").alias("value")).join(formats, "source_id")
    key = order_key(F.col("value"), F.col("format"))
    at = key_seconds(key, F.col("format"))
    now = F.unix_micros(as_of) / F.lit(1e6)
    lagged = read.select("source_id", (now - at).alias("lag")).where(F.col("lag").isNotNull())
    return _series(lagged, "watermark_lag_seconds", _labels(), F.col("lag"))


def gauges(status: DataFrame) -> DataFrame:
    """Failure streak, and suspension told apart by who asked for it."""
    flag = lambda c: F.col(c).cast("int")
    return (
        _series(status, "consecutive_failures", _labels(), F.col("consecutive_failures"))
        .unionByName(
            _series(status, "suspended", _labels(reason="requested"), flag("suspend_requested"))
        )
        .unionByName(_series(status, "suspended", _labels(reason="failures"), flag("auto_suspended")))
    )


def forget_deleted(metrics: DataFrame, specs: DataFrame) -> DataFrame:
    """Drop every series of a source that no longer exists."""
    return metrics.join(specs.select("source_id"), "source_id", "left_semi")
