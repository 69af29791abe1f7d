"""Judging a landed request log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from harvestline.functions.web import doubling_backoff, retry_after_seconds
from harvestline.model import MAX_ATTEMPTS, MAX_BACKOFF_SECONDS
from harvestline.operators.sequences import lag_in_buckets

PAGE = ("source_id", "run_id", "page_no")


def response_class(status: Column) -> Column:
    """A missing status is a transport error, which is worth another attempt."""
    return (
        F.when(status.isNull() | (status == 429) | (status >= 500), "retryable")
        .when(status >= 300, "terminal")
        .otherwise("ok")
    )


def page_outcomes(log: DataFrame) -> DataFrame:
    """What became of each page: ok, terminal, gave_up, or pending a retry."""
    last = log.groupBy(*PAGE).agg(
        F.count("*").alias("attempts"), F.max_by("status", "attempt").alias("last_status")
    )
    kind = response_class(F.col("last_status"))
    outcome = (
        F.when(kind != "retryable", kind)
        .when(F.col("attempts") >= MAX_ATTEMPTS, "gave_up")
        .otherwise("pending")
    )
    return last.withColumn("outcome", outcome)


def backoff_audit(log: DataFrame) -> DataFrame:
    """Delay required before each retry against the delay taken.

    Needs ``(page key, attempt, requested_at, retry_after)``.  The window is one
    page's attempts, a handful of rows.
    """
    order = Window.partitionBy(*PAGE).orderBy("attempt")
    paired = log.select(
        *PAGE,
        "attempt",
        "requested_at",
        F.lag("requested_at").over(order).alias("previous_at"),
        F.lag("retry_after").over(order).alias("asked"),
    ).where(F.col("attempt") > 1)
    required = F.coalesce(
        retry_after_seconds(F.col("asked"), F.col("previous_at")),
        doubling_backoff(F.col("attempt"), MAX_BACKOFF_SECONDS),
    )
    actual = (F.unix_micros("requested_at") - F.unix_micros("previous_at")) / F.lit(1e6)
    return paired.select(
        *PAGE,
        "attempt",
        required.alias("required_seconds"),
        actual.alias("actual_seconds"),
        (actual < required).alias("too_soon"),
    )


def rate_audit(log: DataFrame, limits: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """Calls that followed the one before too quickly.

    ``limits``: ``(source_id, max_requests_per_second)``; zero is unthrottled.
    ``request_id`` breaks ties of time.
    """
    calls = log.join(limits, "source_id").where(F.col("max_requests_per_second") > 0)
    bucket = F.floor(F.unix_micros("requested_at") / F.lit(bucket_seconds * 1_000_000))
    lagged = lag_in_buckets(
        calls,
        ("source_id", "run_id"),
        ("requested_at", "request_id"),
        {"requested_at": "previous_at"},
        bucket,
    )
    gap = F.unix_micros("requested_at") - F.unix_micros("previous_at")
    interval = F.floor(F.lit(1_000_000) / F.col("max_requests_per_second"))
    return lagged.select(
        "source_id",
        "run_id",
        "request_id",
        gap.alias("gap_micros"),
        interval.alias("interval_micros"),
        F.coalesce(gap < interval, F.lit(False)).alias("violation"),
    )


def request_counts(log: DataFrame) -> DataFrame:
    """Every call counts, retries included."""
    return log.groupBy("source_id", "run_id").agg(F.count("*").alias("request_count"))
