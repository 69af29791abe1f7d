"""Request plans and the request log."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from conftest import rows_of, spec
from harvestline.operators.requestlog import backoff_audit, page_outcomes, rate_audit, request_counts
from harvestline.sources.requests import counted_steps, plan_requests


def test_urls(spark, specs_df):
    specs = specs_df(
        spec("plain", url="https://v.invalid/x"),
        spec("own", url="https://v.invalid/x?b=1&a=%20y&b=2#top", query={"a": "z"}),
        spec("cursor", pagination={"type": "Cursor", "cursor_param": "c", "size_param": "n", "page_size": 5}),
        spec("num", pagination={"type": "PageNumber", "page_param": "page"}),
        spec("off", pagination={"type": "Offset", "page_param": "o", "page_size": 3, "start_page": 2}),
        spec("full", watermark=False),
    )
    bounds = spark.createDataFrame(
        [(s, "2026-01-01T00:00:00Z", "later") for s in ("own", "full")], "source_id string, from_value string, to_value string"
    )
    single = [("plain", 0, None, None), ("own", 0, None, None), ("full", 0, None, None), ("cursor", 0, None, None), ("cursor", 1, "a/b", None), ("plain", 1, None, "https://next.invalid/?q=a b")]
    steps = spark.createDataFrame(single, "source_id string, page_index int, cursor string, next_url string")
    steps = steps.unionByName(counted_steps(specs, F.lit(2)))
    got = {(r.source_id, r.page_index): r.url for r in plan_requests(specs, bounds, steps).collect()}
    assert got == {
        ("plain", 0): "https://v.invalid/x",
        ("plain", 1): "https://next.invalid/?q=a b",
        # Set parameters replace all of a name's own; keys are sorted, repeats keep their order.
        ("own", 0): "https://v.invalid/x?a=z&b=1&b=2&since=2026-01-01T00%3A00%3A00Z#top",
        ("full", 0): "https://vendor.invalid/e",
        ("cursor", 0): "https://vendor.invalid/e?n=5",
        ("cursor", 1): "https://vendor.invalid/e?c=a%2Fb&n=5",
        ("num", 0): "https://vendor.invalid/e?page=1",
        ("num", 1): "https://vendor.invalid/e?page=2",
        ("off", 0): "https://vendor.invalid/e?o=2",
        ("off", 1): "https://vendor.invalid/e?o=5",
    }


def log(spark, rows):
    schema = "source_id string, run_id string, page_no int, attempt int, request_id bigint, requested_at timestamp, status int, retry_after string"
    return spark.createDataFrame(rows, schema)


def test_outcomes_and_backoff(spark):
    t = datetime(2026, 1, 1)
    at = lambda s: t + timedelta(seconds=s)
    rows = [
        ("s", "r", 1, 1, 1, at(0), 429, "7"), ("s", "r", 1, 2, 2, at(5), 200, None),
        ("s", "r", 2, 1, 3, at(0), 401, None),
        ("s", "r", 3, 1, 4, at(0), None, None), ("s", "r", 3, 2, 5, at(1), 500, "0"),
        ("s", "r", 3, 3, 6, at(3), 502, None), ("s", "r", 3, 4, 7, at(6), 503, None),
        ("s", "r", 4, 1, 8, at(0), 500, None),
    ]
    df = log(spark, rows)
    assert rows_of(page_outcomes(df), "page_no", "attempts", "outcome") == [
        (1, 2, "ok"), (2, 1, "terminal"), (3, 4, "gave_up"), (4, 1, "pending")
    ]
    assert rows_of(backoff_audit(df), "page_no", "attempt", "required_seconds", "too_soon") == [
        (1, 2, 7.0, True), (3, 2, 1.0, False), (3, 3, 2.0, False), (3, 4, 4.0, True)
    ]
    assert request_counts(df).head().request_count == 8


def test_rate_across_buckets(spark):
    """Gaps that straddle a bucket, and empty buckets between calls."""
    t = datetime(2026, 1, 1, 0, 59, 59)
    offsets = [0, 0.1, 0.7, 1.1, 1.2, 9000, 9000.4]
    rows = [("s", "r", 1, 1, i, t + timedelta(seconds=o), 200, None) for i, o in enumerate(offsets)]
    rows += [("free", "r", 1, 1, 99, t, 200, None)] * 2
    limits = spark.createDataFrame([("s", 2), ("free", 0)], "source_id string, max_requests_per_second int")
    got = rate_audit(log(spark, rows).repartition(5), limits)
    assert rows_of(got, "request_id", "violation") == [
        (0, False), (1, True), (2, False), (3, True), (4, True), (5, False), (6, True)
    ]
    gaps = {r.request_id: r.gap_micros for r in got.collect()}
    assert gaps[3] == 400_000 and gaps[5] == 8_998_800_000 and gaps[0] is None
