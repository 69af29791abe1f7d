"""Source specs with defaults, their violations and their digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from harvestline import model as m
from harvestline.functions.text import short_digest


def _or_default(value: Column, default: str) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def with_defaults(specs: DataFrame) -> DataFrame:
    """Fill in what a spec left out."""
    src, page = F.col("source"), F.col("source.pagination")
    pagination = F.struct(
        _or_default(page["type"], m.DEFAULT_PAGINATION).alias("type"),
        page["next_cursor_path"].alias("next_cursor_path"),
        page["cursor_param"].alias("cursor_param"),
        page["page_param"].alias("page_param"),
        page["size_param"].alias("size_param"),
        F.when(page.isNotNull(), F.coalesce(page["page_size"], F.lit(m.DEFAULT_PAGE_SIZE))).alias(
            "page_size"
        ),
        F.coalesce(page["start_page"], F.lit(0)).alias("start_page"),
        F.coalesce(page["max_pages"], F.lit(m.DEFAULT_MAX_PAGES)).alias("max_pages"),
    )
    source = F.when(
        src.isNotNull(),
        F.struct(
            _or_default(src["type"], "HTTP").alias("type"),
            src["url"].alias("url"),
            _or_default(src["method"], m.DEFAULT_METHOD).alias("method"),
            src["headers"].alias("headers"),
            src["body"].alias("body"),
            _or_default(src["auth_type"], m.DEFAULT_AUTH).alias("auth_type"),
            src["auth_header_name"].alias("auth_header_name"),
            src["records_path"].alias("records_path"),
            pagination.alias("pagination"),
            src["query"].alias("query"),
            F.coalesce(src["timeout_seconds"], F.lit(m.DEFAULT_TIMEOUT_SECONDS)).alias(
                "timeout_seconds"
            ),
            F.coalesce(src["max_requests_per_second"], F.lit(0)).alias("max_requests_per_second"),
        ),
    )
    wm = F.col("watermark")
    resume = F.when(
        wm.isNotNull(), wm.withField("format", _or_default(wm["format"], m.DEFAULT_RESUME_FORMAT))
    )
    dst = F.col("destination")
    filled = F.struct(
        _or_default(dst["type"], m.DEFAULT_DESTINATION).alias("type"),
        dst["project"].alias("project"),
        dst["dataset"].alias("dataset"),
        dst["table"].alias("table"),
        dst["location"].alias("location"),
        _or_default(dst["write_disposition"], m.DEFAULT_WRITE_DISPOSITION).alias(
            "write_disposition"
        ),
        F.coalesce(dst["create_if_missing"], F.lit(m.DEFAULT_CREATE_IF_MISSING)).alias(
            "create_if_missing"
        ),
        dst["dead_letter_table"].alias("dead_letter_table"),
    )
    return specs.select(
        "source_id",
        "schedule",
        F.coalesce("suspend", F.lit(False)).alias("suspend"),
        _or_default(F.col("concurrency"), m.DEFAULT_CONCURRENCY).alias("concurrency"),
        source.alias("source"),
        resume.alias("watermark"),
        filled.alias("destination"),
        _or_default(F.col("drift"), m.DEFAULT_DRIFT).alias("drift"),
        F.coalesce("suspend_after", F.lit(m.DEFAULT_SUSPEND_AFTER)).alias("suspend_after"),
        F.coalesce("backoff_limit", F.lit(m.DEFAULT_BACKOFF_LIMIT)).alias("backoff_limit"),
        F.coalesce("successful_history", F.lit(m.DEFAULT_HISTORY_LIMIT)).alias(
            "successful_history"
        ),
        F.coalesce("failed_history", F.lit(m.DEFAULT_HISTORY_LIMIT)).alias("failed_history"),
    )


def with_violations(specs: DataFrame) -> DataFrame:
    """Add ``violations``, sorted; run it on specs with defaults filled in."""
    src, page = F.col("source"), F.col("source.pagination")
    wm, dst = F.col("watermark"), F.col("destination")
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    outside = lambda c, domain: ~F.coalesce(c.isin(*domain), F.lit(False))
    below = lambda c, least: F.coalesce(c < least, F.lit(False))
    http = src["type"] == "HTTP"
    has_http = src["url"].isNotNull()
    table = dst["type"] == "BigQuery"
    has_table = dst["project"].isNotNull() | dst["dataset"].isNotNull() | dst["table"].isNotNull()
    rules = {
        "schedule: required": blank(F.col("schedule")),
        "concurrency: unknown": outside(F.col("concurrency"), m.CONCURRENCY_POLICIES),
        "source: required": src.isNull(),
        "source.type: unknown": src.isNotNull() & ~F.coalesce(http, F.lit(False)),
        "source: http must be set when type is HTTP": http & ~has_http,
        "source.url: must start with http:// or https://": has_http
        & ~src["url"].rlike("^https?://"),
        "source.method: unknown": src.isNotNull() & outside(src["method"], m.METHODS),
        "source.headers: name required": F.exists(
            src["headers"], lambda h: F.coalesce(h["name"], F.lit("")) == ""
        ),
        "source.auth_type: unknown": src.isNotNull() & outside(src["auth_type"], m.AUTH_TYPES),
        "source.max_requests_per_second: below 0": below(src["max_requests_per_second"], 0),
        "pagination.type: unknown": src.isNotNull() & outside(page["type"], m.PAGINATION_TYPES),
        "pagination.page_size: below 1": below(page["page_size"], 1),
        "pagination.start_page: below 0": below(page["start_page"], 0),
        "pagination.max_pages: below 1": below(page["max_pages"], 1),
        "watermark.record_field: required": wm.isNotNull() & blank(wm["record_field"]),
        "watermark.param: required": wm.isNotNull() & blank(wm["param"]),
        "watermark.format: unknown": wm.isNotNull() & outside(wm["format"], m.RESUME_FORMATS),
        "destination.type: unknown": outside(dst["type"], m.DESTINATION_TYPES),
        "destination: bigQuery must be set when type is BigQuery": table & ~has_table,
        "destination.project: required": table & has_table & blank(dst["project"]),
        "destination.dataset: required": table & has_table & blank(dst["dataset"]),
        "destination.table: required": table & has_table & blank(dst["table"]),
        "destination.write_disposition: unknown": outside(
            dst["write_disposition"], m.WRITE_DISPOSITIONS
        ),
        "drift: unknown": outside(F.col("drift"), m.DRIFT_POLICIES),
        "suspend_after: below 0": below(F.col("suspend_after"), 0),
        "backoff_limit: below 0": below(F.col("backoff_limit"), 0),
        "successful_history: below 0": below(F.col("successful_history"), 0),
        "failed_history: below 0": below(F.col("failed_history"), 0),
    }
    found = F.array(*[F.when(broken, F.lit(text)) for text, broken in rules.items()])
    return specs.withColumn("violations", F.sort_array(F.array_compact(found)))


def config_digest(specs: DataFrame) -> DataFrame:
    """Changes exactly when something a run reads changes."""
    # Map order is not fixed, so the query enters as sorted entries.
    source = F.col("source").withField("query", F.array_sort(F.map_entries("source.query")))
    text = F.to_json(F.struct(source.alias("source"), "watermark", "destination", "drift"))
    return specs.select("source_id", short_digest(text).alias("config_digest"))
