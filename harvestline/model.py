"""Table schemas, enum domains and limits shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

# The domains, limits and defaults of the data contract.
AUTH_TYPES = ("None", "Bearer", "Header", "Basic")
PAGINATION_TYPES = ("None", "Cursor", "PageNumber", "Offset", "LinkHeader")
DESTINATION_TYPES = ("BigQuery", "Stdout")
DRIFT_POLICIES = ("Ignore", "Warn", "EvolveAdditive", "Fail")
RESUME_FORMATS = ("RFC3339", "UnixSeconds", "Opaque")
WRITE_DISPOSITIONS = ("Append", "Truncate")
METHODS = ("GET", "POST")
CONCURRENCY_POLICIES = ("Allow", "Forbid", "Replace")
PHASES = ("Pending", "Scheduled", "Running", "Suspended", "Degraded")
RUN_RESULTS = ("Running", "Succeeded", "Failed")
RUN_KINDS = ("scheduled", "backfill", "trigger")
OBSERVED_SCALARS = ("string", "number", "bool", "object", "null", "mixed", "unknown")

# A decoded document can hold no more than this.
MAX_RESPONSE_BYTES = 128 * 1024 * 1024
MAX_ATTEMPTS = 4
MAX_BACKOFF_SECONDS = 30
MAX_SHAPE_DEPTH = 8
FINGERPRINT_HEX = 16
ONE_OFF_ID_HEX = 8

DEFAULT_METHOD = "GET"
DEFAULT_AUTH = "None"
DEFAULT_PAGINATION = "None"
DEFAULT_PAGE_SIZE = 100
DEFAULT_MAX_PAGES = 1000
DEFAULT_TIMEOUT_SECONDS = 30
DEFAULT_DESTINATION = "Stdout"
DEFAULT_WRITE_DISPOSITION = "Append"
DEFAULT_CREATE_IF_MISSING = True
DEFAULT_DRIFT = "Warn"
DEFAULT_RESUME_FORMAT = "RFC3339"
DEFAULT_SUSPEND_AFTER = 5
DEFAULT_BACKOFF_LIMIT = 3
DEFAULT_CONCURRENCY = "Forbid"
DEFAULT_HISTORY_LIMIT = 3

DURATION_BUCKETS = (1, 5, 15, 30, 60, 300, 900, 1800, 3600, 7200)
# End of fixed values.

PAGES = T.StructType(
    [
        T.StructField("source_id", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("page_no", T.IntegerType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("requested_at", T.TimestampType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("request_cursor", T.StringType()),
        T.StructField("body", T.StringType()),
    ]
)

PAGINATION = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("next_cursor_path", T.StringType()),
        T.StructField("cursor_param", T.StringType()),
        T.StructField("page_param", T.StringType()),
        T.StructField("size_param", T.StringType()),
        T.StructField("page_size", T.IntegerType()),
        T.StructField("start_page", T.IntegerType()),
        T.StructField("max_pages", T.IntegerType()),
    ]
)

HEADER = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("from_secret", T.BooleanType()),
    ]
)

SOURCE = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("headers", T.ArrayType(HEADER)),
        T.StructField("body", T.StringType()),
        T.StructField("auth_type", T.StringType()),
        T.StructField("auth_header_name", T.StringType()),
        T.StructField("records_path", T.StringType()),
        T.StructField("pagination", PAGINATION),
        T.StructField("query", T.MapType(T.StringType(), T.StringType())),
        T.StructField("timeout_seconds", T.IntegerType()),
        T.StructField("max_requests_per_second", T.IntegerType()),
    ]
)

RESUME = T.StructType(
    [
        T.StructField("record_field", T.StringType()),
        T.StructField("param", T.StringType()),
        T.StructField("to_param", T.StringType()),
        T.StructField("format", T.StringType()),
        T.StructField("initial_value", T.StringType()),
    ]
)

DESTINATION = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("project", T.StringType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("table", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("write_disposition", T.StringType()),
        T.StructField("create_if_missing", T.BooleanType()),
        T.StructField("dead_letter_table", T.StringType()),
    ]
)

SPECS = T.StructType(
    [
        T.StructField("source_id", T.StringType()),
        T.StructField("schedule", T.StringType()),
        T.StructField("suspend", T.BooleanType()),
        T.StructField("concurrency", T.StringType()),
        T.StructField("source", SOURCE),
        T.StructField("watermark", RESUME),
        T.StructField("destination", DESTINATION),
        T.StructField("drift", T.StringType()),
        T.StructField("suspend_after", T.IntegerType()),
        T.StructField("backoff_limit", T.IntegerType()),
        T.StructField("successful_history", T.IntegerType()),
        T.StructField("failed_history", T.IntegerType()),
    ]
)

REQUESTS = T.StructType(
    [
        T.StructField("source_id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("request_id", T.StringType()),
        T.StructField("from_value", T.StringType()),
        T.StructField("to_value", T.StringType()),
    ]
)

SHAPE = T.StructType(
    [
        T.StructField("source_id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("type", T.StringType()),
    ]
)

SHAPE_CHANGE = T.StructType(
    [
        T.StructField("added", T.ArrayType(T.StringType())),
        T.StructField("removed", T.ArrayType(T.StringType())),
        T.StructField("changed", T.ArrayType(T.StringType())),
    ]
)

RUNS = T.StructType(
    [
        T.StructField("source_id", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("backfill_id", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("started_at", T.TimestampType()),
        T.StructField("completed_at", T.TimestampType()),
        T.StructField("result", T.StringType()),
        T.StructField("rows_ingested", T.LongType()),
        T.StructField("rows_rejected", T.LongType()),
        T.StructField("rows_skipped", T.LongType()),
        T.StructField("request_count", T.LongType()),
        T.StructField("watermark", T.StringType()),
        T.StructField("schema_fingerprint", T.StringType()),
        T.StructField("schema_change", SHAPE_CHANGE),
        T.StructField("error", T.StringType()),
        T.StructField("message", T.StringType()),
    ]
)

CONDITION = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("message", T.StringType()),
    ]
)

DEAD_LETTERS = T.StructType(
    [
        T.StructField("source_id", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("rejected_at", T.TimestampType(), False),
        T.StructField("reason", T.StringType()),
        T.StructField("payload", T.StringType()),
        T.StructField("digest", T.StringType()),
    ]
)

# Observed type -> landing column type.  Every type not listed lands as text.
LANDING_TYPES = {"string": "string", "number": "double", "bool": "boolean"}
# Observed type -> warehouse column name of that type, used in shape reports.
WAREHOUSE_TYPES = {"string": "STRING", "number": "FLOAT", "bool": "BOOLEAN"}
