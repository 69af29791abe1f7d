"""The given tables dressed up as landed pages, run ledgers and specs.

Everything is derived row by row from the whole tables; nothing is sampled.  The
text of a record is written once as SQL both engines read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from harvestline import model as m
from harvestline.plans.staging import stage

_STAGED: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged_once(spark: SparkSession, sf_dir: str, label: str, build, variant: str = "") -> DataFrame:
    """A derived input table, written once a session and scale."""
    key = (spark.sparkContext.applicationId, sf_dir, label + variant)
    if key not in _STAGED:
        _STAGED[key] = stage(build(), label)
    return _STAGED[key]


# --- records made of events ---------------------------------------------------------------

# Every event is one record; some are not objects, some lack or spoil a field.
_TAGS = (
    "CASE event_id % 5 WHEN 0 THEN '[]' WHEN 1 THEN '[\"a\"]' WHEN 2 THEN '[' || k || ']'"
    " WHEN 3 THEN '[null]' ELSE '[\"a\",' || k || ']' END"
)
RESUME_TEXT = (
    "CASE WHEN event_id % 103 = 0 THEN NULL WHEN event_id % 101 = 0 THEN 'not-a-timestamp'"
    " ELSE updated END"
)
RECORD_TEXT = f"""CASE WHEN event_id % 211 = 0 THEN '"e' || CAST(event_id AS STRING) || '"' ELSE
 '{{"amount":' || CASE WHEN event_id % 97 = 0 THEN '"' || CAST(cents AS STRING) || '"'
   ELSE CAST(cents AS STRING) END
 || CASE WHEN event_id % 13 = 0 THEN '' ELSE
   ',"email":"u' || CAST(user_id AS STRING) || '@example.invalid"' END
 || ',"id":' || CAST(event_id AS STRING) || ',"kind":"' || source_id || '"'
 || ',"meta":{{"k":' || k || ',"n":'
 || CASE WHEN event_id % 7 = 0 THEN 'null' ELSE CAST(user_id AS STRING) END || '}}'
 || ',"tags":' || {_TAGS}
 || CASE WHEN event_id % 103 = 0 THEN '' ELSE ',"updated_at":"' || ({RESUME_TEXT}) || '"' END
 || '}}' END"""

# DuckDB: the same records with the position each has in its page.
EVENTS_CTE = f"""ev0 AS (
  SELECT event_id, event_type AS source_id,
    'r' || lpad(CAST(event_id // 5000 AS STRING), 6, '0') AS run_id,
    CAST((event_id % 5000) // 250 + 1 AS INTEGER) AS page_no,
    user_id, ts, CAST(round(value * 100) AS BIGINT) AS cents,
    json_extract_string(props, '$.k') AS k,
    strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS updated,
    date_trunc('second', ts) AS seen_at
  FROM events),
ev AS (
  SELECT *, row_number() OVER (PARTITION BY source_id, run_id, page_no ORDER BY event_id) - 1
      AS record_pos,
    event_id % 211 <> 0 AS is_object,
    {RESUME_TEXT} AS resume_text,
    event_id % 211 <> 0 AND event_id % 103 <> 0 AS has_value,
    event_id % 211 <> 0 AND event_id % 103 <> 0 AND event_id % 101 <> 0 AS has_key,
    {RECORD_TEXT} AS record
  FROM ev0)"""


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the run and page they arrive on, and their record as text."""
    base = table(spark, sf_dir, "events").select(
        "event_id",
        F.col("event_type").alias("source_id"),
        F.concat(F.lit("r"), F.lpad(F.expr("event_id div 5000").cast("string"), 6, "0")).alias(
            "run_id"
        ),
        F.expr("(event_id % 5000) div 250 + 1").cast("int").alias("page_no"),
        "user_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
        F.get_json_object("props", "$.k").alias("k"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated"),
    )
    return base.withColumn("record", F.expr(RECORD_TEXT))


def event_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed cursor pages: 250 consecutive event ids a page, split by source, twenty pages a run."""

    def build() -> DataFrame:
        rows = event_records(spark, sf_dir)
        items = F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("event_id", "record"))), lambda x: x["record"]
            ),
            ",",
        )
        grouped = rows.groupBy("source_id", "run_id", "page_no").agg(
            items.alias("items"), F.min("ts").alias("requested_at")
        )
        run = Window.partitionBy("source_id", "run_id")
        cursor = F.when(
            F.col("page_no") < F.max("page_no").over(run),
            F.format_string('"next_cursor":"%d"', F.col("page_no")),
        )
        return grouped.select(
            "source_id",
            "run_id",
            "page_no",
            F.lit(1).alias("attempt"),
            "requested_at",
            F.lit(200).alias("status"),
            F.create_map(F.lit("Content-Type"), F.lit("application/json")).alias("headers"),
            F.when(F.col("page_no") > 1, (F.col("page_no") - 1).cast("string")).alias(
                "request_cursor"
            ),
            F.concat(
                F.lit('{"data":{"items":['),
                "items",
                F.lit(']},"meta":{'),
                F.coalesce(cursor, F.lit("")),
                F.lit("}}"),
            ).alias("body"),
        ).repartitionByRange(
            # A fetcher commits a run's pages together, so landed files are clustered by run.
            spark.sparkContext.defaultParallelism * 2,
            "source_id",
            "run_id",
            "page_no",
        ).sortWithinPartitions("source_id", "run_id", "page_no")

    return staged_once(spark, sf_dir, "event-pages", build)


def event_specs(spark: SparkSession, sf_dir: str, **overrides: str) -> DataFrame:
    """One spec for each event type found in the data, kept as a table like any spec list."""

    def build() -> DataFrame:
        ids = (
            table(spark, sf_dir, "events").select(F.col("event_type").alias("source_id")).distinct()
        )
        values = {**_EVENT_SPEC, **overrides}
        return shaped(
            ids.select("source_id", *[F.expr(v).alias(k) for k, v in values.items()]), m.SPECS
        )

    return staged_once(spark, sf_dir, "event-specs", build, repr(sorted(overrides.items())))


_EVENT_SPEC = {
    "schedule": "'0 * * * *'",
    "suspend": "false",
    "concurrency": "NULL",
    "source": "named_struct('url', concat('https://vendor.invalid/', source_id), 'records_path',"
    " 'data.items', 'pagination', named_struct('type', 'Cursor', 'next_cursor_path',"
    " 'meta.next_cursor', 'cursor_param', 'cursor'))",
    "watermark": "named_struct('record_field', 'updated_at', 'param', 'since', 'format', 'RFC3339')",
    "destination": "NULL",
    "drift": "NULL",
    "suspend_after": "NULL",
    "backoff_limit": "NULL",
    "successful_history": "NULL",
    "failed_history": "NULL",
}


def shaped(df: DataFrame, schema) -> DataFrame:
    """Give a frame a contract's columns and types, absent struct fields as NULL."""
    return df.select(*[_fit(F.col(f.name), df.schema[f.name].dataType, f.dataType).alias(f.name) for f in schema.fields])


def _fit(column, have, want):
    from pyspark.sql import types as T

    if isinstance(want, T.StructType) and isinstance(have, T.StructType):
        inner = [
            (
                _fit(column[f.name], have[f.name].dataType, f.dataType)
                if f.name in have.names
                else F.lit(None).cast(f.dataType)
            ).alias(f.name)
            for f in want.fields
        ]
        return F.when(column.isNotNull(), F.struct(*inner))
    return column.cast(want)


# --- pages made of orders -----------------------------------------------------------------

ORDER_PAGES_CTE = """op AS (
  SELECT 's' || lpad(CAST(o_custkey % 25 AS STRING), 2, '0') AS source_id,
    'w' || lpad(CAST(o_orderkey // 10000 AS STRING), 6, '0') AS run_id,
    CAST((o_orderkey % 10000) // 500 + 1 AS INTEGER) AS page_no,
    CAST((o_custkey % 25 + o_orderkey // 10000) % 5 AS INTEGER) AS kind,
    count(*) AS n
  FROM orders GROUP BY ALL)"""


def order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed pages of 500 consecutive order keys split by source; ``kind`` varies by run."""

    def build() -> DataFrame:
        rows = table(spark, sf_dir, "orders").select(
            F.concat(F.lit("s"), F.lpad(F.expr("o_custkey % 25").cast("string"), 2, "0")).alias(
                "source_id"
            ),
            F.concat(
                F.lit("w"), F.lpad(F.expr("o_orderkey div 10000").cast("string"), 6, "0")
            ).alias("run_id"),
            F.expr("(o_orderkey % 10000) div 500 + 1").cast("int").alias("page_no"),
            F.expr("(o_custkey % 25 + o_orderkey div 10000) % 5").cast("int").alias("kind"),
            F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state")).alias(
                "item"
            ),
        )
        grouped = rows.groupBy("source_id", "run_id", "page_no", "kind").agg(
            F.to_json(F.array_sort(F.collect_list("item"))).alias("items")
        )
        return grouped

    return staged_once(spark, sf_dir, "order-pages", build)


def as_landed(
    grouped: DataFrame, body, link=None, cursor=None, status=None
) -> DataFrame:
    """Page columns around a body built from ``order_pages``."""
    headers = F.create_map(F.lit("Link"), link) if link is not None else F.create_map()
    return grouped.select(
        "source_id",
        "run_id",
        "page_no",
        F.lit(1).alias("attempt"),
        F.lit(None).cast("timestamp").alias("requested_at"),
        (F.lit(200) if status is None else status).alias("status"),
        headers.cast("map<string,string>").alias("headers"),
        (F.lit(None) if cursor is None else cursor).cast("string").alias("request_cursor"),
        body.alias("body"),
    )


def order_sources(pages: DataFrame, **settings) -> DataFrame:
    """Page settings shared by all order sources; same columns as ``page_config`` gives."""
    defaults = {
        "records_path": "items",
        "pagination_type": "None",
        "next_cursor_path": None,
        "page_size": 0,
        "max_pages": 1000,
        **settings,
    }
    types = {"page_size": "int", "max_pages": "int"}
    return pages.select("source_id").distinct().select(
        "source_id",
        *[F.lit(v).cast(types.get(k, "string")).alias(k) for k, v in defaults.items()],
    )


# --- a run ledger made of orders ----------------------------------------------------------

LEDGER_CTE = """lg AS (
  SELECT 's' || lpad(CAST(o_custkey % 25 AS STRING), 2, '0') AS source_id,
    'r' || lpad(CAST(o_orderkey AS STRING), 9, '0') AS run_id,
    o_orderkey AS n,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'backfill' WHEN '2-HIGH' THEN 'trigger'
      ELSE 'scheduled' END AS kind,
    CASE WHEN o_orderpriority = '1-URGENT'
      THEN 'b' || CAST(o_orderkey % 50 AS STRING) END AS backfill_id,
    o_orderdate AS created_at,
    o_orderdate + to_seconds(o_orderkey % 60) AS started_at,
    CASE WHEN o_orderstatus <> 'F' AND NOT (o_orderstatus = 'P' AND o_orderkey % 50 = 0)
      THEN o_orderdate + to_seconds(o_orderkey % 60 + o_orderkey * 37 % 9000) END AS completed_at,
    CASE WHEN o_orderstatus = 'F' THEN 'Failed'
      WHEN o_orderstatus = 'P' AND o_orderkey % 50 = 0 THEN 'Running'
      ELSE 'Succeeded' END AS result,
    o_orderkey % 1000 AS rows_ingested,
    o_orderkey % 7 AS rows_rejected,
    o_orderkey % 20 + 1 AS request_count,
    CASE WHEN o_orderkey % 3 <> 0 AND o_orderpriority <> '1-URGENT'
      THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END AS watermark,
    CASE WHEN o_orderkey % 9 <> 0 THEN 'fp' || CAST(o_orderkey // 7 % 4 AS STRING) END
      AS schema_fingerprint,
    CASE WHEN o_orderkey % 10 = 0 THEN 'tenant' END AS added,
    CASE WHEN o_orderkey % 30 = 0 THEN 'email' END AS removed,
    CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 'upstream returned 500' END AS error
  FROM orders),
runs AS (
  SELECT *, coalesce(completed_at, started_at, created_at) AS run_time,
    CASE WHEN error IS NOT NULL THEN error
      WHEN added IS NOT NULL THEN 'record shape changed: added tenant'
        || CASE WHEN removed IS NOT NULL THEN '; removed email' ELSE '' END
      WHEN result = 'Failed' THEN 'run did not complete' END AS message
  FROM lg)"""


def order_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as one finished, failed or running run of one of 25 sources."""
    from harvestline.operators.ledger import failure_message

    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    at = F.col("o_orderdate").cast("timestamp")
    plus = lambda seconds: F.timestamp_micros(F.unix_micros(at) + seconds * 1_000_000)
    running = (F.col("o_orderstatus") == "P") & (key % 50 == 0)
    failed = F.col("o_orderstatus") == "F"
    one = lambda cond, name: F.when(cond, F.array(F.lit(name))).otherwise(
        F.array().cast("array<string>")
    )
    change = F.when(
        key % 10 == 0,
        F.struct(
            one(key % 10 == 0, "tenant").alias("added"),
            one(key % 30 == 0, "email").alias("removed"),
            F.array().cast("array<string>").alias("changed"),
        ),
    )
    nothing = F.lit(None).cast("string")
    error = F.when(failed & (key % 2 == 0), "upstream returned 500")
    rows = o.select(
        F.concat(F.lit("s"), F.lpad(F.expr("o_custkey % 25").cast("string"), 2, "0")).alias(
            "source_id"
        ),
        F.concat(F.lit("r"), F.lpad(key.cast("string"), 9, "0")).alias("run_id"),
        F.lit(1).alias("attempt"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "backfill")
        .when(F.col("o_orderpriority") == "2-HIGH", "trigger")
        .otherwise("scheduled")
        .alias("kind"),
        F.when(
            F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("b"), (key % 50).cast("string"))
        ).alias("backfill_id"),
        at.alias("created_at"),
        plus(key % 60).alias("started_at"),
        F.when(~failed & ~running, plus(key % 60 + key * 37 % 9000)).alias("completed_at"),
        F.when(failed, "Failed").when(running, "Running").otherwise("Succeeded").alias("result"),
        (key % 1000).alias("rows_ingested"),
        (key % 7).alias("rows_rejected"),
        F.lit(0).cast("bigint").alias("rows_skipped"),
        (key % 20 + 1).alias("request_count"),
        F.when(
            (key % 3 != 0) & (F.col("o_orderpriority") != "1-URGENT"),
            F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        ).alias("watermark"),
        F.when(
            key % 9 != 0, F.concat(F.lit("fp"), F.expr("o_orderkey div 7 % 4").cast("string"))
        ).alias("schema_fingerprint"),
        change.alias("schema_change"),
        error.alias("error"),
    )
    return rows.withColumn(
        "message",
        failure_message(
            F.col("error"), F.col("schema_change"), nothing, nothing, F.col("result") == "Failed"
        ),
    )


def ledger_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spec for each customer-derived source id except the last one, which was deleted."""
    ids = (
        table(spark, sf_dir, "customer")
        .select(F.expr("c_custkey % 25").cast("int").alias("i"))
        .distinct()
        .where(F.col("i") < 24)
    )
    return shaped(
        ids.select(
            F.concat(F.lit("s"), F.lpad(F.col("i").cast("string"), 2, "0")).alias("source_id"),
            F.lit("0 * * * *").alias("schedule"),
            (F.col("i") % 6 == 5).alias("suspend"),
            F.lit(None).alias("concurrency"),
            F.expr("named_struct('url', 'https://vendor.invalid/x')").alias("source"),
            F.expr(
                "named_struct('record_field', 'updated_at', 'param', 'since', 'format',"
                " CASE WHEN i % 8 = 7 THEN 'Opaque' ELSE 'RFC3339' END)"
            ).alias("watermark"),
            F.expr("named_struct('type', 'Stdout')").alias("destination"),
            F.lit(None).alias("drift"),
            F.expr("i % 4").cast("int").alias("suspend_after"),
            F.lit(None).alias("backoff_limit"),
            F.lit(None).alias("successful_history"),
            F.lit(None).alias("failed_history"),
        ),
        m.SPECS,
    )


LEDGER_SPECS_CTE = """sp AS (
  SELECT DISTINCT 's' || lpad(CAST(c_custkey % 25 AS STRING), 2, '0') AS source_id,
    c_custkey % 25 % 6 = 5 AS suspend, c_custkey % 25 % 4 AS suspend_after,
    CASE WHEN c_custkey % 25 % 8 = 7 THEN 'Opaque' ELSE 'RFC3339' END AS format
  FROM customer WHERE c_custkey % 25 < 24)"""
