"""Source specs: defaults, violations, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from harvestline.model import FINGERPRINT_HEX, SPECS
from harvestline.operators import specs as sp
from harvestline.queries import inputs
from harvestline.queries.book import Book

BOOK = Book()

# Each customer is one spec; the remainder of its key decides what is left out or wrong.
_ID = "'c' || lpad(CAST(c_custkey AS STRING), 7, '0')"


def _specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    text = lambda c: F.lit(c)
    source = F.struct(
        F.when(n % 10 != 3, F.concat(F.when(n % 12 == 5, "ftp").otherwise("https"), F.lit("://v.invalid/"), n.cast("string"))).alias("url"),
        F.when(n % 5 == 0, text("POST")).when(n % 13 == 0, text("PUT")).otherwise("").alias("method"),
        F.struct(
            F.when(n % 4 == 0, text("Cursor")).when(n % 17 == 0, text("Spiral")).otherwise("").alias("type"),
            F.when(n % 6 == 0, 0).when(n % 6 == 1, 25).cast("int").alias("page_size"),
            F.when(n % 9 == 0, -1).cast("int").alias("start_page"),
            F.when(n % 8 == 0, 7).cast("int").alias("max_pages"),
        ).alias("pagination"),
        F.when(n % 2 == 0, F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), n.cast("string"))).alias(
            "query"
        ),
    )
    resume = F.when(
        n % 3 != 0,
        F.struct(
            F.when(n % 14 == 1, "").otherwise("at").alias("record_field"),
            F.lit("since").alias("param"),
            F.when(n % 3 == 1, "UnixSeconds").otherwise("").alias("format"),
        ),
    )
    table = F.struct(
        F.when(n % 7 < 2, "BigQuery").otherwise("").alias("type"),
        F.when((n % 7 == 0) & (n % 11 != 0), "p").alias("project"),
        F.when(n % 7 == 0, "d").alias("dataset"),
        F.when(n % 7 == 0, "t").alias("table"),
        F.when(n % 7 == 0, "Truncate").alias("write_disposition"),
    )
    rows = inputs.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), F.lpad(n.cast("string"), 7, "0")).alias("source_id"),
        F.when(n % 19 == 0, "").otherwise("0 2 * * *").alias("schedule"),
        F.lit(None).alias("suspend"),
        F.lit(None).alias("concurrency"),
        source.alias("source"),
        resume.alias("watermark"),
        table.alias("destination"),
        F.when(n % 21 == 0, "Shrug").when(n % 2 == 1, "Fail").otherwise("").alias("drift"),
        F.when(n % 16 == 0, -1).when(n % 16 == 1, 3).alias("suspend_after"),
        F.lit(None).alias("backoff_limit"),
        F.lit(None).alias("successful_history"),
        F.lit(None).alias("failed_history"),
    )
    return inputs.shaped(rows, SPECS)


@BOOK.add(
    "spec_defaults",
    f"""SELECT {_ID} AS source_id, false AS suspend, 'Forbid' AS concurrency, 'HTTP' AS source_type,
      CASE WHEN c_custkey % 5 = 0 THEN 'POST' WHEN c_custkey % 13 = 0 THEN 'PUT' ELSE 'GET' END
        AS method, 'None' AS auth_type,
      CASE WHEN c_custkey % 4 = 0 THEN 'Cursor' WHEN c_custkey % 17 = 0 THEN 'Spiral' ELSE 'None' END
        AS pagination_type,
      CAST(CASE c_custkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 25 ELSE 100 END AS INTEGER) AS page_size,
      CAST(CASE WHEN c_custkey % 9 = 0 THEN -1 ELSE 0 END AS INTEGER) AS start_page,
      CAST(CASE WHEN c_custkey % 8 = 0 THEN 7 ELSE 1000 END AS INTEGER) AS max_pages,
      CAST(30 AS INTEGER) AS timeout_seconds,
      CASE c_custkey % 3 WHEN 1 THEN 'UnixSeconds' WHEN 2 THEN 'RFC3339' END AS resume_format,
      CASE WHEN c_custkey % 7 < 2 THEN 'BigQuery' ELSE 'Stdout' END AS destination_type,
      CASE WHEN c_custkey % 7 = 0 THEN 'Truncate' ELSE 'Append' END AS write_disposition,
      true AS create_if_missing,
      CASE WHEN c_custkey % 21 = 0 THEN 'Shrug' WHEN c_custkey % 2 = 1 THEN 'Fail' ELSE 'Warn' END
        AS drift,
      CAST(CASE c_custkey % 16 WHEN 0 THEN -1 WHEN 1 THEN 3 ELSE 5 END AS INTEGER) AS suspend_after,
      CAST(3 AS INTEGER) AS backoff_limit
    FROM customer""",
)
def spec_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    page, src, dst = F.col("source.pagination"), F.col("source"), F.col("destination")
    return sp.with_defaults(_specs(spark, sf_dir)).select(
        "source_id",
        "suspend",
        "concurrency",
        src["type"].alias("source_type"),
        src["method"].alias("method"),
        src["auth_type"].alias("auth_type"),
        page["type"].alias("pagination_type"),
        page["page_size"].alias("page_size"),
        page["start_page"].alias("start_page"),
        page["max_pages"].alias("max_pages"),
        src["timeout_seconds"].alias("timeout_seconds"),
        F.col("watermark.format").alias("resume_format"),
        dst["type"].alias("destination_type"),
        dst["write_disposition"].alias("write_disposition"),
        dst["create_if_missing"].alias("create_if_missing"),
        "drift",
        "suspend_after",
        "backoff_limit",
    )


@BOOK.add(
    "spec_violations",
    f"""WITH v AS (SELECT {_ID} AS source_id, c_custkey AS n FROM customer)
    SELECT source_id, array_to_string(list_sort([r FOR r IN [
      CASE WHEN n % 19 = 0 THEN 'schedule: required' END,
      CASE WHEN n % 10 = 3 THEN 'source: http must be set when type is HTTP' END,
      CASE WHEN n % 12 = 5 AND n % 10 <> 3 THEN 'source.url: must start with http:// or https://' END,
      CASE WHEN n % 13 = 0 AND n % 5 <> 0 THEN 'source.method: unknown' END,
      CASE WHEN n % 17 = 0 AND n % 4 <> 0 THEN 'pagination.type: unknown' END,
      CASE WHEN n % 6 = 0 THEN 'pagination.page_size: below 1' END,
      CASE WHEN n % 9 = 0 THEN 'pagination.start_page: below 0' END,
      CASE WHEN n % 14 = 1 AND n % 3 <> 0 THEN 'watermark.record_field: required' END,
      CASE WHEN n % 7 = 1 THEN 'destination: bigQuery must be set when type is BigQuery' END,
      CASE WHEN n % 77 = 0 THEN 'destination.project: required' END,
      CASE WHEN n % 21 = 0 THEN 'drift: unknown' END,
      CASE WHEN n % 16 = 0 THEN 'suspend_after: below 0' END] IF r IS NOT NULL]), '; ') AS violations
    FROM v""",
)
def spec_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = sp.with_violations(sp.with_defaults(_specs(spark, sf_dir)))
    return checked.select("source_id", F.array_join("violations", "; ").alias("violations"))


@BOOK.add(
    "config_digest",
    f"""WITH v AS (SELECT {_ID} AS source_id, c_custkey AS n FROM customer), parts AS (
      SELECT source_id,
        CASE WHEN n % 10 <> 3 THEN '"url":"' || CASE WHEN n % 12 = 5 THEN 'ftp' ELSE 'https' END || '://v.invalid/' || n || '",'
          ELSE '' END AS url,
        CASE WHEN n % 5 = 0 THEN 'POST' WHEN n % 13 = 0 THEN 'PUT' ELSE 'GET' END AS method,
        CASE WHEN n % 4 = 0 THEN 'Cursor' WHEN n % 17 = 0 THEN 'Spiral' ELSE 'None' END AS walk,
        CASE WHEN n % 6 = 0 THEN 0 WHEN n % 6 = 1 THEN 25 ELSE 100 END AS page_size,
        CASE WHEN n % 9 = 0 THEN -1 ELSE 0 END AS start_page,
        CASE WHEN n % 8 = 0 THEN 7 ELSE 1000 END AS max_pages,
        CASE WHEN n % 2 = 0 THEN '"query":[{{"key":"a","value":"' || n || '"}},{{"key":"b","value":"2"}}],' ELSE '' END AS query,
        CASE WHEN n % 3 <> 0 THEN '"watermark":{{"record_field":"' || CASE WHEN n % 14 = 1 THEN '' ELSE 'at' END
          || '","param":"since","format":"' || CASE WHEN n % 3 = 1 THEN 'UnixSeconds' ELSE 'RFC3339' END || '"}},'
          ELSE '' END AS watermark,
        CASE WHEN n % 7 < 2 THEN 'BigQuery' ELSE 'Stdout' END AS kind,
        CASE WHEN n % 7 = 0 AND n % 11 <> 0 THEN '"project":"p",' ELSE '' END
          || CASE WHEN n % 7 = 0 THEN '"dataset":"d","table":"t",' ELSE '' END AS place,
        CASE WHEN n % 7 = 0 THEN 'Truncate' ELSE 'Append' END AS disposition,
        CASE WHEN n % 21 = 0 THEN 'Shrug' WHEN n % 2 = 1 THEN 'Fail' ELSE 'Warn' END AS drift
      FROM v)
    SELECT source_id, substr(sha256(
        '{{"source":{{"type":"HTTP",' || url || '"method":"' || method || '","auth_type":"None","pagination":{{"type":"' || walk
        || '","page_size":' || page_size || ',"start_page":' || start_page || ',"max_pages":' || max_pages || '}},' || query
        || '"timeout_seconds":30,"max_requests_per_second":0}},' || watermark
        || '"destination":{{"type":"' || kind || '",' || place || '"write_disposition":"' || disposition
        || '","create_if_missing":true}},"drift":"' || drift || '"}}'), 1, {FINGERPRINT_HEX}) AS config_digest,
      true AS stable, true AS moved
    FROM parts""",
)
def config_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest is of one canonical text, ignores what a run does not read, and moves with what it does."""
    specs = sp.with_defaults(_specs(spark, sf_dir))
    plain = sp.config_digest(specs)
    rescheduled = sp.config_digest(
        specs.withColumn("schedule", F.lit("5 5 * * *")).withColumn("suspend_after", F.lit(9))
    ).select("source_id", F.col("config_digest").alias("same"))
    elsewhere = sp.config_digest(
        specs.withColumn("source", F.col("source").withField("url", F.lit("https://else.invalid")))
    ).select("source_id", F.col("config_digest").alias("other"))
    joined = plain.join(rescheduled, "source_id").join(elsewhere, "source_id")
    return joined.select(
        "source_id",
        "config_digest",
        (F.col("config_digest") == F.col("same")).alias("stable"),
        (F.col("config_digest") != F.col("other")).alias("moved"),
    )


@BOOK.add(
    "one_off_run_ids",
    f"""SELECT {_ID} AS source_id, {_ID} || '-backfill-'
      || substr(sha256('req ' || CAST(c_custkey AS STRING)), 1, 8) AS run_id FROM customer""",
)
def one_off_run_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harvestline.operators.status import one_off_run_id

    n = F.col("c_custkey")
    source = F.concat(F.lit("c"), F.lpad(n.cast("string"), 7, "0"))
    return inputs.table(spark, sf_dir, "customer").select(
        source.alias("source_id"),
        one_off_run_id(source, F.lit("backfill"), F.concat(F.lit("req "), n.cast("string"))).alias(
            "run_id"
        ),
    )
