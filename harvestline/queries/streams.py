"""The batch plan over a file stream of landed pages."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from harvestline.plans.staging import shared_folder
from harvestline.plans.store import Store
from harvestline.queries import inputs
from harvestline.queries.book import Book
from harvestline.sources.pages import decode_pages, explode_records, page_config, read_page_stream
from harvestline.streaming.ingest import dedup_stream, expire_runs, ingest_stream

BOOK = Book()
_ALL_FILES = 2**31 - 1


def _folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def _drain_part(spark: SparkSession, store: Store, zone: str, specs: DataFrame, state: str) -> None:
    """One micro-batch of all files that have landed since the last; the stream goes on from its checkpoint."""
    stream = read_page_stream(spark, zone, files_per_batch=_ALL_FILES)
    ingest_stream(store, stream, specs, state, now=datetime(2024, 2, 1), dedupe=False).awaitTermination()


@BOOK.add(
    "stream_incremental",
    f"""WITH {inputs.EVENTS_CTE}, last AS (SELECT source_id, max(run_id) AS last_run FROM ev GROUP BY source_id),
    first_half AS (SELECT e.source_id, max(seen_at) AS high FROM ev e JOIN last USING (source_id)
        WHERE run_id < last_run AND has_key GROUP BY e.source_id)
    SELECT e.source_id, e.run_id, CAST(count(*) FILTER (is_object AND (run_id < last_run
        OR NOT has_key OR high IS NULL OR seen_at > high)) AS BIGINT) AS rows_ingested,
      CAST(count(*) FILTER (is_object AND run_id = last_run AND has_key AND seen_at <= high) AS BIGINT)
        AS rows_skipped
    FROM ev e JOIN last USING (source_id) LEFT JOIN first_half h ON h.source_id = e.source_id
    GROUP BY e.source_id, e.run_id""",
)
def stream_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs but each source's last land first; the stream drains, more lands, it resumes.

    The second drain starts from the resume points the first one left.  A third
    finds nothing new and changes nothing.
    """
    pages = inputs.event_pages(spark, sf_dir)
    last = pages.groupBy("source_id").agg(F.max("run_id").alias("last_run"))
    marked = pages.join(last, "source_id")
    early = marked.where(F.col("run_id") < F.col("last_run")).drop("last_run")
    late = marked.where(F.col("run_id") == F.col("last_run")).drop("last_run")
    zone, state = _folder(spark, "zone"), _folder(spark, "progress")
    store = Store(spark, _folder(spark, "store"))
    specs = inputs.event_specs(spark, sf_dir)
    for batch in (early, late, None):
        if batch is not None:
            batch.write.mode("append").parquet(zone)
        stream = read_page_stream(spark, zone)
        ingest_stream(store, stream, specs, state, now=datetime(2024, 2, 1)).awaitTermination()
    return store.ledger().select("source_id", "run_id", "rows_ingested", "rows_skipped")


@BOOK.add(
    "stream_split_runs",
    f"""WITH {inputs.EVENTS_CTE}
    SELECT source_id, run_id, 'Succeeded' AS result, CAST(count(*) FILTER (is_object) AS BIGINT) AS rows_ingested,
      count(*) FILTER (is_object) AS rows_landed
    FROM ev GROUP BY source_id, run_id""",
)
def stream_split_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run's pages land in three parts, last ones first, one of them twice; a micro-batch takes one part."""
    pages = inputs.event_pages(spark, sf_dir)
    zone, state = _folder(spark, "zone"), _folder(spark, "progress")
    store = Store(spark, _folder(spark, "store"))
    specs = inputs.event_specs(spark, sf_dir, watermark="NULL")
    for part in (2, 1, 0, 1):
        pages.where(F.col("page_no") % 3 == part).write.mode("append").parquet(zone)
        _drain_part(spark, store, zone, specs, state)
    landed = store.read_ndjson().groupBy(F.col("_source_id").alias("source_id"), F.col("_run_id").alias("run_id"))
    return store.ledger().select("source_id", "run_id", "result", "rows_ingested").join(
        landed.agg(F.count("*").alias("rows_landed")), ["source_id", "run_id"]
    )


@BOOK.add(
    "stream_dedup",
    f"""WITH {inputs.EVENTS_CTE} SELECT source_id, count(DISTINCT record) AS records
    FROM ev GROUP BY source_id""",
)
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page lands twice; digests are remembered for the span of re-delivery."""
    pages = inputs.event_pages(spark, sf_dir)
    zone = _folder(spark, "zone")
    for _ in range(2):
        pages.write.mode("append").parquet(zone)
    config = page_config(inputs.event_specs(spark, sf_dir))
    stream = read_page_stream(spark, zone)
    decoded = decode_pages(stream, config)
    arrived = explode_records(decoded, keep=["requested_at"])
    once = dedup_stream(arrived, "requested_at", "60 days")
    out, state = _folder(spark, "rows"), _folder(spark, "progress")
    (
        once.select("source_id", "digest")
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return (
        spark.read.parquet(out)
        .groupBy("source_id")
        .agg(F.count("*").alias("records"))
    )


@BOOK.add(
    "stream_redelivered",
    f"""WITH {inputs.EVENTS_CTE} SELECT source_id, run_id, 'Succeeded' AS result, CAST(1 AS INTEGER) AS attempt,
      count(DISTINCT record) AS rows_landed
    FROM ev WHERE is_object GROUP BY source_id, run_id""",
)
def stream_redelivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page lands once, the stream drains and stops, and after its restart every page lands again.

    What comes again is known from the state in the checkpoint, so no batch sees
    it and no run is tried twice.
    """
    pages = inputs.event_pages(spark, sf_dir)
    zone, state = _folder(spark, "zone"), _folder(spark, "progress")
    store = Store(spark, _folder(spark, "store"))
    specs = inputs.event_specs(spark, sf_dir, watermark="NULL")
    for _ in range(2):
        pages.write.mode("append").parquet(zone)
        stream = read_page_stream(spark, zone)
        ingest_stream(
            store, stream, specs, state, now=datetime(2024, 2, 1), redelivery="30 days", snapshot_every=1
        ).awaitTermination()
    landed = store.read_ndjson().groupBy(F.col("_source_id").alias("source_id"), F.col("_run_id").alias("run_id"))
    return store.ledger().select("source_id", "run_id", "result", "attempt").join(
        landed.agg(F.count("*").alias("rows_landed")), ["source_id", "run_id"]
    )


@BOOK.add(
    "stream_open_runs",
    f"""WITH {inputs.EVENTS_CTE}, last AS (SELECT source_id, run_id, max(page_no) AS pages FROM ev GROUP BY ALL),
    fate AS (SELECT *, CASE WHEN source_id = 'view' AND pages > 1 THEN 'Failed' ELSE 'Succeeded' END AS result FROM last)
    SELECT f.source_id, f.run_id, f.result,
      CASE WHEN f.result = 'Failed'
        THEN 'gave up waiting for pages: landed pages end before the result set does' END AS error,
      CAST(CASE WHEN f.result = 'Failed' THEN 0 ELSE count(*) FILTER (is_object) END AS BIGINT) AS rows_ingested,
      CAST(0 AS BIGINT) AS pages_kept
    FROM ev e JOIN fate f ON f.source_id = e.source_id AND f.run_id = e.run_id
    GROUP BY f.source_id, f.run_id, f.result""",
)
def stream_open_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages arrive over five micro-batches; one source's last pages never do, and its runs expire.

    Kept pages are written once an epoch and none is left when all runs are over.
    """
    pages = inputs.event_pages(spark, sf_dir)
    zone, state = _folder(spark, "zone"), _folder(spark, "progress")
    store = Store(spark, _folder(spark, "store"))
    specs = inputs.event_specs(spark, sf_dir, watermark="NULL")
    last = pages.groupBy("source_id", "run_id").agg(F.max("page_no").alias("pages"))
    marked = pages.join(last, ["source_id", "run_id"])
    comes = marked.where((F.col("source_id") != "view") | (F.col("page_no") < F.col("pages")) | (F.col("pages") == 1))
    comes = comes.drop("pages")
    for part in range(5):
        comes.where(F.col("page_no") % 5 == part).write.mode("append").parquet(zone)
        _drain_part(spark, store, zone, specs, state)
    expire_runs(store, specs, datetime(2025, 1, 1), now=datetime(2025, 1, 2), batch_id="overdue")
    kept = store.open_pages().groupBy("source_id", "run_id").agg(F.count("*").alias("pages_kept"))
    return store.ledger().join(kept, ["source_id", "run_id"], "left").select(
        "source_id", "run_id", "result", "error", "rows_ingested", F.coalesce("pages_kept", F.lit(0)).alias("pages_kept")
    )
