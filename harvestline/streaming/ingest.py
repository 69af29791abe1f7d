"""The same batch plan over newly landed pages.

A run's pages may arrive over any number of micro-batches.  A run whose pages
don't reach the end of its result set yet is recorded as ``Running``, and the
epoch's pages of it are added to the open pages; it lands when the rest has come.
A page is kept once, however many epochs its run stays open.  What an epoch reads
is its own files and the kept pages of the runs that these belong to, however old
the zone is and however many other runs wait.  Pages of runs that are over are
deleted after the commit that ended them.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from harvestline.functions.text import canonical_json, digest
from harvestline.plans.run import run_batch
from harvestline.plans.staging import Staging
from harvestline.plans.store import Store
from harvestline.sources.pages import page_key

RUN = ["source_id", "run_id"]
# Keyed state lives on the executors' disks, with its changes in the checkpoint.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def ingest_stream(
    store: Store,
    pages: DataFrame,
    specs: DataFrame,
    checkpoint: str,
    requests: DataFrame | None = None,
    *,
    name: str = "ingest",
    now: datetime | None = None,
    dedupe: bool | str = True,
    redelivery: str | None = None,
    expire_after: timedelta | None = None,
    snapshot_every: int | None = None,
) -> StreamingQuery:
    """Run every micro-batch of landed pages, then stop when there are none left.

    The batch id comes from the query's id, which lives in the checkpoint, and
    the epoch: a replayed epoch finds itself in the ledger, and one of a fresh
    checkpoint leaves out the runs that have succeeded.  Resume points and
    accepted shapes are read when an epoch starts.  With ``redelivery``, an
    interval, pages that come again within it are dropped before any batch sees
    them.  A run whose first request is older than ``expire_after`` and whose pages
    still don't end fails, with that reason.
    """

    def one_epoch(batch: DataFrame, epoch: int) -> None:
        at = now or datetime.now(timezone.utc)
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        batch_id = f"{name}-{query}-{epoch}"
        cutoff = None if expire_after is None else at - expire_after
        keep = Staging(batch.sparkSession, f"epoch-{batch_id}")
        try:
            if redelivery is not None:
                # Each read of a batch that comes out of the state store would go through all of the state again.
                batch = keep(batch, "pages")
            concerned = batch.select(*RUN).distinct()
            if cutoff is not None:
                concerned = concerned.unionByName(_overdue(store, cutoff)).distinct()
            concerned = keep(concerned, "concerned")
            if concerned.isEmpty():
                # An epoch that only moves the watermark of the state on.
                return
            every = batch.unionByName(store.open_pages(concerned))
            outcome = run_batch(
                store,
                every,
                specs,
                requests,
                batch_id=batch_id,
                now=at,
                dedupe=dedupe,
                hold_open=True,
                expire_before=cutoff,
                snapshot_every=snapshot_every,
            )
            still = outcome.where(F.col("result") == "Running").select(*RUN)
            store.keep_pages(batch.join(still, RUN, "left_semi"), batch_id)
            store.forget_pages()
        finally:
            keep.clear()

    if redelivery is not None:
        pages = once_delivered(pages, redelivery)
    return (
        pages.writeStream.queryName(name)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(one_epoch)
        .start()
    )


def _overdue(store: Store, cutoff: datetime) -> DataFrame:
    return store.open_runs().where(F.col("started_at") < F.lit(cutoff)).select(*RUN)


def expire_runs(
    store: Store, specs: DataFrame, cutoff: datetime, *, now: datetime, batch_id: str, dedupe: bool | str = True
) -> DataFrame:
    """Judge the open runs first requested before ``cutoff`` by the pages they have; returns their ledger rows.

    For sources that have stopped altogether, whose runs no epoch would meet again.
    """
    overdue = store.open_pages(_overdue(store, cutoff))
    outcome = run_batch(
        store, overdue, specs, batch_id=batch_id, now=now, dedupe=dedupe, hold_open=True, expire_before=cutoff
    )
    store.forget_pages()
    return outcome


def once_delivered(pages: DataFrame, within: str) -> DataFrame:
    """A stream of pages without those that arrived before in ``within``.

    The same page is the same answer to the same attempt at the same request of a
    run.  Time is that of arrival, so that no page is ever late; keys are kept in
    the state store until the interval has passed.
    """
    for key, value in STATE_STORE.items():
        pages.sparkSession.conf.set(key, value)
    answer = F.sha2(F.concat_ws("|", F.coalesce(F.col("status").cast("string"), F.lit("-")), F.coalesce("body", F.lit(""))), 256)
    columns = pages.columns
    marked = pages.withColumns(
        {"arrived_at": F.current_timestamp(), "page_key": page_key(), "answer": answer, "tried": F.coalesce("attempt", F.lit(0))}
    )
    return (
        marked.withWatermark("arrived_at", within)
        .dropDuplicatesWithinWatermark([*RUN, "page_key", "tried", "answer"])
        .select(*columns)
    )


def dedup_stream(records: DataFrame, event_time: str, lateness: str) -> DataFrame:
    """Drop re-delivered records of a stream, remembering digests for ``lateness`` only."""
    marked = records.withColumn("digest", digest(canonical_json(F.col("record"))))
    return marked.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(
        ["source_id", "digest"]
    )
