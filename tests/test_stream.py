"""Draining a landing zone more than once."""

from datetime import datetime

from conftest import day, page, spec
from harvestline.sources.pages import read_page_stream
from harvestline.streaming.ingest import ingest_stream


def test_drains_resumes_and_replays(spark, store, pages_df, specs_df, tmp_path):
    zone, state = str(tmp_path / "zone"), str(tmp_path / "state")
    specs = specs_df()

    def drain(checkpoint=state):
        stream = read_page_stream(spark, zone)
        ingest_stream(store, stream, specs, checkpoint, now=datetime(2026, 2, 1)).awaitTermination()
        return {r.run_id: (r.rows_ingested, r.rows_skipped) for r in store.ledger().collect()}

    records = [{"id": i, "updated_at": day(i)} for i in (1, 2, 3, 4)]
    pages_df(page(records[:2])).coalesce(1).write.mode("append").parquet(zone)
    assert drain() == {"r1": (2, 0)}
    pages_df(page(records[1:], run="r2")).coalesce(1).write.mode("append").parquet(zone)
    want = {"r1": (2, 0), "r2": (2, 1)}
    assert drain() == want
    assert drain() == want
    # Progress lost while more lands: only what has not succeeded yet is run.
    pages_df(page(records[2:] + [{"id": 5, "updated_at": day(5)}], run="r3")).coalesce(1).write.mode("append").parquet(zone)
    assert drain(str(tmp_path / "fresh")) == {**want, "r3": (1, 2)}
    assert store.read_ndjson().count() == 5
    ids = [r[0] for r in store.ledger().select("batch_id").distinct().collect()]
    assert len(ids) == 3 and not any("None" in i for i in ids)


def test_a_run_may_arrive_in_pieces(store, pages_df, specs_df, tmp_path, spark):
    zone, state = str(tmp_path / "zone"), str(tmp_path / "state")
    specs = specs_df(spec(pagination={"type": "PageNumber", "page_size": 2}))

    def drain():
        stream = read_page_stream(spark, zone, files_per_batch=1)
        ingest_stream(store, stream, specs, state, now=datetime(2026, 2, 1)).awaitTermination()
        return {r.run_id: (r.result, r.rows_ingested, r.watermark) for r in store.ledger().collect()}

    records = [{"id": i, "updated_at": day(i)} for i in range(1, 6)]
    for part in (page(records[2:4], no=2), page(records[:2], no=1), page(records[:2], no=1)):
        pages_df(part).coalesce(1).write.mode("append").parquet(zone)
    assert drain() == {"r1": ("Running", 0, None)}
    assert store.resume_points().where("watermark IS NOT NULL").isEmpty()
    pages_df(page(records[4:], no=3)).coalesce(1).write.mode("append").parquet(zone)
    assert drain() == {"r1": ("Succeeded", 5, day(5))}
    assert store.read_ndjson().count() == 5
    assert drain() == {"r1": ("Succeeded", 5, day(5))}
