"""What an epoch of a stream with state reads and does."""

from datetime import datetime

from conftest import day, page, spec
from harvestline.sources.pages import read_page_stream
from harvestline.streaming import ingest


def test_the_state_is_read_once_an_epoch_and_an_empty_epoch_runs_no_batch(
    spark, store, pages_df, specs_df, tmp_path, monkeypatch
):
    zone, state = str(tmp_path / "zone"), str(tmp_path / "state")
    plans, run_batch = [], ingest.run_batch

    def noted(store, pages, *args, **more):
        plans.append(pages._jdf.queryExecution().toString())
        return run_batch(store, pages, *args, **more)

    monkeypatch.setattr(ingest, "run_batch", noted)
    specs = specs_df(spec(pagination={"type": "PageNumber", "page_size": 2}))
    for _ in range(2):
        pages_df(page([{"id": 1, "updated_at": day(1)}])).coalesce(1).write.mode("append").parquet(zone)
        stream = read_page_stream(spark, zone)
        ingest.ingest_stream(
            store, stream, specs, state, now=datetime(2026, 2, 1), redelivery="1 hour", snapshot_every=1
        ).awaitTermination()
    assert {r.run_id: (r.result, r.attempt) for r in store.ledger().collect()} == {"r1": ("Succeeded", 1)}
    # Of the epochs, those of watermarks and of pages that come again among them, one has pages.
    assert len(plans) == 1 and "WithinWatermark" not in plans[0]
