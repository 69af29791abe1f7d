"""U1 over runs, T1 and T2 over epochs, L4 acted upon."""

import os
from datetime import datetime, timedelta

from conftest import day, page, rows_of, spec, table
from harvestline.plans.run import run_batch
from harvestline.sources.pages import read_page_stream
from harvestline.streaming.ingest import expire_runs, ingest_stream

NOW = datetime(2026, 2, 1)


def items(*ids):
    return [{"id": i} for i in ids]


def test_a_record_lands_once_in_a_table(store, pages_df, specs_df):
    specs = specs_df(
        spec(watermark=False, drift="Ignore", destination=table()),
        spec("s2", watermark=False, drift="Ignore", destination=table()),
        spec("s3", watermark=False, drift="Ignore", destination=table("other", write_disposition="Truncate")),
    )

    def batch(name, *pages):
        run_batch(store, pages_df(*pages), specs, batch_id=name, now=NOW, dedupe="table")

    batch("b1", page(items(1, 2, 2)), page(items(2, 3), run="r0"), page(items(1), "s2"), page(items(1, 2), "s3"))
    # Two runs of one batch share record 2; it goes with the first.
    assert rows_of(store.read_table("d.events"), "_source_id", "_run_id", "id") == [
        ("s1", "r0", 2.0), ("s1", "r0", 3.0), ("s1", "r1", 1.0), ("s2", "r1", 1.0),
    ]
    batch("b2", page(items(1, 2, 3, 4), run="r2"), page(items(1, 5), "s2", run="r2"), page(items(2, 1), "s3", run="r2"))
    assert store.read_table("d.events").count() == 6
    # A truncated table holds nothing, so all of the second pull is there.
    assert rows_of(store.read_table("d.other"), "_run_id", "id") == [("r2", 1.0), ("r2", 2.0)]


def test_what_was_never_committed_does_not_count_as_landed(store, pages_df, specs_df, monkeypatch):
    specs = specs_df(spec(watermark=False, drift="Ignore", destination=table()))

    def batch(name, *pages):
        return run_batch(store, pages_df(*pages), specs, batch_id=name, now=NOW, dedupe="table")

    batch("b0", page(items(9), run="r0"))
    with monkeypatch.context() as patch:
        patch.setattr(type(store), "append_runs", lambda self, runs: 1 / 0)
        try:
            batch("b1", page(items(1, 2), run="r1"))
        except ZeroDivisionError:
            pass
    # The run is tried again with other pages; the lost batch's digests are of no run that landed.
    batch("b2", page(items(2, 3), run="r1"))
    batch("b3", page(items(1, 2, 3, 9), run="r2"))
    assert rows_of(store.read_table("d.events"), "_run_id", "id") == [("r0", 9.0), ("r1", 2.0), ("r1", 3.0), ("r2", 1.0)]


def folders(root):
    return sorted(os.path.relpath(d, root) for d, _, names in os.walk(root) if any(n.endswith(".parquet") for n in names))


def test_kept_pages_are_written_once_and_go_when_their_run_is_over(spark, store, pages_df, specs_df, tmp_path):
    zone, state, kept = str(tmp_path / "zone"), str(tmp_path / "state"), f"{store.root}/open_pages"
    specs = specs_df(spec(pagination={"type": "PageNumber", "page_size": 2}))
    records = [{"id": i, "updated_at": day(i)} for i in range(1, 8)]

    def drain():
        stream = read_page_stream(spark, zone, files_per_batch=1)
        ingest_stream(store, stream, specs, state, now=NOW).awaitTermination()
        return {r.run_id: r.result for r in store.ledger().collect()}

    def land(*pages):
        pages_df(*pages).coalesce(1).write.mode("append").parquet(zone)

    land(page(records[:2]))
    assert drain() == {"r1": "Running"}
    first = folders(kept)
    assert len(first) == 1
    # Other runs come and go; the waiting run's page is neither read nor written again.
    for i in range(2, 5):
        land(page(records[:1], run=f"r{i}"))
    assert drain() == {"r1": "Running", "r2": "Succeeded", "r3": "Succeeded", "r4": "Succeeded"}
    assert folders(kept) == first
    assert store.open_runs().head().attempt == 1
    land(page(records[2:4], no=2))
    drain()
    assert len(folders(kept)) == 2 and set(first) < set(folders(kept))
    land(page(records[4:5], no=3))
    assert drain()["r1"] == "Succeeded"
    # The other runs brought the first record, so it is skipped.
    assert folders(kept) == [] and store.read_ndjson().where("_run_id = 'r1'").count() == 4


def test_a_run_that_never_ends_expires(spark, store, pages_df, specs_df, tmp_path):
    zone, state = str(tmp_path / "zone"), str(tmp_path / "state")
    specs = specs_df(spec(pagination={"type": "PageNumber", "page_size": 2}), spec("s2", pagination={"type": "PageNumber", "page_size": 1}))

    def drain(now, **more):
        stream = read_page_stream(spark, zone)
        ingest_stream(store, stream, specs, state, now=now, **more).awaitTermination()
        return {(r.source_id, r.run_id): (r.result, r.error) for r in store.ledger().collect()}

    two = [{"id": i, "updated_at": day(i)} for i in (1, 2)]
    pages_df(page(two), page(two[:1], "s2")).write.mode("append").parquet(zone)
    assert set(drain(NOW).values()) == {("Running", None)}
    why = "gave up waiting for pages: landed pages end before the result set does"
    # An epoch of another run finds both overdue; nothing has come of the second that could end it.
    pages_df(page([], run="r9")).write.mode("append").parquet(zone)
    late = drain(datetime(2026, 3, 1), expire_after=timedelta(days=40))
    assert late == {("s1", "r1"): ("Failed", why), ("s2", "r1"): ("Failed", why), ("s1", "r9"): ("Succeeded", None)}
    assert store.open_pages().isEmpty() and folders(f"{store.root}/open_pages") == []


def test_runs_of_sources_that_stopped_expire_without_a_stream(store, pages_df, specs_df):
    specs = specs_df(spec(pagination={"type": "PageNumber", "page_size": 1}))
    half = pages_df(page([{"id": 1, "updated_at": day(1)}]))
    run_batch(store, half, specs, batch_id="e1", now=NOW, hold_open=True)
    store.keep_pages(half, "e1")
    early = expire_runs(store, specs, datetime(2025, 1, 1), now=NOW, batch_id="x1")
    assert early.isEmpty() and store.open_pages().count() == 1
    (run,) = expire_runs(store, specs, datetime(2026, 1, 15), now=NOW, batch_id="x2").collect()
    assert (run.result, run.attempt) == ("Failed", 2) and run.error.startswith("gave up waiting")
    assert store.open_pages().isEmpty()


def test_pages_that_come_again_reach_no_batch(spark, store, pages_df, specs_df, tmp_path):
    zone, state = str(tmp_path / "zone"), str(tmp_path / "state")
    specs = specs_df(spec(pagination={"type": "PageNumber", "page_size": 1}))

    def drain():
        stream = read_page_stream(spark, zone, files_per_batch=1)
        ingest_stream(store, stream, specs, state, now=NOW, redelivery="1 hour").awaitTermination()
        return {r.run_id: (r.result, r.attempt) for r in store.ledger().collect()}

    one = page([{"id": 1, "updated_at": day(1)}])
    for _ in range(3):
        pages_df(one).coalesce(1).write.mode("append").parquet(zone)
    # A run that is given pages again would have had three attempts.
    assert drain() == {"r1": ("Running", 1)}
    pages_df(one).coalesce(1).write.mode("append").parquet(zone)
    assert drain() == {"r1": ("Running", 1)}
    # Another answer to the same request is another page.
    pages_df(page([], no=2), page([{"id": 7, "updated_at": day(7)}], attempt=2)).coalesce(1).write.mode("append").parquet(zone)
    assert drain() == {"r1": ("Succeeded", 2)}
    assert [r.value for r in store.read_ndjson().collect()] == ['{"id":7,"updated_at":"%s"}' % day(7)]


def test_suspended_sources_run_only_what_was_asked_for(store, spark, pages_df, specs_df):
    stopped = list(spec("s2"))
    stopped[2] = True
    specs = specs_df(spec("s1", suspend_after=2), tuple(stopped), spec("s3"))

    def batch(name, *pages, requests=None):
        asked = None if requests is None else spark.createDataFrame(requests, "source_id string, kind string, request_id string, from_value string, to_value string")
        out = run_batch(store, pages_df(*pages), specs, asked, batch_id=name, now=NOW)
        return rows_of(out, "source_id", "run_id", "result")

    one = [{"id": 1, "updated_at": day(1)}]
    bad = lambda run: page([], "s1", run=run, status=404)
    assert batch("b1", bad("r1"), page(one, "s2"), page(one, "s3")) == [("s1", "r1", "Failed"), ("s3", "r1", "Succeeded")]
    assert batch("b2", bad("r2")) == [("s1", "r2", "Failed")]
    # Two failures in a row: the schedule stops, and the runs left out can be given again.
    assert batch("b3", page(one, "s1", run="r3")) == []
    asked = [("s1", "trigger", "now", None, None), ("s2", "backfill", "jan", day(1), day(9))]
    got = batch("b4", page(one, "s1", run="r3"), page(one, "s2", run="r3"), requests=asked)
    assert got == [("s1", "r3", "Succeeded"), ("s2", "r3", "Succeeded")]
    # The success ends the streak and with it the suspension.
    assert batch("b5", page(one, "s1", run="r4"), page(one, "s2", run="r4")) == [("s1", "r4", "Succeeded")]
