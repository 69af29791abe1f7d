"""Whole batches: F1-F9, P1-P10, K1-K11, L1, U1."""

from datetime import datetime

import pytest
from pyspark.sql.functions import lit

from conftest import day, page, rows_of, spec, table
from harvestline import model as m
from harvestline.plans.run import run_batch


def run(store, pages, specs, batch="b1", requests=None, at=1, **kw):
    out = run_batch(store, pages, specs, requests, batch_id=batch, now=datetime(2026, 2, at), **kw)
    return {r.source_id: r for r in out.collect()}


def rec(i, **more):
    return {"id": i, "updated_at": day(i), **more}


def test_boundary_drift_rejects_and_replay(store, pages_df, specs_df):
    """A first run, an inclusive re-delivery, each policy on a changed shape, and a replay."""
    sources = ["ignore", "warn", "additive", "breaking", "fail", "odd"]
    drift = {"ignore": "Ignore", "warn": "Warn", "additive": "EvolveAdditive", "breaking": "EvolveAdditive", "fail": "Fail", "odd": "Fail"}
    specs = specs_df(*[spec(s, drift=drift[s]) for s in sources])
    first = [page([rec(1, amount=1.5, email="a"), rec(2, amount=2, email="b"), rec(3, amount=3, email="c"), 42], source=s) for s in sources]
    done = run(store, pages_df(*first), specs)
    for s in sources:
        r = done[s]
        assert (r.result, r.rows_ingested, r.rows_rejected, r.rows_skipped) == ("Succeeded", 3, 1, 0)
        assert (r.watermark, r.request_count) == (day(3), 1)
    assert store.read_ndjson().count() == 18

    changed = [rec(3, amount="3", email="c"), rec(4, amount="4", tenant="t")]
    added = [rec(3, amount=3, email="c", tenant="t"), rec(4, amount=4, email="d", tenant="t")]
    second = [page(added if s == "additive" else changed, source=s, run="r2") for s in sources if s != "odd"]
    second += [page([rec(4, amount=1, email="x")], source="odd", run="r2")]
    done = run(store, pages_df(*second), specs, "b2", at=2)
    text = "added tenant; removed email; changed amount(number->string)"
    for s in ("ignore", "warn"):
        r = done[s]
        assert (r.result, r.rows_ingested, r.rows_skipped, r.watermark) == ("Succeeded", 1, 1, day(4))
        assert r.message == f"record shape changed: {text}"
        assert (r.schema_change.added, r.schema_change.removed) == (["tenant"], ["email"])
    assert (done["additive"].result, done["additive"].rows_ingested) == ("Succeeded", 1)
    assert done["additive"].schema_change.added == ["tenant"]
    assert (done["breaking"].result, done["breaking"].rows_ingested) == ("Failed", 0)
    assert done["breaking"].error == f"record shape changed in a non-additive way: {text}"
    assert done["fail"].error == f"record shape changed: {text}"
    assert (done["odd"].result, done["odd"].schema_change) == ("Succeeded", None)
    # Nothing of a refused run is to be seen.
    lines = store.read_ndjson()
    assert {r[0] for r in lines.where("_run_id = 'r2'").select("_source_id").distinct().collect()} == {"ignore", "warn", "additive", "odd"}
    # Adopted shapes replace the accepted ones; refused runs adopt nothing.
    shapes = {}
    for r in store.accepted_shape().collect():
        shapes.setdefault(r.source_id, {})[r.path] = r.type
    assert shapes["warn"] == {"id": "number", "updated_at": "string", "amount": "string", "tenant": "string"}
    assert shapes["breaking"]["email"] == "string" and "tenant" in shapes["additive"]

    before = lines.count()
    again = run(store, pages_df(*second), specs, "b2", at=2)
    assert len(again) == 6 and store.read_ndjson().count() == before and store.ledger().count() == 12
    # Resume points: those of the last successful runs.
    points = {r.source_id: r.watermark for r in store.resume_points().collect()}
    assert points["warn"] == day(4) and points["fail"] == day(3)


def test_backfill_takes_its_range_and_reports_no_resume_point(spark, store, pages_df, specs_df):
    specs = specs_df()
    run(store, pages_df(page([rec(8)])), specs)
    asked = spark.createDataFrame([("s1", "backfill", "jan", day(1), day(3))], m.REQUESTS)
    r = run(store, pages_df(page([rec(1), rec(2), rec(9)], run="bf")), specs, "b2", asked, at=2)["s1"]
    assert (r.kind, r.backfill_id, r.rows_ingested, r.rows_skipped, r.watermark) == ("backfill", "jan", 1, 2, None)
    assert store.resume_points().head().watermark == day(8)


def test_failures_are_recorded_with_counts(store, pages_df, specs_df):
    rows = [
        page([], source="forbidden", status=403, body="nope"),
        *[page([], source="busy", status=503, attempt=i, body="") for i in (1, 2, 3, 4)],
        page([rec(1)], source="cut", no=1),
        page([rec(2)], source="cut", no=2, body="{"),
    ]
    specs = specs_df(
        spec("forbidden"), spec("busy"), spec("cut", pagination={"type": "PageNumber", "page_size": 1}), spec("bad", url="ftp://x")
    )
    rows.append(page([rec(1)], source="bad"))
    done = run(store, pages_df(*rows), specs)
    assert {r.result for r in done.values()} == {"Failed"}
    assert done["forbidden"].error == "upstream returned 403"
    assert done["busy"].error == "giving up after 4 attempts: upstream returned 503"
    assert done["busy"].request_count == 4
    assert done["cut"].error == "decode response: not valid JSON"
    assert "must start with http" in done["bad"].error
    # The good page before the broken one was read, but nothing of a failed run lands.
    assert done["cut"].rows_ingested == 0 and done["cut"].schema_fingerprint
    assert store.columns().isEmpty() and store.accepted_shape().isEmpty()


def test_tables(store, pages_df, specs_df):
    """Create, refuse to create, nested values, copies, row refusals, dead letters, truncate."""
    specs = specs_df(
        spec("a", destination=table("a", dead_letter_table="dead")),
        spec("b", destination=table("b", create_if_missing=False)),
        spec("c", destination=table("c", write_disposition="Truncate")),
    )
    nested = {"box": {"w": 4, "unit": "cm"}, "codes": [7, 9], "active": True}
    items = [rec(1, **nested), rec(2, **nested), rec(2, **nested), 7]
    done = run(store, pages_df(*[page(items, source=s) for s in "abc"]), specs)
    assert done["b"].error == "table d.b does not exist and createIfMissing is false"
    assert (done["a"].rows_ingested, done["a"].rows_rejected) == (3, 1)
    assert rows_of(store.read_table("d.a"), "id", "active", "box", "codes") == [
        (1.0, True, '{"unit":"cm","w":4}', "[7,9]"),
        (2.0, True, '{"unit":"cm","w":4}', "[7,9]"),
    ]
    with pytest.raises(ValueError):
        store.read_table("d.b")
    letters = rows_of(store.dead_letters(), "source_id", "reason", "payload", "table_name")
    assert letters == [("a", "record is not an object", "7", "d.dead")]

    later = [{"id": 3, "updated_at": day(3), "active": "yes"}, {"id": "x", "updated_at": day(4)}, {"id": 5, "updated_at": day(5), "new": 1}]
    done = run(store, pages_df(*[page(later, source=s, run="r2") for s in "ac"]), specs, "b2", at=2)
    # Table a keeps its columns and refuses what does not fit; a text that reads as a value does.
    assert (done["a"].rows_ingested, done["a"].rows_rejected) == (1, 2)
    assert (3.0, True) in rows_of(store.read_table("d.a"), "id", "active")
    reasons = rows_of(store.dead_letters().where("run_id = 'r2'"), "reason")
    assert reasons == [("cannot convert value of id to double",), ("no such field: new",)]
    # Table c is replaced, columns and all.
    c = store.read_table("d.c")
    assert "box" not in c.columns and rows_of(c, "id", "new") == [("3", None), ("5", 1.0), ("x", None)]


def test_run_without_accepted_records_does_not_drift(store, pages_df, specs_df):
    specs = specs_df(spec(drift="Fail"))
    run(store, pages_df(page([rec(1), rec(2)])), specs)
    r = run(store, pages_df(page([rec(2)], run="r2")), specs, "b2", at=2)["s1"]
    assert (r.result, r.rows_ingested, r.rows_skipped, r.schema_change, r.watermark) == ("Succeeded", 0, 1, None, None)
    assert store.resume_points().head().watermark == day(2)


def test_optional_field_absent_from_first_page_is_not_drift(store, pages_df, specs_df):
    specs = specs_df(spec(drift="Fail", pagination={"type": "PageNumber", "page_size": 1}))
    run(store, pages_df(page([rec(1, note="x")]), page([], no=2)), specs)
    rows = pages_df(page([rec(2)], run="r2"), page([rec(3, note="y")], run="r2", no=2), page([], run="r2", no=3))
    assert run(store, rows, specs, "b2", at=2)["s1"].result == "Succeeded"


def test_last_answer_of_a_page_counts_once(store, pages_df, specs_df):
    specs = specs_df(spec(pagination={"type": "PageNumber", "page_size": 2}))
    first = page([rec(1), rec(2)], attempt=1)
    rows = pages_df(first, first, page([rec(3), rec(4)], attempt=2), page([rec(5)], no=2), page([rec(5)], no=2))
    r = run(store, rows, specs, dedupe=False)["s1"]
    assert (r.result, r.rows_ingested) == ("Succeeded", 3)
    assert store.read_ndjson().count() == 3


def test_page_numbers_below_one_fail_the_run(store, pages_df, specs_df):
    r = run(store, pages_df(page([rec(1)], no=0), page([rec(2)])), specs_df())["s1"]
    assert (r.result, r.error, store.accepted_shape().count()) == ("Failed", "page numbers start at 1", 0)


def test_requests_belong_to_one_run_and_run_once(spark, store, pages_df, specs_df):
    from pyspark.sql import functions as F

    from harvestline.operators.status import one_off_run_id

    asked = spark.createDataFrame(
        [("s1", "backfill", "one", day(1), day(3)), ("s1", "backfill", "two", day(3), day(5)), ("s1", "backfill", "two", day(3), day(5)), ("s1", "trigger", "now", None, None)],
        m.REQUESTS,
    )
    ids = {r.request_id: r.id for r in asked.select("request_id", one_off_run_id(F.col("source_id"), F.col("kind"), F.col("request_id")).alias("id")).collect()}
    records = [rec(i) for i in range(1, 8)]
    specs = specs_df()
    rows = pages_df(*[page(records, run=i) for i in (*ids.values(), "plain")])
    out = run_batch(store, rows, specs, asked, batch_id="b1", now=datetime(2026, 2, 1)).collect()
    got = {r.run_id: (r.kind, r.backfill_id, r.rows_ingested) for r in out}
    assert len(out) == 4
    assert got == {
        ids["one"]: ("backfill", "one", 2), ids["two"]: ("backfill", "two", 2),
        ids["now"]: ("trigger", None, 7), "plain": ("scheduled", None, 7),
    }
    # Asked again, nothing is pending: later runs are scheduled ones.
    again = run(store, pages_df(page([rec(9)], run="later")), specs, "b2", asked, at=2)["s1"]
    assert (again.kind, again.rows_ingested) == ("scheduled", 1)


def test_unbound_requests_take_turns(spark, store, pages_df, specs_df):
    asked = spark.createDataFrame([("s1", "backfill", x, day(1), day(3)) for x in ("b", "a")], m.REQUESTS)
    kinds = []
    for k in range(3):
        r = run(store, pages_df(page([rec(2)], run=f"r{k}")), specs_df(), f"b{k}", asked, at=k + 1)["s1"]
        kinds.append((r.kind, r.backfill_id, r.rows_ingested))
    assert kinds == [("backfill", "a", 1), ("backfill", "b", 1), ("scheduled", None, 1)]


def test_one_source_cannot_stop_the_others(store, pages_df, specs_df, monkeypatch):
    from harvestline.operators import landing

    specs = specs_df(*[spec(s, destination=table(s)) for s in ("good", "cased", "broken")])
    rows = [page([rec(1)], source="good"), page([{"id": 1, "Id": 2}], source="cased"), page([{**rec(1), "boom": 1}], source="broken")]
    typed = landing.typed_rows

    def failing(records, columns, keep):
        out = typed(records, columns, keep)
        fails = any(name == "boom" for name, _ in columns)
        return out.withColumn("boom", landing.F.raise_error(landing.F.lit("disk full"))) if fails else out

    monkeypatch.setattr(landing, "typed_rows", failing)
    done = run(store, pages_df(*rows), specs)
    assert (done["good"].result, store.read_table("d.good").count()) == ("Succeeded", 1)
    assert done["cased"].error == "columns differ only in case: Id, id"
    assert (done["broken"].result, done["broken"].rows_ingested) == ("Failed", 0)
    assert "write d.broken" in done["broken"].error
    monkeypatch.undo()
    retried = run(store, pages_df(rows[2]), specs, "b2", at=2)["broken"]
    assert (retried.result, retried.attempt, store.read_table("d.broken").count()) == ("Succeeded", 2, 1)


def test_contradicting_specs_are_refused(store, pages_df, specs_df):
    specs = specs_df(
        spec("twice"), spec("twice"), spec("keeps", destination=table("t")),
        spec("drops", destination=table("t", write_disposition="Truncate")),
    )
    done = run(store, pages_df(*[page([rec(1)], source=s) for s in ("twice", "keeps", "drops")]), specs)
    assert done["twice"].error == "source: declared more than once"
    assert {done[s].error for s in ("keeps", "drops")} == {"destination.write_disposition: the table's sources differ"}


def test_ids_that_look_like_numbers_and_dates_stay_text(store, pages_df, specs_df):
    specs = specs_df(spec("007", destination=table("t")), spec("x", destination=table("t")))
    run(store, pages_df(page([rec(1)], source="007", run="2026-01-01"), page([rec(2)], source="x", run="r")), specs)
    assert rows_of(store.read_table("d.t"), "_source_id", "_run_id", "id") == [("007", "2026-01-01", 1.0), ("x", "r", 2.0)]


def test_letters_are_whole_and_of_committed_runs(spark, store, pages_df, specs_df):
    specs = specs_df(spec(destination=table("t", dead_letter_table="dead")))
    long = "x" * (1 << 20)
    run(store, pages_df(page([rec(1), [long]])), specs)
    (letter,) = store.dead_letters().collect()
    assert letter.payload == f'["{long}"]'
    orphan = store.dead_letters().withColumn("batch_id", lit("died"))
    store.append_dead_letters(orphan)
    assert store.dead_letters().count() == 1


def test_times_are_the_runs_own(store, pages_df, specs_df):
    specs = specs_df(spec("ok"), spec("no"))
    done = run(store, pages_df(page([rec(1)], source="ok"), page([], source="no", status=403)), specs, at=5)
    assert (done["ok"].started_at, done["ok"].completed_at) == (datetime(2026, 1, 1), datetime(2026, 2, 5))
    assert done["no"].completed_at is None


def test_nothing_staged_is_left(spark, store, pages_df, specs_df):
    import os

    from harvestline.plans.staging import shared_folder

    run(store, pages_df(page([rec(1)])), specs_df(), "tidy")
    assert not [f for f in os.listdir(shared_folder(spark).removeprefix("file:")) if f.startswith("batch-tidy")]
