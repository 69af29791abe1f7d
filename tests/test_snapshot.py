"""A ledger folded in steps is the ledger folded whole."""

import random
from datetime import datetime, timedelta

import pytest

from conftest import page, rows_of, spec, table
from harvestline.operators.ledger import failure_streaks, fold_runs
from harvestline.plans.run import run_batch
from harvestline.plans.store import LEDGER, Store

START = datetime(2026, 1, 1)


def ledger_row(source, run, attempt, result, at, batch, rng):
    done = {} if result == "Running" else {"completed_at": at}
    known = rng.random() < 0.7
    return {
        "source_id": source, "run_id": run, "attempt": attempt, "kind": rng.choice(("scheduled", "trigger", "backfill")),
        "backfill_id": rng.choice((None, "", f"b{rng.randrange(4)}")), "created_at": at, "result": result,
        "rows_ingested": rng.randrange(100), "watermark": f"w{rng.randrange(99)}" if known else None,
        "schema_fingerprint": f"f{rng.randrange(5)}" if known else "", "batch_id": batch, **done,
    }


def history(seed, batches=6):
    """Batches of runs in no order of time; what fails or goes on may come again."""
    rng = random.Random(seed)
    again, out = [], []
    for b in range(batches):
        rows, later = [], []
        fresh = [(f"s{rng.randrange(3)}", f"r{b}-{i}", 1) for i in range(12)]
        for source, run, attempt in fresh + again:
            result = rng.choice(("Succeeded", "Failed", "Failed", "Running"))
            rows.append(ledger_row(source, run, attempt, result, START + timedelta(minutes=rng.randrange(5000)), f"b{b}", rng))
            if result != "Succeeded" and rng.random() < 0.6:
                later.append((source, run, attempt + 1))
        again = later
        out.append(rows)
    return out


@pytest.mark.parametrize(("seed", "at"), [(1, {0}), (2, {1, 2}), (3, {0, 1, 2, 3, 4, 5}), (4, set()), (5, {2, 5})])
def test_any_snapshots_give_the_whole_fold(spark, store, seed, at):
    plain = Store(spark, f"{store.root}-plain")
    for i, rows in enumerate(history(seed)):
        df = spark.createDataFrame([tuple(r.get(f) for f in LEDGER.fieldNames()) for r in rows], LEDGER)
        for s in (store, plain):
            s.append_runs(df)
        if i in at:
            assert store.snapshot() == store.generation() > 0
    assert store.generation() == len(at)
    runs = plain.ledger()
    whole = fold_runs(runs)
    assert rows_of(store.folded(), *whole.columns) == rows_of(whole)
    assert rows_of(store.streaks()) == rows_of(failure_streaks(runs, whole))
    assert rows_of(store.ledger(), *LEDGER.fieldNames()) == rows_of(runs, *LEDGER.fieldNames())
    assert store.has_batch("b0") and not store.has_batch("b9") and store.batch("b0").count() == 12


def _plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_the_fold_reads_no_settled_partition(spark, store):
    for i, rows in enumerate(history(7, 3)):
        if i:
            store.snapshot()
        df = spark.createDataFrame([tuple(r.get(f) for f in LEDGER.fieldNames()) for r in rows], LEDGER)
        store.append_runs(df)
    for read in (store.folded(), store.streaks(), store.resume_points()):
        plan = _plan(read)
        assert "runs/generation=2" in plan and "snapshots/1" in plan
        assert "history" not in plan and "generation=0" not in plan and "generation=1" not in plan


def test_a_snapshot_that_died_is_taken_again(spark, store):
    first, second = history(8, 2)
    frame = lambda rows: spark.createDataFrame([tuple(r.get(f) for f in LEDGER.fieldNames()) for r in rows], LEDGER)
    store.append_runs(frame(first))
    # All but its last table was written, with rows of its own.
    frame(first[:3]).write.parquet(f"{store.root}/snapshots/0/open")
    frame(first[:3]).write.parquet(f"{store.root}/history/generation=0")
    assert store.generation() == 0
    before = rows_of(store.folded())
    assert store.snapshot() == 1
    assert rows_of(store.folded()) == before
    store.append_runs(frame(second))
    assert store.ledger().count() == len({r["run_id"] for r in first + second})


def test_batches_over_snapshots(store, pages_df, specs_df):
    """Columns, shapes, resume points, attempts and requests are known past a snapshot."""
    specs = specs_df(spec(destination=table(), records_path="items", drift="Fail"))
    day = lambda n: f"2026-01-{n:02d}T00:00:00Z"

    def batch(name, *pages):
        return run_batch(store, pages_df(*pages), specs, batch_id=name, now=datetime(2026, 2, 1), snapshot_every=1)

    one = lambda n, **more: {"id": n, "updated_at": day(n), **more}
    first = batch("b1", page([one(1), one(2)], run="r1"), page([], run="r2", status=404))
    assert rows_of(first, "run_id", "result") == [("r1", "Succeeded"), ("r2", "Failed")]
    assert store.generation() == 1
    assert store.resume_points().head().watermark == day(2)
    # A run that succeeded is left out, one that failed is tried again, old records are skipped.
    second = batch("b2", page([one(9)], run="r1"), page([one(2), one(3)], run="r2"))
    assert rows_of(second, "run_id", "attempt", "rows_ingested", "rows_skipped") == [("r2", 2, 1, 1)]
    # The accepted shape is known: a new field fails the run, and nothing is written.
    third = batch("b3", page([one(4, extra="x")], run="r3"))
    assert rows_of(third, "result", "rows_ingested") == [("Failed", 0)]
    assert store.generation() == 3
    assert rows_of(store.read_table("d.events"), "id") == [(1.0,), (2.0,), (3.0,)]
    assert {r.column_name for r in store.columns().collect()} == {"id", "updated_at"}
    # A batch that is known from before any snapshot is not run again.
    assert rows_of(batch("b1", page([one(5)], run="r5")), "run_id") == [("r1",), ("r2",)]
    assert store.ledger().count() == 3 and store.generation() == 3
