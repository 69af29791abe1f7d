"""What a batch writes is one folder, however many runs it has."""

import os
from datetime import datetime

from pyspark.sql import functions as F

from conftest import day, page, rows_of, spec
from harvestline.operators.landing import ndjson_line, read_ndjson_line
from harvestline.plans.run import run_batch


def test_a_line_gives_back_its_run_and_its_record(spark):
    rows = [("s1", "r1", '{"id":1}'), ('a","record":{"', "line\nbreak\\", '{"record":",\\"record\\":","x":"}"}'), ("é", "2026-01-01", "[1,2]")]
    df = spark.createDataFrame(rows, "s string, r string, t string").withColumn("v", F.parse_json("t"))
    lines = df.select(ndjson_line(F.col("s"), F.col("r"), F.col("v")), F.to_json("v").alias("t"), "s", "r")
    assert not any("\n" in r.value for r in lines.collect())
    back = lines.select(*read_ndjson_line(F.col("value")), "t", "s", "r").collect()
    assert all((b.value, b._source_id, b._run_id) == (b.t, b.s, b.r) for b in back)


def test_runs_of_a_batch_share_a_folder(store, pages_df, specs_df):
    pages = [page([{"id": i, "updated_at": day(i)}], run=f"r{i}") for i in range(1, 6)]
    run_batch(store, pages_df(*pages), specs_df(spec()), batch_id="b1", now=datetime(2026, 2, 1))
    folders = [name for name in os.listdir(store.ndjson_path()) if "=" in name]
    assert len(folders) == 1
    assert rows_of(store.read_ndjson(), "_run_id") == [(f"r{i}",) for i in range(1, 6)]
