"""Copies, wherever and however many."""

import json

from pyspark.sql import functions as F

from harvestline.operators import landing


def test_copies_collapse_to_the_first(spark):
    rows = [("s", "r", p, i, json.dumps({"b": 1, "a": "same"})) for p in (3, 1, 2) for i in range(40)]
    rows += [("s", "r", 9, i, json.dumps({"a": i})) for i in range(5)] + [("s", "r", 10, 0, '{"a":"same","b":1}')]
    rows += [("other", "r", 1, 0, '{"a":"same","b":1}')]
    df = spark.createDataFrame(rows, "source_id string, run_id string, page_no int, record_pos int, text string")
    df = df.repartition(8).withColumn("record", F.try_parse_json("text"))
    digested = landing.with_digest(df)
    index = landing.digest_index(digested)
    whole = landing.first_copies(digested, index.where("copies > 1"))
    got = sorted((r.source_id, r.page_no, r.record_pos) for r in whole.collect())
    assert got == [("other", 1, 0), ("s", 1, 0)] + [("s", 9, i) for i in range(5)]
    slim = {(r.source_id, r.page_no, r.record_pos, r.copies) for r in landing.dedup_records(df).collect()}
    assert ("s", 1, 0, 121) in slim and len(slim) == 7
    landed = index.where("copies > 1").select("source_id", "digest")
    assert landing.not_landed(whole, landed).count() == 6
