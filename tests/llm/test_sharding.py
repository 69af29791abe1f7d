from collections import Counter

from llm_helpers import DOCUMENTS, awkward_rows
from pyspark.sql import functions as F

from harvestline.llm.sharding import shard_documents, shard_report


def check(rows, docs, limit):
    placed, directory = (df.collect() for df in shard_documents(docs, limit))
    want = sorted(((r[0], len((r[1] or "").encode())) for r in rows), key=repr)
    assert sorted(((r["doc_id"], r["n_bytes"]) for r in placed), key=repr) == want
    total, count = Counter(), Counter()
    for r in placed:
        total[r["shard"]] += r["n_bytes"]
        count[r["shard"]] += 1
    assert {r["shard"]: (r["shard_bytes"], r["n_docs"]) for r in directory} == {s: (total[s], count[s]) for s in total}
    for r in directory:
        assert len(r["shard"]) == r["depth"]
        assert r["shard_bytes"] <= limit or (r["oversized"] and r["n_docs"] == 1)
    # Prefixes that aren't oversized divide the hash space: none begins another.
    names = sorted(r["shard"] for r in directory if not r["oversized"])
    assert not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False))
    return directory


def test_every_shard_fits(spark):
    rows = [(i, "x" * (i % 90 + 1 if i % 10 else 1500), "en", "a", 1) for i in range(3000)]
    directory = check(rows, spark.createDataFrame(rows, DOCUMENTS), 2000)
    assert len({r["depth"] for r in directory}) > 1  # only full buckets were split


def test_only_oversized_buckets_split(spark):
    rows = [(i, "x" * (5000 if i % 400 == 0 else 10), "en", "a", 1) for i in range(2000)]
    directory = check(rows, spark.createDataFrame(rows, DOCUMENTS), 4000)
    assert sum(r["oversized"] for r in directory) == 5


def test_repeated_rows_split_too(spark):
    rows = [(7, "the same text", "en", "a", 1)] * 500
    assert len(check(rows, spark.createDataFrame(rows, DOCUMENTS), 1000)) > 6


def test_awkward_rows_and_clashing_columns(spark):
    rows = awkward_rows()
    docs = spark.createDataFrame(rows, DOCUMENTS).selectExpr("*", "1 AS hash", "'x' AS shard", "2 AS n_bytes")
    check(rows, docs, 500)


def test_empty_table(spark):
    assert shard_report(spark.createDataFrame([], DOCUMENTS), 100).collect() == []


def test_depths_as_brute_force(spark):
    rows = [(i, "x" * (i % 90 + 1 if i % 10 else 1500), "en", "a", 1) for i in range(2000)]
    docs, limit = spark.createDataFrame(rows, DOCUMENTS), 3000
    key = F.xxhash64("doc_id", F.isnull("doc_id"), "text").bitwiseAND(F.lit((1 << 40) - 1))
    names = {r["doc_id"]: format(r["key"], "040b") for r in docs.select("doc_id", key.alias("key")).collect()}
    size = {r[0]: len(r[1]) for r in rows}
    depth = (2 * sum(size.values()) // limit).bit_length()
    want, todo = {}, set(size)
    while todo:
        held = Counter()
        for i in todo:
            held[names[i][:depth]] += size[i]
        fits = {i for i in todo if held[names[i][:depth]] <= limit}
        want |= {i: (names[i][:depth], held[names[i][:depth]]) for i in fits}
        todo, depth = todo - fits, depth + 1
    assert {r["doc_id"]: (r["shard"], r["shard_bytes"]) for r in shard_report(docs, limit).collect()} == want
