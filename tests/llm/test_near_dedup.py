import random

import numpy as np
import pytest
from llm_helpers import DOCUMENTS, SF_DIR, awkward_rows, near_components, shingles

from harvestline.llm import near_dedup as nd


def report(spark, rows, **options):
    docs = spark.createDataFrame(rows, DOCUMENTS)
    return nd.near_report(docs.repartition(3), **options).collect()


def edited(base, rng, n):
    words = base.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def check(rows, got, k, least, of):
    roots, sizes = near_components([r[1] for r in rows], k, least, of)
    first = {}
    for i, root in enumerate(roots):
        if rows[i][0] is not None:
            first[root] = min(first.get(root, rows[i][0]), rows[i][0])
    want = sorted(((r[0], n, first.get(root) if n else r[0]) for r, n, root in zip(rows, sizes, roots, strict=True)), key=repr)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize(("k", "least"), [(3, 85), (5, 80)])
def test_groups_as_all_pairs_give(spark, k, least):
    rng = random.Random(k)
    rows = []
    for g in range(12):
        base = " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.choice((4, 12, 60, 200))))
        rows += [(len(rows) + i, edited(base, rng, rng.choice((0, 1, 1, 2, 4))), "en", "a", 1) for i in range(g + 1)]
    rng.shuffle(rows)
    check(rows, report(spark, rows, k=k, least=least), k, least, 100)


def test_chains_and_a_hot_group(spark):
    rng = random.Random(9)
    rows, text = [], " ".join(f"c{i}" for i in range(300))
    for i in range(60):  # each a little further from the first
        rows.append((i, text, "en", "a", 1))
        text = edited(text, rng, 3)
    base = " ".join(f"h{i}" for i in range(150))
    rows += [(1000 + i, edited(base, rng, rng.choice((1, 3, 6))), "en", "a", 1) for i in range(150)]
    rows += [(5000 + i, base, "en", "a", 1) for i in range(100)]
    check(rows, report(spark, rows), 3, 85, 100)


def test_awkward_rows_and_clashing_columns(spark):
    rows = awkward_rows()
    docs = spark.createDataFrame(rows, DOCUMENTS).selectExpr("*", "1 AS node", "2 AS key", "3 AS `row`", "4 AS bands", "5 AS _of")
    check(rows, nd.near_report(docs).collect(), 3, 85, 100)
    kept = nd.near_dedup(docs)
    assert kept.columns == docs.columns
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    roots, sizes = near_components([r[1] for r in rows], 5, 80, 100)
    assert len(got) == len({root for root, n in zip(roots, sizes, strict=True) if n}) + sum(1 for n in sizes if not n)


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCUMENTS)
    assert nd.near_report(empty).collect() == []
    assert nd.near_dedup(empty).collect() == []


def test_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    check(rows, report(spark, rows), 3, 85, 100)


def test_estimates_are_corrected_for_chance():
    rng = np.random.default_rng(2)
    for share in (0.0, 0.5, 0.9):
        errors = []
        for _ in range(30):
            both = rng.integers(0, 2**63, int(1000 * share)).astype(np.uint64)
            n = (1000 - len(both)) // 2
            a, b = (np.concatenate([both, rng.integers(0, 2**63, n).astype(np.uint64)]) for _ in range(2))
            x, y = (nd.low_bits(nd.minima(nd._mix(s))).view(np.uint64) for s in (a, b))
            differ = x ^ y
            differ = (differ | differ >> np.uint64(1)) & np.uint64(0x5555555555555555)
            equal = nd.HASHES - sum(int(d).bit_count() for d in differ)
            errors.append((equal / nd.HASHES - 0.25) / 0.75 - share)
        assert abs(np.mean(errors)) < 0.03


def test_word_hashes_do_not_depend_on_the_cut(monkeypatch):
    texts = [b"One two  three\n", b"", b" \t ", b"four", b"five six " * 50, b"seven"]
    whole = [s.tolist() for s in nd.shingle_sets(texts, 3)]
    monkeypatch.setattr(nd, "_SEGMENT", 64)
    assert [s.tolist() for s in nd.shingle_sets(texts, 3)] == whole
    assert [len(s) for s in whole] == [len(shingles(t.decode(), 3)) for t in texts]


def test_components_of_random_graphs(spark):
    rng = random.Random(4)
    nodes = [bytes([i // 256, i % 256]) for i in range(400)]
    links = [tuple(rng.sample(nodes, 2)) for _ in range(330)] + [(nodes[i], nodes[i + 1]) for i in range(100)]
    got = nd.components(spark.createDataFrame(links, "a binary, b binary"), nd.Scratch(spark, "test")).collect()
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    found = {bytes(r["node"]): bytes(r["root"]) for r in got}
    assert all(found.get(n, n) == find(n) for n in nodes)


def ran(spark, work):
    """Result, jobs and tasks of some work, with many partitions that nothing merges."""
    many = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in many}
    context, group = spark.sparkContext, f"ran-{random.random()}"
    for k, v in many.items():
        spark.conf.set(k, v)
    context.setJobGroup(group, "test")
    try:
        found = work()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    told = context.statusTracker()
    jobs = told.getJobIdsForGroup(group)
    stages = [told.getStageInfo(s) for s in {s for j in jobs for s in told.getJobInfo(j).stageIds}]
    return found, len(jobs), sum(s.numCompletedTasks for s in stages if s)


def test_few_links_take_few_tasks(spark):
    links = [(bytes([i]), bytes([i + 1])) for i in range(0, 120, 2)] + [(bytes([200 + i]), bytes([201 + i])) for i in range(20)]
    links = spark.createDataFrame(links, "a binary, b binary")
    got, _, tasks = ran(spark, lambda: nd.components(links, nd.Scratch(spark, "test")).collect())
    root = {r["node"][0]: r["root"][0] for r in got}
    assert root == {i + 1: i for i in range(0, 120, 2)} | {201 + i: 200 for i in range(20)}
    assert tasks < 4 * 64


def test_the_bitmap_takes_one_job(spark):
    nodes = spark.range(300).selectExpr("unhex(sha1(cast(id AS string))) AS node")
    area, jobs, _ = ran(spark, lambda: nd._filter_bytes(nodes))
    want = {int.from_bytes(r["node"][:8]) >> (64 - nd.FILTER_BITS) for r in nodes.collect()}
    assert {8 * i + b for i, byte in enumerate(area) if byte for b in range(8) if byte >> b & 1} == want
    assert jobs <= 2
