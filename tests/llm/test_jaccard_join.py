import os
import random
import tempfile
import time
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import DOCUMENTS, SF_DIR, awkward_rows, near_components

from pyspark.sql import functions as F

from harvestline.llm import jaccard_join as jj
from harvestline.llm.common import Scratch

RULE = jj.Similarity(90, 100)


def report(spark, rows, **options):
    docs = spark.createDataFrame(rows, DOCUMENTS)
    return jj.join_report(docs.repartition(3), **options).collect()


def edited(base, rng, n):
    words = base.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def check(rows, got, k=3, least=90, of=100):
    roots, sizes = near_components([r[1] for r in rows], k, least, of)
    first = {}
    for i, root in enumerate(roots):
        if rows[i][0] is not None:
            first[root] = min(first.get(root, rows[i][0]), rows[i][0])
    want = sorted(((r[0], n, first.get(root) if n else r[0]) for r, n, root in zip(rows, sizes, roots, strict=True)), key=repr)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == want


def near_sets(rng, size, differing):
    """Two sets of about that size that differ in so many grams."""
    grams = rng.integers(0, 2**63, size + differing).astype(np.uint64)
    out = int(rng.integers(0, differing + 1))
    return np.unique(grams[: size + out - differing + differing]), np.unique(np.concatenate([grams[: size - (differing - out)], grams[size + out :]]))


def similar(a, b, rule):
    both = len(np.intersect1d(a, b))
    return rule.of * both >= rule.least * (len(a) + len(b) - both)


@pytest.mark.parametrize("rule", [RULE, jj.Similarity(80, 100), jj.Similarity(1, 2)])
def test_similar_sets_meet_in_a_space_whatever_is_spent(rule):
    rng = np.random.default_rng(rule.least)
    met = 0
    for _ in range(600):
        size = int(rng.integers(2, 400))
        a, b = near_sets(rng, size, int(rng.integers(1, 3 + size * 2 * (rule.of - rule.least) // (rule.of + rule.least))))
        if not len(a) or not len(b) or not similar(a, b, rule) or np.array_equal(a, b):
            continue
        met += 1
        common = set(jj.spaces_of(len(a), rule)) & set(jj.spaces_of(len(b), rule))
        assert common
        seen = 0
        for space in common:
            (ha, sa, va), (hb, sb, vb) = (jj.segment_hashes(x, space) for x in (a, b))
            costs = rng.integers(0, 5, space.segments).astype(float)
            for asks, answers in (((a, ha, sa, va), (b, hb, sb, vb)), ((b, hb, sb, vb), (a, ha, sa, va))):
                x, hx, sx, vx = asks
                y, hy, sy, vy = answers
                spent = jj.allocate(space.spend(len(x)), costs, costs + rng.integers(0, 5, space.segments))
                assert space.spend(len(x)) <= spent.sum() <= space.spend(len(x)) + 1
                own = max(len(x), len(y)) <= space.high or min(len(x), len(y)) <= space.high
                one = any(u and hx[i] == hy[i] for i, u in enumerate(spent))
                less_x, less_y = set((hx[sx] - vx).tolist()), set((hy[sy] - vy).tolist())
                two = any(
                    u == 2 and (int(hx[i]) in less_y or int(hy[i]) in {int(h) for h, s in zip(hx[sx] - vx, sx, strict=True) if s == i})
                    for i, u in enumerate(spent)
                )
                seen += own and (one or two)
                if own:
                    assert one or two
                del less_x
        assert seen
    assert met > 50


def test_sketches_never_part_similar_sets():
    rng = np.random.default_rng(11)
    parted = 0
    for _ in range(300):
        a, b = near_sets(rng, int(rng.integers(20, 600)), int(rng.integers(1, 150)))
        for space in set(jj.spaces_of(len(a), RULE)) & set(jj.spaces_of(len(b), RULE)):
            x, y = jj.sketch(a, space), jj.sketch(b, space)
            assert len(x) == space.words
            bits = sum(int(v).bit_count() for v in (x ^ y).view(np.uint64))
            assert bits <= len(np.setxor1d(a, b))
            parted += bits > RULE.differing(len(a), len(b))
            assert not (similar(a, b, RULE) and bits > RULE.differing(len(a), len(b)))
    assert parted


def test_allocations_are_the_cheapest_or_nearly_so():
    rng = np.random.default_rng(3)
    for _ in range(200):
        m = int(rng.integers(1, 7))
        one = rng.integers(0, 9, m).astype(float)
        two = one + rng.integers(0, 9, m)
        spend = int(rng.integers(1, 2 * m + 1))
        spent = jj.allocate(spend, one, two)
        assert spend <= spent.sum() <= spend + 1
        price = lambda units: sum((0, one[i], two[i])[u] for i, u in enumerate(units))  # noqa: E731, B023
        every = [u for u in np.ndindex(*[3] * m) if sum(u) >= spend]
        assert price(spent) <= min(map(price, every)) + max(two)
        if (two >= 2 * one).all():
            assert price(spent) == min(map(price, every))


@pytest.mark.parametrize(("k", "least"), [(3, 90), (5, 80), (2, 95)])
def test_components_as_all_pairs_give(spark, k, least):
    rng = random.Random(k)
    rows = []
    for g in range(12):
        base = " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.choice((4, 11, 12, 60, 200))))
        rows += [(len(rows) + i, edited(base, rng, rng.choice((0, 1, 1, 2, 4))), "en", "a", 1) for i in range(g + 1)]
    rng.shuffle(rows)
    check(rows, report(spark, rows, k=k, least=least), k, least)


def test_sizes_on_both_sides_of_every_band(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = [(n, " ".join(words[:n]), "en", "a", 1) for n in range(1, 140)]
    rows += [(1000 + n, " ".join(words[200 : 200 + n]), "en", "a", 1) for n in range(5, 200, 13)]
    rng.shuffle(rows)
    check(rows, report(spark, rows))


def test_chains_a_hot_group_and_pages_of_one_template(spark):
    rng = random.Random(9)
    rows, text = [], " ".join(f"c{i}" for i in range(300))
    for i in range(60):  # each a little further from the first
        rows.append((i, text, "en", "a", 1))
        text = edited(text, rng, 3)
    base = " ".join(f"h{i}" for i in range(150))
    rows += [(1000 + i, edited(base, rng, rng.choice((1, 2, 3, 4))), "en", "a", 1) for i in range(200)]
    rows += [(5000 + i, base, "en", "a", 1) for i in range(100)]
    page = [f"p{i}" for i in range(182)]
    rows += [(7000 + i, " ".join(page + [f"own{i}x{j}" for j in range(18)]), "en", "a", 1) for i in range(150)]
    check(rows, report(spark, rows))


def test_similar_sets_share_more_subsets_than_slack():
    rng = np.random.default_rng(12)
    met = 0
    for _ in range(400):
        size = int(rng.integers(8, 400))
        a, b = near_sets(rng, size, int(rng.integers(1, 3 + size // 5)))
        if not similar(a, b, RULE) or np.array_equal(a, b):
            continue
        met += 1
        common = set(jj.spaces_of(len(a), RULE)) & set(jj.spaces_of(len(b), RULE))
        shared = {s: int((jj.segment_hashes(a, s)[0] == jj.segment_hashes(b, s)[0]).sum()) for s in common}
        assert any(n > s.segments - min(s.spend(len(a)), s.spend(len(b))) for s, n in shared.items())
    assert met > 50


def test_only_sets_that_can_be_similar_are_moved(spark):
    """However many others there are, and however many tasks have copies of them."""
    rng = random.Random(21)
    page = [f"p{i}" for i in range(100)]
    rows = [(i, " ".join(f"w{rng.randrange(10**9)}" for _ in range(120)), "en", "a", 1) for i in range(60)]
    rows += [(100 + i, rows[0][1], "en", "a", 1) for i in range(9)]
    # Half of a page in common is far from similar.
    rows += [(200 + i, " ".join(page[:60] + [f"own{i}x{j}" for j in range(60)]), "en", "a", 1) for i in range(20)]
    near = [(300 + i, " ".join(page + ["tail", f"end{i}"]), "en", "a", 1) for i in range(3)]
    join = jj._Join(spark.createDataFrame(rows + near, DOCUMENTS).repartition(6), "doc_id", 3, RULE)
    assert join.sets.count() == 3 and set(join.sets.columns) == {"node", "grams"}
    assert join.subsets.select("node").distinct().count() == 3
    assert join.rows.count() == len(rows) + 3
    check(rows + near, report(spark, rows + near))


def test_shuffle_files_go_with_the_step_that_wrote_them(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    folder = spark.conf.get("spark.local.dir", None) or os.environ.get("SPARK_LOCAL_DIRS") or tempfile.gettempdir()
    before, scratch = spark.conf.get(key), Scratch(spark, "tidy", tidy=True)

    def files():
        return {str(p) for p in Path(folder).glob("**/blockmgr*/*/shuffle_*.data")}

    had = files()
    kept = scratch.keep(spark.range(20_000).groupBy("id").agg(F.max("id").alias("m")), "many")
    until = time.time() + 10
    while files() - had and time.time() < until:
        time.sleep(0.1)
    assert not files() - had and spark.conf.get(key) == before
    assert kept.count() == 20_000


def test_awkward_rows_and_clashing_columns(spark):
    rows = awkward_rows()
    docs = spark.createDataFrame(rows, DOCUMENTS).selectExpr("*", "1 AS node", "2 AS hash", "3 AS `row`", "4 AS grams", "5 AS rank")
    check(rows, jj.join_report(docs).collect())


def test_empty_table(spark):
    assert jj.join_report(spark.createDataFrame([], DOCUMENTS)).collect() == []


def test_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    check(rows, report(spark, rows))


def test_a_task_holds_little_beside_its_texts(monkeypatch):
    class Task:
        get = classmethod(lambda cls: cls())
        partitionId = lambda self: 0

    monkeypatch.setattr(jj, "TaskContext", Task)
    rng = np.random.default_rng(3)
    texts = [" ".join(map(str, rng.integers(0, 10**6, 700))) for _ in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(texts)], ["row", "text"])
    tracemalloc.start()
    try:
        rows = sum(found.num_rows for found in jj._sets(3, jj.Similarity(90, 100))(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # 4.8 MB of texts; the arrays of 4 MB of text at once took 155 MB.
    assert rows == 1000 and peak < 40 << 20
