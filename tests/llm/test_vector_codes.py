import hashlib
import math
import random

import duckdb
import numpy as np
from llm_helpers import SF_DIR

from harvestline.llm import queries, vector_codes as vc

ROWS = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=4, entries=256, rounds=4):
    """The contract, one vector and entry at a time."""
    whole = [
        (i, [math.floor(1024 * np.float64(np.float32(c))) for c in v], label)
        for i, v, label in rows
        if v is not None and all(c is not None and math.isfinite(np.float32(c)) for c in v)
    ]
    whole.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not whole:
        return []
    width = len(whole[0][1])
    whole = [r for r in whole if len(r[1]) == width]
    at = [i * width // parts for i in range(parts + 1)]
    cut = lambda v: [tuple(v[a:b]) for a, b in zip(at, at[1:])]  # noqa: E731, B905
    books = [[cut(r[1])[p] for r in whole[:entries]] for p in range(parts)]

    def assign(part, book):
        apart = [sum((a - b) ** 2 for a, b in zip(part, e, strict=True)) for e in book]
        return min(range(len(book)), key=lambda k: (apart[k], k)), min(apart)

    for _ in range(rounds):
        for p in range(parts):
            of = {}
            for _, v, _ in whole:
                of.setdefault(assign(cut(v)[p], books[p])[0], []).append(cut(v)[p])
            for k, members in of.items():
                books[p][k] = tuple(sum(c) // len(members) for c in zip(*members, strict=True))
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    coded = []
    for i, v, label in whole:
        found = [assign(part, book) for part, book in zip(cut(v), books, strict=True)]
        coded.append((i, "".join(f"{k:02x}" for k, _ in found), sum(d for _, d in found), label))
    total = {}
    for _, _, e, label in coded:
        total[label] = total.get(label, 0) + e
    return sorted(((i, c, e, total[label], digest) for i, c, e, label in coded), key=repr)


def report(spark, rows):
    got = vc.code_report(spark.createDataFrame(rows, ROWS).repartition(3)).collect()
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got), key=repr)


def vectors(n, width, seed, spread=0.2):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(5)]
    rows = []
    for i in range(n):
        m = rng.choice(middles)
        rows.append((i * 3 % n if n % 3 else i, [c + rng.gauss(0, spread) for c in m], rng.choice((0, 1, 2, None))))
    return rows


def test_as_brute_force(spark):
    rows = vectors(400, 8, 1)
    assert report(spark, rows) == brute(rows)


def test_nulls_ties_lengths_and_repeated_rows(spark):
    rows = vectors(290, 10, 2)  # ten components don't fall into four equal parts
    rows += [(1000 + i, [0.5] * 10, None) for i in range(40)] + [rows[0], rows[0], (None, [0.1] * 10, 7)]
    rows += [(2000, None, 1), (2001, [0.1, None] + [0.0] * 8, 1), (2002, [math.nan] * 10, 1), (2003, [math.inf] + [0.0] * 9, 1)]
    rows += [(2004, [0.0] * 9, 1), (2005, [], 1)]
    got = report(spark, rows)
    assert got == brute(rows) and len(got) == 333


def test_few_rows_one_row_and_none(spark):
    for rows in (vectors(20, 8, 3), [(1, [0.25] * 4, None)], [(1, [], 3), (2, [], None)]):
        assert report(spark, rows) == brute(rows)
    assert report(spark, [(1, None, 1)]) == [] and report(spark, []) == []


def test_huge_components_do_not_overflow(spark):
    rows = [(i, [3e38 if i % 2 else -3e38, float(i), 0.0, 1.0], i % 3) for i in range(300)]
    assert len(report(spark, rows)) == 300


def test_clashing_columns(spark):
    rows = vectors(30, 8, 4)
    df = spark.createDataFrame(rows, ROWS).selectExpr("*", "1 AS id", "'x' AS code", "2 AS x", "3 AS error")
    got = sorted((tuple(r) for r in vc.code_report(df).collect()), key=repr)
    assert got == brute(rows)


def test_cells_keep_every_entry_that_can_be_nearest():
    rng = np.random.default_rng(7)
    for width, spread in ((1, 40), (3, 300), (16, 120)):
        book = rng.integers(-spread, spread, (64, width))
        memo = vc.Cells(book)
        for _ in range(3):  # the later ones meet remembered cells
            x = np.concatenate([rng.integers(-2 * spread, 2 * spread, (300, width)), book[:20]])
            apart = ((x[:, None, :] - book) ** 2).sum(axis=2)
            index, distance = memo.nearest(x)
            assert (index == apart.argmin(axis=1)).all() and (distance == apart.min(axis=1)).all()


def test_memory_is_bounded_and_fewer_entries_are_evaluated(monkeypatch):
    monkeypatch.setattr(vc, "CELLS", 10)
    rng = np.random.default_rng(8)
    book = rng.integers(-400, 400, (256, 2))
    memo = vc.Cells(book)
    for _ in range(20):
        x = rng.integers(-400, 400, (50, 2))
        apart = ((x[:, None, :] - book) ** 2).sum(axis=2)
        assert (memo.nearest(x)[0] == apart.argmin(axis=1)).all()
        assert len(memo.new) <= 10 + 50 and len(memo.old) <= 10 + 50
    assert np.mean([len(e) for e in memo.new.values()]) < 64


def test_sql_on_given_vectors(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF_DIR}/embeddings.parquet'")
    want = con.sql(queries.BOOK.oracles["op11_vector_codes"])
    got = queries.BOOK.queries["op11_vector_codes"](spark, SF_DIR).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
