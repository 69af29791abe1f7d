import re
from itertools import permutations

import duckdb
import pytest
from llm_helpers import DOCUMENTS, SF_DIR, awkward_rows, space_words

from harvestline.llm import filter_audit as fa, queries

LABELS = "doc_id long, quality int, toxic int"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failed(text):
    words = space_words(text)
    out = "A" if len(words) < 200 else ""
    out += "B" if 100 * len(set(words)) < 50 * len(words) else ""
    out += "C" if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else ""
    return out + ("D" if re.search(r"[#$%&*|]", text) else "")


def brute(rows, labels):
    """The chain run over every document, order by order."""
    first, told = {}, {}
    for r in rows:
        if r[0] is not None:
            text = r[1] or ""
            first[text] = min(first.get(text, r[0]), r[0])
    for i, q, t in labels:
        if i is not None:
            good, toxic = told.get(i, (False, False))
            told[i] = (good or q == 1, toxic or t == 1)
    docs = []
    for r in rows:
        text = r[1] or ""
        fails = failed(text) + ("E" if r[0] is not None and first[text] < r[0] else "")
        docs.append((r[2] or "", fails, *told.get(r[0], (False, False))))
    out = {}
    for part in {d[0] for d in docs}:
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = [d for d in docs if d[0] == part]
            gone = []
            for step, letter in enumerate(order, 1):
                here = [d for d in left if letter in d[1]]
                redundant = sum(letter in d[1] for d in gone)
                left = [d for d in left if letter not in d[1]]
                gone += here
                total[letter] += len(here)
                alone = sum(d[0] == part and d[1] == letter for d in docs)
                out[part, order, step] = [len(left), len(here), redundant, alone, sum(d[2] for d in here), sum(d[3] for d in here)]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(total[order[step - 1]])
    return out


def audit(spark, rows, labels):
    docs = spark.createDataFrame(rows, DOCUMENTS).repartition(3)
    found = fa.filter_audit(docs, spark.createDataFrame(labels, LABELS)).collect()
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COUNTS] for r in found}
    assert len(got) == len(found)
    return got


def test_as_the_chains_give(spark):
    many = " ".join(f"word{i}" for i in range(250))
    same = "again and again " * 100
    texts = [many, many, many.upper(), same, same + "$", many + " 100%", "Short", "SHORT", "", None, "short | text", many + "　é"]
    rows = [(i, t, ("en", "de", None, "")[i % 4], "a", 1) for i, t in enumerate(texts * 3)]
    labels = [(i, i % 2, (i // 2) % 2) for i in range(0, 30, 1)] + [(3, 0, 1), (3, None, None), (None, 1, 1), (999, 1, 1)]
    assert audit(spark, rows, labels) == brute(rows, labels)


def test_awkward_rows(spark):
    rows = awkward_rows()
    labels = [(1, 1, 0), (5, None, 1), (8, 1, 1), (9, 0, 0)]
    assert audit(spark, rows, labels) == brute(rows, labels)
    assert audit(spark, rows, []) == brute(rows, [])


def test_empty_table_and_clashing_columns(spark):
    assert audit(spark, [], [(1, 1, 1)]) == {}
    docs = spark.createDataFrame(awkward_rows(), DOCUMENTS).selectExpr("*", "1 AS part", "2 AS failed", "3 AS quality", "4 AS id")
    labels = spark.createDataFrame([(1, 1, 1)], LABELS).selectExpr("*", "5 AS part", "6 AS text")
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COUNTS] for r in fa.filter_audit(docs, labels).collect()}
    assert got == brute(awkward_rows(), [(1, 1, 1)])


@pytest.mark.parametrize("block", [1, 2, 7, 1 << 20])
def test_transducer_does_not_depend_on_blocks(monkeypatch, block):
    monkeypatch.setattr(fa, "_BLOCK", block)
    for text in ("", " ", "a", " a", "a ", "one two one\nTWO\x0bé# 日本語 x\x1c\x85y ", "É" * 30, "# $ % &\t" * 9, "word " * 50 + "end"):
        words = space_words(text)
        want = (len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(text), len(re.findall(r"[#$%&*|]", text)))
        assert fa.transduce(text.encode()) == want


def test_sql_on_given_documents(spark):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    want = con.sql(queries.BOOK.oracles["op12_filter_audit"])
    got = queries.BOOK.queries["op12_filter_audit"](spark, SF_DIR).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
