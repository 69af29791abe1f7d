import random
import re

import pytest
from llm_helpers import DOCUMENTS, LOWER, SF_DIR, awkward_rows

from harvestline.llm.license_scan import BASE, NOTICES, license_spans, scan_licenses


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(text):
    w, places, labels = words(text), [], set()
    for phrase, label in BASE.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def check(rows, got):
    want = sorted(((r[0], *brute(r[1])) for r in rows), key=repr)
    assert sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got), key=repr) == want
    for r in got:
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1


def test_base_places_as_brute_force(spark):
    rng = random.Random(1)
    bits = ["CC-BY", "cc", "by", "General Public License", "general", "public", "license", "All rights", "reserved", "é", "x1"]
    rows = [(i, rng.choice((" ", ", ", "\n")).join(rng.choice(bits) for _ in range(rng.randrange(30))), "en", "a", 1) for i in range(200)]
    check(rows, scan_licenses(spark.createDataFrame(rows, DOCUMENTS)).collect())


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    check([tuple(r) for r in docs.collect()], scan_licenses(docs).collect())


def test_notices_with_words_put_in_and_left_out(spark):
    notice = next(iter(NOTICES)).split()
    put_in = [*notice[:8], "absolutely", *notice[8:]]
    left_out = [*notice[:9], *notice[10:]]
    part = notice[:6]
    rows = [(i, "lead in " + " ".join(w) + " and on", "en", "a", 1) for i, w in enumerate((notice, put_in, left_out, part))]
    spans = {r["doc_id"]: r for r in license_spans(spark.createDataFrame(rows, DOCUMENTS)).collect()}
    assert sorted(spans) == [0, 1, 2]
    assert all(r["label"] == "mit" and r["first_word"] == 2 for r in spans.values())
    assert [spans[i]["end_word"] for i in range(3)] == [2 + len(notice), 3 + len(notice), 1 + len(notice)]
    assert spans[0]["cover"] == 1 > spans[1]["cover"] >= 0.5


def test_letters_that_lower_to_ascii_are_not_ascii(spark):
    rows = [(1, "aLL rİghts reserved all rights reserved", "en", "a", 1), (2, "CC BY K cc by", "en", "a", 1)]
    check(rows, scan_licenses(spark.createDataFrame(rows, DOCUMENTS)).collect())


def test_awkward_rows_and_clashing_columns(spark):
    rows = [*awkward_rows(), (20, "All Rights Reserved", "en", "a", 1), (20, "All Rights Reserved", "en", "a", 1), (None, "cc-by", None, None, 1)]
    docs = spark.createDataFrame(rows, DOCUMENTS).selectExpr("*", "1 AS gram", "2 AS key", "3 AS label", "4 AS t")
    check(rows, scan_licenses(docs).collect())


def test_empty_table(spark):
    assert scan_licenses(spark.createDataFrame([], DOCUMENTS)).collect() == []


@pytest.mark.parametrize("broadcast_grams", [10**6, 0])
def test_notices_from_a_table(spark, broadcast_grams):
    long = " ".join(f"w{i}" for i in range(400))
    notices = [("Do Not Copy", "house"), (long, "long"), (long, "long"), ("one two three four five six", None), ("alone", "never"), ("", "never"), (None, "never")]
    table = spark.createDataFrame([(*n, 1, 2) for n in notices], "phrase string, label string, gram int, template int")
    texts = ["please do not copy, do NOT copy", "do not", long, " ".join(long.split()[:150]), "alone all rights reserved", "one two three four five six", None]
    want = ["house", "", "long", "", "reserved", "", ""]
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    got = scan_licenses(docs, table, broadcast_grams).collect()
    check(rows, got)
    assert [r["labels"] for r in sorted(got, key=lambda r: r["doc_id"])] == want
    assert [r["score"] for r in sorted(got, key=lambda r: r["doc_id"])] == [1, 0, 1, 0, 1, 1, 0]
    spans = license_spans(docs, table, broadcast_grams).filter("doc_id = 0").collect()
    assert sorted((r["first_word"], r["end_word"], r["base"]) for r in spans) == [(1, 4, False), (4, 7, False)]


def test_no_notices_leave_the_base_phrases(spark):
    rows = [(1, "CC by permission is hereby granted free of charge to any person", "en", "a", 1)]
    none = spark.createDataFrame([], "phrase string, label string")
    (row,) = scan_licenses(spark.createDataFrame(rows, DOCUMENTS), none).collect()
    assert row["labels"] == "cc-by"


def test_shuffled_grams_find_what_broadcast_ones_do(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert sorted(scan_licenses(docs, broadcast_grams=0).collect(), key=repr) == sorted(scan_licenses(docs).collect(), key=repr)
