import hashlib
import re
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import DOCUMENTS, awkward_rows

from harvestline.llm.exact_dedup import exact_dedup, rice_decode, rice_encode


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**48 - 1), max_size=200))
def test_codes_round_trip(values):
    values = np.array(sorted(values), np.uint64)
    k, ones, low = rice_encode(values)
    assert rice_decode(len(values), k, ones, low).tolist() == values.tolist()


def test_codes_are_smaller_than_the_fingerprints():
    values = np.unique(np.random.default_rng(3).integers(0, 2**48, 20_000).astype(np.uint64))
    _, ones, low = rice_encode(values)
    assert len(ones) + len(low) < 0.8 * 6 * len(values)


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((doc_id, text or ""))
    out = []
    for body, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        digest = hashlib.sha256(body.encode()).hexdigest()
        out += [(doc_id, keep, len(members), digest) for doc_id, _ in members]
    return sorted(out, key=repr)


def check(df, rows):
    got = df.collect()
    plain = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr)
    assert plain == brute(rows)
    kept = [r for r in got if r["kept"]]
    assert sorted(r["text_sha256"] for r in kept) == sorted({r["text_sha256"] for r in got})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_awkward_rows(spark):
    rows = awkward_rows()
    check(exact_dedup(spark.createDataFrame(rows, DOCUMENTS), chunk_rows=4), rows)


def test_false_suspects_are_cleared(spark):
    # With 6 bits nearly every fingerprint is shared; only the bytes tell.
    rows = [(i, f"text {i // 3 if i < 30 else i}", "en", "a", 1) for i in range(300)]
    check(exact_dedup(spark.createDataFrame(rows, DOCUMENTS).repartition(5), 6, owners=3, chunk_rows=16), rows)


def test_hot_group(spark):
    rows = [(i, "same text" if i % 3 else f"other {i}", "en", "a", 1) for i in range(3000)]
    check(exact_dedup(spark.createDataFrame(rows, DOCUMENTS).repartition(7), chunk_rows=100), rows)


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], DOCUMENTS)
    assert exact_dedup(empty).collect() == []
    rows = awkward_rows()
    named = spark.createDataFrame(rows, DOCUMENTS).selectExpr("*", "1 AS chunk", "2 AS digest", "3 AS kept", "4 AS n")
    check(exact_dedup(named), rows)
