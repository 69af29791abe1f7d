"""Operator 12: what each filter of a chain removes, in every order of the chain.

1. A text's UTF-8 bytes go once through a finite-state transducer.  Its table gives
   each byte its kind (of a word, capital, first byte of a code point, symbol); its
   two states are between words and inside one.  The output of the pass is a count
   of each kind and, where the state changes, the edge of a word.  Each word's span
   goes into the document's hash table, which compares bytes where hashes meet, so
   distinct words are exact.  A text is read in blocks; state and an open word are
   carried over, so a long text is whole and its arrays are a block's.
2. Equal texts meet by a 128-bit digest; the least ``doc_id`` of each decides
   filter E for the others.
3. Documents are counted by part, failed filters and labels: at most 32 rows a part.
   Orders and steps are spelled out on those counts only.

A null text is empty and fails A; it has no words, so it passes B.  Texts that are
equal fail E but for the rows with the least ``doc_id``, removed or not; rows that
repeat that ``doc_id`` pass too, and a row without ``doc_id`` passes, as nothing is
smaller than null.  Null languages are part ``''``.  Labels that repeat a
``doc_id`` count as one, 1 if any is; a null ``doc_id`` has none.  An empty table
has no parts and gives no rows.  Other columns of either table are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestline.llm.common import SPACE_BYTES, Scratch

FILTERS = "ABCDE"
SYMBOLS = b"#$%&*|"
_BLOCK = 1 << 20  # bytes in the transducer at a time

# The transducer's table: bits that say of what kind a byte is.
_WORD, _CAPITAL, _POINT, _SYMBOL = 1, 2, 4, 8
_KIND = np.full(256, _WORD | _POINT, np.uint8)
_KIND[list(SPACE_BYTES)] = _POINT
_KIND[0x80:0xC0] = _WORD  # further bytes of a code point
_KIND[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] |= _CAPITAL
_KIND[list(SYMBOLS)] |= _SYMBOL


def transduce(text: bytes) -> tuple[int, int, int, int, int]:
    """Words, distinct words, capitals, code points and symbols of a UTF-8 text."""
    seen: set[bytes] = set()
    kinds = np.zeros(16, np.int64)
    words, state, open_at = 0, 0, None
    for at in range(0, len(text), _BLOCK):
        kind = _KIND[np.frombuffer(text, np.uint8, min(_BLOCK, len(text) - at), at)]
        kinds += np.bincount(kind, minlength=16)
        inside = kind & _WORD
        edges = (np.flatnonzero(np.diff(inside, prepend=np.uint8(state))) + at).tolist()
        state = int(inside[-1])
        if open_at is not None:
            edges.insert(0, open_at)
        open_at = edges.pop() if len(edges) % 2 else None
        words += len(edges) // 2
        seen.update(map(text.__getitem__, map(slice, edges[::2], edges[1::2])))
    if open_at is not None:
        words += 1
        seen.add(text[open_at:])
    of = lambda bit: int(sum(n for kind, n in enumerate(kinds.tolist()) if kind & bit))
    return words, len(seen), of(_CAPITAL), of(_POINT), of(_SYMBOL)


def _fails(text: bytes) -> str:
    words, distinct, capitals, points, symbols = transduce(text)
    failed = "A" if words < 200 else ""
    failed += "B" if 100 * distinct < 50 * words else ""
    failed += "C" if 100 * capitals > 3 * points else ""
    return failed + ("D" if symbols else "")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        failed, digests = [], []
        for raw in batch.column(2).cast(pa.binary()):
            text = raw.as_py() or b""
            failed.append(_fails(text))
            digests.append(hashlib.blake2b(text, digest_size=16).digest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(failed, pa.string()), pa.array(digests, pa.binary())],
            ["id", "part", "failed", "digest"],
        )


def failed_filters(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``id, part, failed``: the letters of the filters each row fails, in order."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), "text")
    scanned = scratch.keep(read.mapInArrow(_scan, f"id {kind}, part string, failed string, digest binary"), "scanned")
    first = scanned.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # A table read again, not an aggregate, so that the join can split a text with very many copies.
    first = scratch.keep(first, "first")
    again = F.when(F.col("id") > F.col("first"), "E").otherwise("")
    return scanned.join(first, "digest", "left").select("id", "part", F.concat("failed", again).alias("failed"))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a part, order and step of the chain; counts of documents as in the contract, zeros included."""
    failed = failed_filters(docs, Scratch(docs.sparkSession, "filter-audit"))
    told = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id"))
    told = told.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    counts = (
        failed.join(told, "id", "left")
        .groupBy("part", "failed")
        .agg(
            F.count("*").alias("n"),
            F.coalesce(F.sum("good"), F.lit(0)).alias("good"),
            F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"),
        )
    )
    orders = F.split(F.lit(" ".join("".join(p) for p in permutations(FILTERS))), " ")
    steps = (
        counts.withColumn("filter_order", F.explode(orders))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
        .withColumn("letter", F.expr("substring(filter_order, step, 1)"))
        .withColumn("earlier", F.expr("translate(failed, substring(filter_order, 1, step - 1), '') <> failed"))
        .withColumn("here", F.expr("contains(failed, letter)"))
    )
    count = lambda what, when: F.sum(F.when(F.expr(when), F.col(what)).otherwise(0))
    each = steps.groupBy("part", "filter_order", "step", "letter").agg(
        count("n", "NOT earlier AND NOT here").alias("kept"),
        count("n", "NOT earlier AND here").alias("removed"),
        count("n", "earlier AND here").alias("redundant"),
        count("n", "failed = letter").alias("unique_fails"),
        count("good", "NOT earlier AND here").alias("good_lost"),
        count("toxic", "NOT earlier AND here").alias("toxic_lost"),
    )
    shares = each.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return each.join(shares, ["part", "letter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
