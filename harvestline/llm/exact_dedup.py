"""Operator 1: exact deduplication by exchanging Golomb-coded fingerprints.

1. Each task hashes the normalised texts of its rows.  Of a chunk of rows it
   keeps the sorted distinct fingerprints, cuts them by owner (a range of the
   fingerprint), and sends each owner one message: Golomb-Rice coded gaps, and a
   bit for each fingerprint that the chunk itself holds more than once.
2. An owner decodes its messages and answers each with a bitmap: which of its
   fingerprints some other row has too.  A group of copies costs one fingerprint
   a chunk, however large it is.
3. Rows whose bit is set are suspects.  Their texts, and no others, are shuffled
   by SHA-256 and compared byte by byte: least and greatest text of a digest must
   be the same.  Both combine on the map side, so a hot group moves one text a
   task.

A fixed-size bitmap of suspected fingerprints (``FILTER_BITS``) is sent to the
tasks that fetch the suspects' texts; once it fills up it lets more rows through
to the comparison, and the result stays the same.

Texts are equal when they are the same after deleting white space; null counts
as empty, and empty texts are copies of each other.  Of equal texts the row with
most code points stays, then the smallest ``doc_id`` (null last), then the first
row read.  Repeated rows are copies like any other.  An empty table gives an
empty result.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestline.llm.common import SPACE_BYTES, Scratch, shuffle_partitions

CHUNK_ROWS = 65_536
FINGERPRINT_BITS = 48
FILTER_BITS = 26  # 8 MB
OWNER_ROWS = 2_000_000  # fingerprints that an owner decodes at once, about

_PRINTS = (
    "chunk long, owner int, seq int, slot int, doc_id {id}, n_chars long, digest binary,"
    " n int, rice int, ones binary, low binary, again binary"
)


def rice_encode(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """Sorted distinct unsigned values as (parameter, unary quotients, remainders) of their gaps."""
    gaps = np.diff(values, prepend=np.uint64(0))
    mean = max(1.0, float(values[-1]) / len(values)) if len(values) else 1.0
    k = max(0, int(np.log2(mean * np.log(2)))) if mean * np.log(2) >= 1 else 0
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotients + 1) - 1
    ones = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, np.uint8)
    ones[ends] = 1
    shifts = np.arange(k, dtype=np.uint64)
    low = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    return k, np.packbits(ones).tobytes(), np.packbits(low).tobytes()


def rice_decode(n: int, k: int, ones: bytes, low: bytes) -> np.ndarray:
    """The values that ``rice_encode`` was given."""
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(ones, np.uint8)))[:n]
    gaps = np.diff(ends, prepend=-1).astype(np.uint64) - np.uint64(1) << np.uint64(k)
    if k:
        bits = np.unpackbits(np.frombuffer(low, np.uint8))[: n * k].reshape(n, k).astype(np.uint64)
        gaps |= bits @ (np.uint64(1) << np.arange(k, dtype=np.uint64))
    return np.cumsum(gaps, dtype=np.uint64)


def _normal(text: pa.Array) -> list[bytes]:
    return [(raw or b"").translate(None, SPACE_BYTES) for raw in text.cast(pa.binary()).to_pylist()]


def _heads(digests: list[bytes], bits: int) -> np.ndarray:
    """The first ``bits`` of each digest as a number."""
    return np.array([int.from_bytes(d[:8]) for d in digests], np.uint64) >> np.uint64(64 - bits)


def _print_rows(owners: int, bits: int, chunk_rows: int):
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        ids, lengths, digests, held = [], [], [], 0
        for batch in batches:
            ids.append(batch.column(0))
            lengths.append(pc.fill_null(pc.utf8_length(batch.column(1)), 0).cast(pa.int64()))
            digests += [hashlib.sha256(raw).digest() for raw in _normal(batch.column(1))]
            held += batch.num_rows
            if held >= chunk_rows:
                yield from _chunk((part << 24) + k, owners, bits, ids, lengths, digests)
                k, ids, lengths, digests, held = k + 1, [], [], [], 0
        if held:
            yield from _chunk((part << 24) + k, owners, bits, ids, lengths, digests)

    return prints


def _owner(heads: np.ndarray, owners: int, bits: int) -> np.ndarray:
    """Equal ranges of the fingerprint, by its first 24 bits."""
    top = heads >> np.uint64(bits - 24) if bits >= 24 else heads << np.uint64(24 - bits)
    return (top * np.uint64(owners) >> np.uint64(24)).astype(np.int32)


def _chunk(chunk: int, owners: int, bits: int, ids, lengths, digests) -> Iterator[pa.RecordBatch]:
    heads = _heads(digests, bits)
    values, back, counts = np.unique(heads, return_inverse=True, return_counts=True)
    owner = _owner(values, owners, bits)  # ascending, as values are
    first = np.searchsorted(owner, np.arange(owners))
    n = len(digests)
    names = ["chunk", "owner", "seq", "slot", "doc_id", "n_chars", "digest", "n", "rice", "ones", "low", "again"]
    ids = pa.concat_arrays(ids)
    empty = [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n, chunk)),
            pa.array(owner[back]),
            pa.array(np.arange(n, dtype=np.int32)),
            pa.array((back - first[owner[back]]).astype(np.int32)),
            ids,
            pa.concat_arrays(lengths),
            pa.array(digests, pa.binary()),
            *empty,
        ],
        names,
    )
    messages = []
    for o in np.unique(owner):
        own = owner == o
        k, ones, low = rice_encode(values[own])
        messages.append((int(o), int(own.sum()), k, ones, low, np.packbits(counts[own] > 1).tobytes()))
    o, size, k, ones, low, again = zip(*messages, strict=True)
    m = len(messages)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(m, chunk)),
            pa.array(o, pa.int32()),
            pa.nulls(m, pa.int32()),
            pa.nulls(m, pa.int32()),
            pa.nulls(m, ids.type),
            pa.nulls(m, pa.int64()),
            pa.nulls(m, pa.binary()),
            pa.array(size, pa.int32()),
            pa.array(k, pa.int32()),
            *(pa.array(x, pa.binary()) for x in (ones, low, again)),
        ],
        names,
    )


def _answer(bits: int, filter_bits: int):
    """Bitmaps for an owner's messages, and its part of the filter as set positions packed in bits."""

    def answer(messages: pa.Table) -> pa.Table:
        rows = messages.to_pylist()
        values = [rice_decode(r["n"], r["rice"], r["ones"], r["low"]) for r in rows]
        again = [np.unpackbits(np.frombuffer(r["again"], np.uint8))[: r["n"]] for r in rows]
        distinct, back, counts = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
        shared = counts > 1
        shared[back[np.concatenate(again) > 0]] = True
        ends = np.cumsum([len(v) for v in values])
        marks = np.split(shared[back], ends[:-1])
        out = [(r["chunk"], r["owner"], 0, np.packbits(m).tobytes()) for r, m in zip(rows, marks, strict=True) if m.any()]
        at = np.unique(distinct[shared] >> np.uint64(max(0, bits - filter_bits)))
        if len(at):
            low = int(at[0]) // 8 * 8
            area = np.zeros(int(at[-1]) - low + 1, np.uint8)
            area[(at - np.uint64(low)).astype(np.int64)] = 1
            out.append((low // 8, rows[0]["owner"], 1, np.packbits(area).tobytes()))
        chunk, owner, kind, bitmap = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.table(
            {
                "chunk": pa.array(chunk, pa.int64()),
                "owner": pa.array(owner, pa.int32()),
                "kind": pa.array(kind, pa.int32()),
                "bitmap": pa.array(bitmap, pa.binary()),
            }
        )

    return answer


def _suspect_texts(shared, bits: int, filter_bits: int):
    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        area = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            texts = _normal(batch.column(0))
            digests = [hashlib.sha256(raw).digest() for raw in texts]
            at = _heads(digests, bits) >> np.uint64(max(0, bits - filter_bits))
            hit = (area[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7)).astype(np.uint8))) & 1
            keep = np.flatnonzero(hit)
            yield pa.RecordBatch.from_arrays(
                [pa.array([digests[i] for i in keep], pa.binary()), pa.array([texts[i] for i in keep], pa.binary())],
                ["digest", "body"],
            )

    return fetch


def exact_dedup(
    docs: DataFrame,
    fingerprint_bits: int = FINGERPRINT_BITS,
    owners: int | None = None,
    chunk_rows: int = CHUNK_ROWS,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``."""
    spark = docs.sparkSession
    owners = owners or max(shuffle_partitions(spark), docs.count() // OWNER_ROWS + 1)
    filter_bits = min(filter_bits, fingerprint_bits)
    scratch = Scratch(spark, "exact-dedup")
    schema = _PRINTS.format(id=docs.schema["doc_id"].dataType.simpleString())

    sent = scratch.keep(
        docs.select("doc_id", "text").mapInArrow(_print_rows(owners, fingerprint_bits, chunk_rows), schema), "prints"
    )
    messages = sent.filter("n IS NOT NULL").select("chunk", "owner", "n", "rice", "ones", "low", "again")
    answers = scratch.keep(
        messages.groupBy("owner").applyInArrow(
            _answer(fingerprint_bits, filter_bits), "chunk long, owner int, kind int, bitmap binary"
        ),
        "answers",
    )

    # The filter has a fixed size, whatever the owners found.
    area = bytearray(((1 << filter_bits) + 7) // 8)
    for part in answers.filter("kind = 1").select("chunk", "bitmap").toLocalIterator():
        at, bits = part["chunk"], part["bitmap"]
        old = int.from_bytes(area[at : at + len(bits)])
        area[at : at + len(bits)] = (old | int.from_bytes(bits)).to_bytes(len(bits))
    shared = spark.sparkContext.broadcast(bytes(area))

    byte = "conv(hex(substring(bitmap, slot DIV 8 + 1, 1)), 16, 10)"
    marked = scratch.keep(
        sent.filter("slot IS NOT NULL")
        .join(answers.filter("kind = 0").select("chunk", "owner", "bitmap"), ["chunk", "owner"], "left")
        .select(
            "chunk",
            "seq",
            "doc_id",
            "n_chars",
            "digest",
            F.expr(f"coalesce(shiftright(cast({byte} AS int), 7 - slot % 8) & 1, 0) = 1").alias("suspect"),
        ),
        "marked",
    )
    scratch.drop(sent, answers)

    row = F.struct((-F.col("n_chars")).alias("c"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "chunk", "seq")
    groups = marked.filter("suspect").groupBy("digest").agg(F.count("*").alias("n"), F.min(row).alias("first"))
    bodies = docs.select("text").mapInArrow(
        _suspect_texts(shared, fingerprint_bits, filter_bits), "digest binary, body binary"
    )
    same = bodies.groupBy("digest").agg(F.min("body").alias("low"), F.max("body").alias("high"), F.count("*").alias("seen"))
    checked = scratch.keep(
        groups.filter("n > 1")
        .join(same, "digest", "left")
        .select(
            "digest",
            F.when((F.col("low") == F.col("high")) & (F.col("seen") == F.col("n")), F.col("n"))
            .otherwise(F.raise_error(F.lit("texts of one digest differ, or the input changed while it was read")))
            .alias("n"),
            "first",
        ),
        "groups",
    )

    single = F.col("n").isNull()
    return (
        marked.withColumn("key", F.when(F.col("suspect"), F.col("digest")))
        .join(checked.withColumnRenamed("digest", "key"), "key", "left")
        .select(
            "doc_id",
            F.when(single, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
            F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
            (single | ((F.col("first.chunk") == F.col("chunk")) & (F.col("first.seq") == F.col("seq")))).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )
