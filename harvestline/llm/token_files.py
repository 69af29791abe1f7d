"""Operator 8: token ids as binary files of Simple-8b words.

A 64-bit word holds a selector in its top 4 bits and 60 bits of payload.  The
selector names how many ids the word packs and how wide each is: 60 of 1 bit, 30
of 2, 20 of 3 and so on to 1 of 60 (``COUNTS``).  Selector 15 is an escape: its
payload is the place of one id in the block's side list, for ids wider than 60
bits; ids are below 2**32 here, so only a caller's own values can need it.

A block holds the ids of consecutive documents and decodes alone:

    magic "S8B1" | n_ids u32 | n_words u32 | n_escapes u32 | words u64... | escapes u64...

little-endian throughout.  Decoding is vectorised: all selectors are read at
once, a running sum of their counts is where each word's ids go, and the words
of one selector unpack together.

The files are Parquet, one row a block, so that Spark commits them task by task
and a lost executor leaves no half file.  Columns: ``shard`` (number of the range
of doc_id, ascending), ``block`` (in the shard), ``first_id`` (ids before the
block in its shard), ``doc_ids``, ``lengths`` (ids of each document, end id
included) and ``data``.  A manifest beside them, one row a shard, has the ids
before each shard in the whole corpus.

Null or empty text: only the end id.  Null ``doc_id`` sorts first.  Documents
with equal ``doc_id`` are written one after the other, ordered by text.  An empty
table gives no blocks.  Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harvestline.llm.common import shuffle_partitions, texts_of
from harvestline.llm.tokenizer import encoder, id_cache

# ids in a word and their width, by selector.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0, 1])
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0, 60])
_PACKING = range(14)
ESCAPE = 15
_MAGIC = 0x31423853  # "S8B1"
BLOCK_IDS = 65_536

BLOCKS = "shard int, block int, first_id long, doc_ids array<{id}>, lengths array<long>, data binary"


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs, 1 at least; exact for all 64-bit values."""
    low = np.frexp((values & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    high = values >> np.uint64(32)
    bits = np.where(high > 0, 32 + np.frexp(high.astype(np.float64))[1], low) if high.any() else low
    return np.maximum(bits, 1).astype(np.uint8)


def _selectors(values: np.ndarray) -> np.ndarray:
    """For each place, the selector that packs most ids from there on."""
    n = len(values)
    # widest[k][i]: largest of bits[i : i + k]; past the end nothing fits.
    widest = {1: np.concatenate([_bits(values), np.full(60, 255, np.uint8)])}
    chosen = np.full(n, ESCAPE, np.uint8)
    for s in reversed(_PACKING):
        k = int(COUNTS[s])
        if k not in widest:
            half = max(j for j in widest if j < k)
            rest = min(j for j in widest if j >= k - half)
            a, b = widest[half], widest[rest]
            # The two windows may overlap, which a maximum doesn't mind.
            shift = k - rest
            widest[k] = np.maximum(a[: len(b) - shift], b[shift:][: len(a)]) if shift else b
        window = widest[k]
        fits = np.zeros(n, bool)
        m = min(n, len(window))
        fits[:m] = window[:m] <= WIDTHS[s]
        np.putmask(chosen, fits, np.uint8(s))
    return chosen


def encode_block(values: np.ndarray) -> bytes:
    """A block of unsigned 64-bit values."""
    values = np.ascontiguousarray(values, np.uint64)
    chosen = _selectors(values)
    steps = COUNTS[chosen].tolist()
    starts, at, end = [], 0, len(values)
    while at < end:
        starts.append(at)
        at += steps[at]
    starts = np.array(starts, np.int64)
    selectors = chosen[starts] if len(starts) else np.zeros(0, np.uint8)
    words = selectors.astype(np.uint64) << np.uint64(60)
    for s in _PACKING:
        here = np.flatnonzero(selectors == s)
        first = starts[here]
        for k in range(int(COUNTS[s])):
            words[here] |= values[first + k] << np.uint64(k * int(WIDTHS[s]))
    odd = np.flatnonzero(selectors == ESCAPE)
    words[odd] |= np.arange(len(odd), dtype=np.uint64)
    head = np.array([_MAGIC, len(values), len(words), len(odd)], "<u4")
    return head.tobytes() + words.astype("<u8").tobytes() + values[starts[odd]].astype("<u8").tobytes()


def decode_block(data: bytes) -> np.ndarray:
    """The values of a block, as unsigned 64-bit integers."""
    magic, n, n_words, n_escapes = np.frombuffer(data, "<u4", 4).tolist()
    if magic != _MAGIC:
        raise ValueError("not a block of token ids")
    words = np.frombuffer(data, "<u8", n_words, 16)
    escapes = np.frombuffer(data, "<u8", n_escapes, 16 + 8 * n_words)
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selectors]
    to = np.cumsum(counts) - counts
    out = np.zeros(n, np.uint64)
    for s in _PACKING:
        here = np.flatnonzero(selectors == s)
        if len(here):
            width, mask = np.uint64(WIDTHS[s]), np.uint64((1 << int(WIDTHS[s])) - 1)
            own, first = words[here], to[here]
            for k in range(int(COUNTS[s])):
                out[first + k] = (own >> (np.uint64(k) * width)) & mask
    odd = np.flatnonzero(selectors == ESCAPE)
    out[to[odd]] = escapes[(words[odd] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out


def _encode(tokenizer_path: str, end_id: int, id_type: pa.DataType):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, look_up = encoder(tokenizer_path).keys, id_cache(tokenizer_path).__getitem__
        end = np.array([end_id], "<u4").tobytes()
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        doc_ids, lengths, parts, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            data = encode_block(np.frombuffer(b"".join(parts), "<u4"))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()),
                    pa.array([block], pa.int32()),
                    pa.array([before], pa.int64()),
                    pa.array([doc_ids], pa.list_(id_type)),
                    pa.array([lengths], pa.list_(pa.int64())),
                    pa.array([data], pa.binary()),
                ],
                ["shard", "block", "first_id", "doc_ids", "lengths", "data"],
            )

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for doc_id, text in zip(ids, texts_of(batch.column(1)), strict=True):
                packed = b"".join(map(look_up, keys(text))) + end
                doc_ids.append(doc_id)
                lengths.append(len(packed) // 4)
                parts.append(packed)
                held += len(packed) // 4
                if held >= BLOCK_IDS:
                    yield flush()
                    block, before = block + 1, before + held
                    doc_ids, lengths, parts, held = [], [], [], 0
        if doc_ids:
            yield flush()

    return encode


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, shards: int | None = None) -> None:
    """Write the ids of every document under ``path`` in ascending ``doc_id`` order."""
    spark = docs.sparkSession
    shards = shards or shuffle_partitions(spark)
    kind = docs.schema["doc_id"].dataType
    id_type = pa.int64() if kind.simpleString() in ("bigint", "int") else pa.string()
    kind = "bigint" if id_type == pa.int64() else "string"
    ordered = (
        docs.select(F.col("doc_id").cast(kind).alias("doc_id"), "text")
        .repartitionByRange(shards, "doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    blocks = ordered.mapInArrow(_encode(tokenizer_path, end_id, id_type), BLOCKS.format(id=kind))
    # Packed words hardly compress; the light codec saves the id and length columns.
    blocks.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/blocks")
    sums = spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(
        F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b)).alias("n_ids")
    )
    # One row a shard: as many as there are tasks, not documents.
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    manifest = sums.withColumn("start", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks with ``start``: the ids of all documents before each."""
    blocks = spark.read.parquet(f"{path}/blocks")
    manifest = spark.read.parquet(f"{path}/manifest").select("shard", F.col("start").alias("shard_start"))
    return blocks.join(manifest, "shard").withColumn("start", F.col("shard_start") + F.col("first_id"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out_ids, starts, lengths, sums = [], [], [], []
        for doc_ids, n_ids, start, data in zip(*(batch.column(k) for k in range(4)), strict=True):
            raw, at = decode_block(data.as_py()).astype("<u4").tobytes(), start.as_py()
            done = 0
            for doc_id, n in zip(doc_ids.as_py(), n_ids.as_py(), strict=True):
                out_ids.append(doc_id)
                starts.append(at + done)
                lengths.append(n)
                sums.append(zlib.crc32(raw[4 * done : 4 * (done + n)]))
                done += n
        yield pa.RecordBatch.from_arrays(
            [pa.array(out_ids, batch.column(0).type.value_type), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums))],
            ["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, decoded from the files."""
    blocks = read_blocks(spark, path).select("doc_ids", "lengths", "start", "data")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    return blocks.mapInArrow(_digest, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
