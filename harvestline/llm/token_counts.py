"""Operator 3: token counts by a two-tier look-up on the map side.

First tier: a table of the corpus's frequent pre-tokens and their token counts,
of a fixed number of entries, broadcast.  Second tier: pre-tokens that miss it
are encoded in the worker that meets them and remembered there, up to a fixed
number.  No pre-token is ever shuffled; a count is a sum of look-ups over the
whole text.

The frequent ones come from a pass over all texts.  Each task counts its own with
bounded memory and gives one summary row; summaries are merged level by level, a
fixed number at a time.  What is in the table changes speed only, never a count.
Pre-tokens longer than ``LONGEST`` are neither counted nor remembered, so what a
task, a worker and the driver hold is bounded in bytes.

Null or empty text: 0 bytes, 0 tokens.  Repeated rows give repeated results, an
empty table an empty result.  Other columns of the input are not read, so their
names can't clash.  A null ``doc_id`` stays null.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestline.llm.common import Scratch, texts_of
from harvestline.llm.tokenizer import LONGEST, Generations, count_cache, encoder

FREQUENT = 65_536  # entries of the broadcast table
SUMMARY = 32_768  # pre-tokens in a task's summary
_COUNTED = 262_144  # pre-tokens a task counts before it drops its rarest
_FAN = 32  # summaries merged by one task
_MERGERS = 16  # summaries that reach the driver

_caches: dict[tuple[str, str], Generations] = {}


def _summarise(tokenizer_path: str):
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = encoder(tokenizer_path).keys, Counter()
        for batch in batches:
            for text in texts_of(batch.column(0)):
                counts.update(key for key in keys(text) if len(key) <= LONGEST)
            if len(counts) > _COUNTED:
                counts = Counter(dict(counts.most_common(SUMMARY)))
        top = counts.most_common(SUMMARY)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([TaskContext.get().partitionId()], pa.int32()),
                pa.array([[key for key, _ in top]], pa.list_(pa.string())),
                pa.array([[n for _, n in top]], pa.list_(pa.int64())),
            ],
            ["part", "keys", "counts"],
        )

    return summarise


def _merge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    counts: Counter[str] = Counter()
    for names, n in zip(frame["keys"], frame["counts"], strict=True):
        for name, k in zip(names, n, strict=True):
            counts[name] += int(k)
        if len(counts) > _COUNTED:
            counts = Counter(dict(counts.most_common(SUMMARY)))
    top = counts.most_common(SUMMARY)
    return pd.DataFrame({"part": [key[0]], "keys": [[name for name, _ in top]], "counts": [[n for _, n in top]]})


def frequent_keys(docs: DataFrame, tokenizer_path: str, size: int = FREQUENT) -> list[str]:
    """At most ``size`` of the pre-tokens that are most frequent in all texts.

    Summaries merge ``_FAN`` at a time, level by level, until the driver receives
    no more than ``_MERGERS`` of them.
    """
    scratch = Scratch(docs.sparkSession, "token-counts")
    schema = "part int, keys array<string>, counts array<long>"
    parts = scratch.keep(docs.select("text").mapInArrow(_summarise(tokenizer_path), schema), "summaries")
    while parts.count() > _MERGERS:
        group = F.floor(F.col("part") / _FAN).cast("int")
        merged = scratch.keep(parts.groupBy(group.alias("part")).applyInPandas(_merge, schema), "merged")
        scratch.drop(parts)
        parts = merged
    total: Counter[str] = Counter()
    for row in parts.collect():
        total.update(dict(zip(row["keys"], row["counts"], strict=True)))
    scratch.drop(parts)
    return [key for key, _ in total.most_common(size)]


def _cache(path: str, run: str, shared) -> Generations:
    key = (path, run)
    if key not in _caches:
        names, lengths = shared.value
        frequent = dict(zip(names.split("\n"), lengths, strict=True)) if lengths else {}
        _caches.clear()
        _caches[key] = count_cache(path, frequent)
    return _caches[key]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048, frequent: int = FREQUENT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``."""
    spark = docs.sparkSession
    encode = encoder(tokenizer_path)
    names = [key for key in frequent_keys(docs, tokenizer_path, frequent) if "\n" not in key]
    shared = spark.sparkContext.broadcast(("\n".join(names), [encode.count(name) for name in names]))

    run = uuid.uuid4().hex

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, look_up = encoder(tokenizer_path).keys, _cache(tokenizer_path, run, shared).__getitem__
        for batch in batches:
            sizes, tokens = [], []
            for text in texts_of(batch.column(1)):
                sizes.append(len(text.encode()))
                tokens.append(sum(map(look_up, keys(text))))
            over = [n > limit for n in tokens]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array(over, pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        count, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"
    )
