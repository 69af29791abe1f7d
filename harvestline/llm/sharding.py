"""Operator 4: sharding by extendible hashing.

A directory of hash prefixes says which shard a document is in.  It starts with
as many bits as would give shards of half the limit if all were even; a bucket
over its byte limit splits on the next bit, and only such buckets do, round by
round, until every shard fits.  A round reads only the rows of buckets that were
still too large.

The hash has 40 bits of the document (id and text) and then 23 of the row, so
that rows repeated without end still split.  A document larger than the limit
can't be split: it has a shard of its own, ``oversized``, named by its whole hash,
so that nothing else has to split around it.

Null or empty text has 0 bytes.  A null ``doc_id`` is hashed like any value.  An
empty table gives no shards.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestline.llm.common import Scratch

HASH_BITS = 63


def _prefix(depth: int) -> Column:
    """The first ``depth`` bits of the hash, as a number."""
    return F.shiftright("hash", HASH_BITS - depth) if depth else F.lit(0).cast("long")


def shard_documents(docs: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """``(placed, directory)``: a row a document, and a row a shard.

    ``placed``: ``doc_id, n_bytes, shard, depth``; ``directory``: ``shard, depth,
    shard_bytes, n_docs, oversized``.  ``shard`` is the prefix as text of 0 and 1.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    text = F.coalesce("text", F.lit(""))
    row = F.xxhash64(F.monotonically_increasing_id(), F.lit(3))
    key = F.xxhash64("doc_id", F.isnull("doc_id"), text)
    mask40, mask23 = (1 << 40) - 1, (1 << 23) - 1
    hashed = F.shiftleft(key.bitwiseAND(F.lit(mask40)), 23).bitwiseOR(row.bitwiseAND(F.lit(mask23)))
    every = scratch.keep(
        docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), hashed.alias("hash")), "rows"
    )
    bits = lambda prefix, depth: F.lpad(F.conv(prefix.cast("string"), 10, 2), depth, "0") if depth else F.lit("")
    large = every.filter(F.col("n_bytes") > limit).withColumn("shard", bits(F.col("hash"), HASH_BITS))
    done = [large.select("doc_id", "n_bytes", "shard", F.lit(HASH_BITS).alias("depth"))]
    per_shard = large.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("n_docs"))
    sizes = [per_shard.select("shard", F.lit(HASH_BITS).alias("depth"), "shard_bytes", "n_docs", F.lit(True).alias("oversized"))]
    active = every.filter(F.col("n_bytes") <= limit)
    total = active.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    depth = (2 * total // max(1, limit)).bit_length()
    while True:
        at = active.withColumn("prefix", _prefix(depth))
        buckets = scratch.keep(
            at.groupBy("prefix").agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("n_docs")), f"bits-{depth}"
        )
        # A full hash can't be split.
        over = (F.col("shard_bytes") > limit) & F.lit(depth < HASH_BITS)
        shown = bits(F.col("prefix"), depth)
        fits = buckets.filter(~over)
        sizes.append(
            fits.select(
                shown.alias("shard"),
                F.lit(depth).alias("depth"),
                "shard_bytes",
                "n_docs",
                (F.col("shard_bytes") > limit).alias("oversized"),
            )
        )
        placed = at.join(fits.select("prefix"), "prefix", "left_semi")
        done.append(placed.select("doc_id", "n_bytes", shown.alias("shard"), F.lit(depth).alias("depth")))
        if buckets.filter(over).isEmpty():
            break
        active = scratch.keep(at.join(buckets.filter(over).select("prefix"), "prefix", "left_semi").drop("prefix"), "over")
        depth += 1
    unite = lambda parts: parts[0] if len(parts) == 1 else unite(parts[:-1]).unionByName(parts[-1])
    return unite(done), unite(sizes)


def shard_report(docs: DataFrame, limit: int) -> DataFrame:
    """``doc_id, n_bytes, shard, depth, shard_bytes, n_docs, oversized`` for every row."""
    placed, directory = shard_documents(docs, limit)
    return placed.join(directory.drop("depth"), "shard")
