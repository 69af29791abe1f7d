"""Operator 5: near-duplicate documents by b-bit MinHash.

1. A task turns each text into its set of word shingles, hashed to 64 bits, and
   ``HASHES`` minima.  Documents with the same set are one node from here on, so
   exact copies, however many, are one row.
2. The full minima make ``BANDS`` band keys.  Only the lowest ``BITS`` bits of each
   are retained, packed in four 64-bit words.
3. Nodes that share a band key are candidates.  The signatures' equal positions
   are counted in bits, and the similarity, corrected for the chance ``2**-BITS``
   of equal bits, must be within five standard errors of the threshold.
4. Candidates are confirmed on their full sets.

No group is spelled out in pairs.  A node is compared to its bucket's leader, the
most similar leader over all bands; then, if it is not in the largest component
of a bucket, to one random node of that, another in each band and round.  Links make
components (alternating large and small stars).  What is then still outside is
compared to all other components of its buckets, but for pairs that can't be
linked: a shingle that no other set has is in no intersection, and of each class
of shingles an intersection has no more than the smaller count, which rules out
most copies with edits of their own.  So no link that a band shows is lost.
With four rows a band, a pair at similarity 0.8 misses all bands once in 2 * 10**7.

A document without words or text has no shingles and is linked with nothing.
With fewer words than a shingle has, the whole sequence is the only one.  A null
``doc_id`` names no component with an id in it (``component_id`` is null where
there is none), and repeated rows are members like any other.  An empty table gives an empty result.  Columns with
clashing names are left as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestline.llm.common import SPACE_BYTES, Scratch, sized

HASHES, BANDS, BITS = 128, 32, 2
ROWS = HASHES // BANDS
FILTER_BITS = 26
CLASSES = 24  # of shingles, to bound intersections by
ROUNDS = 1  # of random partners before what is left is compared one by one
_LINKS = 100_000  # links that a task takes at least
_PAIRS = 1_000  # pairs of sets that a task compares at least
_SEGMENT = 1 << 18  # bytes hashed at a time
_BLOCK = 8192  # shingles taken through the minima at a time

_random = np.random.default_rng(20_240_501)
_BYTE = _random.integers(1, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = _random.integers(1, 2**63, 64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLY = (_random.integers(0, 2**31, HASHES) * 2 + 1).astype(np.uint32)[:, None]
_ADD = _random.integers(0, 2**32, HASHES).astype(np.uint32)[:, None]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE_BYTES)] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _segment_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word."""
    data = np.frombuffer(raw, np.uint8)
    word = ~_IS_SPACE[data]
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    lengths = ends - starts
    powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(int(lengths.max()), _BASE))])
    letters = data[word]
    at = np.cumsum(lengths) - lengths
    place = np.arange(len(letters)) - np.repeat(at, lengths)
    sums = np.add.reduceat(_BYTE[letters] * powers[place], at)
    return _mix(sums + lengths.astype(np.uint64)), starts


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after the other, and where each text's begin (with the end)."""
    hashes, counts = [], []
    group, size = [], 0

    def flush() -> None:
        if group:
            found, starts = _segment_hashes(b" ".join(group).lower())
            begin = np.cumsum([0] + [len(g) + 1 for g in group])
            counts.append(np.diff(np.searchsorted(starts, begin)))
            hashes.append(found)

    for text in texts:
        if len(text) > _SEGMENT:
            flush()
            group, size = [], 0
            total, at = 0, 0
            while at < len(text):
                end = at + _SEGMENT
                while end < len(text) and text[end] not in SPACE_BYTES:
                    end += 1
                found, _ = _segment_hashes(text[at:end].lower())
                hashes.append(found)
                total, at = total + len(found), end
            counts.append(np.array([total]))
            continue
        group.append(text)
        size += len(text)
        if size >= _SEGMENT:
            flush()
            group, size = [], 0
    flush()
    every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return every, np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)


def shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, begin = word_hashes(texts)
    n = max(0, len(words) - k + 1)
    rolled = np.zeros(n, np.uint64)
    for j in range(k):
        rolled += words[j : j + n] * _STEP[j]
    rolled = _mix(rolled)
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(rolled[a : b - k + 1])
        elif b > a:
            short = words[a:b] * _STEP[: b - a]
            yield _mix(np.array([short.sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set that isn't empty."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), _BLOCK):
        np.minimum(least, (_MULTIPLY * x[None, at : at + _BLOCK] + _ADD).min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    keys = np.arange(BANDS, dtype=np.uint64) << np.uint64(40)
    for j in range(ROWS):
        keys = _mix(keys * _STEP[j] + rows[:, j])
    return keys.view(np.int64)


def low_bits(least: np.ndarray) -> np.ndarray:
    """The retained bits of all minima, packed."""
    # A linear hash's lowest bits are weak; the mixed value's are not.
    low = _mix(least.astype(np.uint64)) & np.uint64((1 << BITS) - 1)
    per_word = 64 // BITS
    shifts = np.arange(per_word, dtype=np.uint64) * np.uint64(BITS)
    return np.bitwise_or.reduce(low.reshape(-1, per_word) << shifts, axis=1).view(np.int64)


def _bytes(column: pa.Array) -> list[bytes]:
    return [raw or b"" for raw in column.cast(pa.binary()).to_pylist()]


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sketch(k: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, bands, packed = [], [], [], []
            for shingles in shingle_sets(_bytes(batch.column(1)), k):
                sizes.append(len(shingles))
                if len(shingles):
                    least = minima(shingles)
                    nodes.append(_digest(shingles))
                    bands.append(band_keys(least))
                    packed.append(low_bits(least))
                else:
                    nodes.append(None)
                    bands.append(None)
                    packed.append(None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(nodes, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array(packed, pa.list_(pa.int64())),
                ],
                ["row", "n_shingles", "node", "bands", "bits"],
            )

    return sketch


def _wanted_sets(k: int, shared):
    """Sets of the texts whose node may be wanted, once a batch."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            found: dict[bytes, np.ndarray] = {}
            for shingles in shingle_sets(_bytes(batch.column(0)), k):
                if len(shingles):
                    node = _digest(shingles)
                    at = int.from_bytes(node[:8]) >> (64 - FILTER_BITS)
                    if wanted[at >> 3] >> (at & 7) & 1:
                        found[node] = shingles.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.list_(pa.int64()))], ["node", "shingles"]
            )

    return fetch


def _confirm(least: int, of: int):
    """Pairs with ``of * intersection >= least * union``."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = []
            for i in range(batch.num_rows):
                a, b = (side[i].values.to_numpy() for side in (left, right))
                both = np.intersect1d(a, b, assume_unique=True).size
                if of * both >= least * (len(a) + len(b) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(keep, pa.int64())) for k in (0, 1)], ["a", "b"])

    return confirm


def _equal_positions(a: str, b: str) -> Column:
    """Positions of two packed signatures whose retained bits agree."""
    differ = []
    for w in range(HASHES * BITS // 64):
        x = F.get(a, F.lit(w)).bitwiseXOR(F.get(b, F.lit(w)))
        some = x
        for s in range(1, BITS):
            some = some.bitwiseOR(F.shiftrightunsigned(x, s))
        low = sum(1 << (BITS * i) for i in range(64 // BITS))
        differ.append(F.bit_count(some.bitwiseAND(F.lit(low - (1 << 64) if low >= 1 << 63 else low))))
    total = differ[0]
    for d in differ[1:]:
        total = total + d
    return F.lit(HASHES) - total


def _estimate(equal: Column) -> Column:
    """Similarity without the share of positions that are equal by chance."""
    chance = 2.0**-BITS
    return (equal / HASHES - chance) / (1 - chance)


def _near(threshold: float) -> float:
    """The estimate that a pair at the threshold reaches but for five standard errors."""
    chance = 2.0**-BITS
    p = chance + (1 - chance) * threshold
    return threshold - 5 * (p * (1 - p) / HASHES) ** 0.5 / (1 - chance)


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, root`` for every node of undirected ``links`` (a, b): the least node it is connected to.

    Each round reads its links in partitions of their own number, so few links are a matter of one task.
    """
    here, there = F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
    edges = scratch.keep(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges"
    )
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
        few = sized(edges, now[0], _LINKS)
        both = few.select(F.explode(F.array(here, there)).alias("e")).select("e.a", "e.b")
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        # Large star: neighbours above a node go to the least of its neighbourhood.
        large = scratch.keep(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")), "large")
        scratch.drop(edges)
        # Small star: a node and its neighbours below go to the least of them.
        few = sized(large, now[0], _LINKS)
        least = few.groupBy("a").agg(F.min("b").alias("m"))
        small = few.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        edges = scratch.keep(small.filter("a <> b").distinct(), "edges")
        scratch.drop(large)


def _filter_bytes(nodes: DataFrame) -> bytes:
    """A bitmap of fixed size of the nodes' first bits."""
    at = F.conv(F.hex(F.substring("node", 1, 4)), 16, 10).cast("long")
    bit = F.shiftright(at, 32 - FILTER_BITS) + 1
    # Spark's bitmaps are of 32,768 bits each.
    parts = nodes.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket"))
    area = bytearray((1 << FILTER_BITS) // 8)
    # 8 MB at most, in one job; an iterator would run one for each partition.
    for row in parts.agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect():
        begin = (row["bucket"] - 1) * 4096
        area[begin : begin + 4096] = row["bits"]
    return bytes(area)


def _within_reach(nodes: DataFrame) -> DataFrame:
    """``node, size, shared, spread``: a set's size, and how many of its shingles another of these sets has too.

    ``spread`` counts the shared ones by class (their hash modulo ``CLASSES``).
    """
    tokens = nodes.select("node", F.explode("shingles").alias("token"))
    seen = tokens.groupBy("token").agg(F.count("*").alias("n"))
    of_class = (
        tokens.join(seen.filter("n > 1"), "token")
        .groupBy("node", F.pmod("token", F.lit(CLASSES)).cast("int").alias("c"))
        .agg(F.count("*").cast("int").alias("n"))
    )
    counts = of_class.groupBy("node").agg(
        F.sum("n").alias("shared"), F.map_from_entries(F.collect_list(F.struct("c", "n"))).alias("by_class")
    )
    spread = F.transform(F.sequence(F.lit(0), F.lit(CLASSES - 1)), lambda c: F.coalesce(F.col("by_class")[c], F.lit(0)))
    return nodes.select("node", F.size("shingles").alias("size")).join(
        counts.select("node", "shared", spread.alias("spread")), "node"
    )


def _rooted(members: DataFrame, roots: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """Members with their root, and of each bucket with several roots the largest and one node of it, at random."""
    rooted = members.select("key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    each = rooted.groupBy("key", "root").agg(
        F.count("*").alias("n"), F.min_by("node", F.xxhash64("node", "key", F.lit(turn))).alias("one")
    )
    top = each.groupBy("key").agg(F.max(F.struct("n", "root", "one")).alias("top"), F.count("*").alias("roots"))
    return rooted, top.filter("roots > 1").select("key", F.col("top.root").alias("main"), F.col("top.one").alias("one"))


def near_groups(docs: DataFrame, k: int = 5, least: int = 80, of: int = 100, key: str = "doc_id") -> DataFrame:
    """``row`` (the ``key`` column), ``n_shingles``, ``group``: equal groups are near-duplicates.

    Two sets are linked if ``of * intersection >= least * union``; groups are the
    connected components.  ``group`` is null for documents without shingles.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    kind = docs.schema[key].dataType.simpleString()
    sketches = scratch.keep(
        docs.select(key, "text").mapInArrow(
            _sketch(k), f"row {kind}, n_shingles long, node binary, bands array<long>, bits array<long>"
        ),
        "sketches",
    )
    nodes = scratch.keep(
        sketches.filter("node IS NOT NULL").groupBy("node").agg(F.first("bands").alias("bands"), F.first("bits").alias("bits")),
        "nodes",
    )
    banded = nodes.select("node", F.explode("bands").alias("key"))
    buckets = scratch.keep(
        banded.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("leader")).filter("n > 1").drop("n"), "buckets"
    )
    members = scratch.keep(banded.join(buckets, "key"), "members")
    scratch.drop(buckets)
    shared = spark.sparkContext.broadcast(_filter_bytes(members.select("node")))
    sets = scratch.keep(
        docs.select("text")
        .mapInArrow(_wanted_sets(k, shared), "node binary, shingles array<long>")
        .join(members.select("node").distinct(), "node", "left_semi")
        .groupBy("node")
        .agg(F.first("shingles").alias("shingles")),
        "sets",
    )
    shared.destroy()
    signed = nodes.select("node", "bits")
    near = _near(least / of)

    def confirmed(pairs: DataFrame, step: str) -> DataFrame:
        pairs = scratch.keep(pairs.select("a", "b"), f"{step}-pairs")
        many = pairs.count()
        a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
        b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
        full = pairs.join(a, "a").join(b, "b").select("a", "b", "of_a", "of_b")
        found = scratch.keep(sized(full, many, _PAIRS).mapInArrow(_confirm(least, of), "a binary, b binary"), step)
        scratch.drop(pairs)
        return found

    def similar(pairs: DataFrame, step: str) -> DataFrame:
        a = signed.select(F.col("node").alias("a"), F.col("bits").alias("bits_a"))
        b = signed.select(F.col("node").alias("b"), F.col("bits").alias("bits_b"))
        guess = _estimate(_equal_positions("bits_a", "bits_b"))
        found = pairs.distinct().join(a, "a").join(b, "b").select("a", "b", guess.alias("similar"))
        return scratch.keep(found.filter(F.col("similar") >= near), step)

    # Each node and the most similar of its buckets' leaders.
    stars = similar(members.filter("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")), "stars")
    first = confirmed(stars.groupBy("a").agg(F.max_by("b", "similar").alias("b")), "first")
    roots = components(first, scratch)

    # Each node outside its bucket's largest component and one of that, another in each bucket and round.
    links = first
    for turn in range(ROUNDS):
        rooted, top = _rooted(members, roots, turn)
        outside = rooted.join(top, "key").filter("root <> main").select(F.col("node").alias("a"), F.col("one").alias("b"))
        more = confirmed(similar(outside, "outside"), "more")
        if more.isEmpty():
            break
        links = links.unionByName(more)
        roots = components(links, scratch)

    # What is left: nodes outside their bucket's largest component and all of other components.
    rooted, top = _rooted(members, roots, ROUNDS)
    loose = scratch.keep(rooted.join(top.drop("one"), "key"), "loose")
    reach = _within_reach(sets.join(loose.select("node").distinct(), "node", "left_semi"))
    side = scratch.keep(
        loose.join(reach.filter(of * F.col("shared") >= least * F.col("size")), "node").join(nodes, "node"), "reach"
    )
    names = ("node", "root", "bands", "bits", "size", "shared", "spread")
    left = side.filter("root <> main").select("key", *(F.col(n).alias(f"{n}_a") for n in names))
    right = side.select("key", (F.col("root") == F.col("main")).alias("in_main"), *(F.col(n).alias(f"{n}_b") for n in names))
    total = F.col("size_a") + F.col("size_b")
    # No intersection is larger than the smaller of the two counts, nor than their sum class by class.
    most = F.least("shared_a", "shared_b")
    in_class = [F.least(F.get("spread_a", F.lit(c)), F.get("spread_b", F.lit(c))) for c in range(CLASSES)]
    least_sum = reduce(lambda x, y: x + y, in_class)
    common = F.array_position(F.zip_with("bands_a", "bands_b", lambda x, y: x == y), True)
    across = left.join(
        right,
        (left["key"] == right["key"])
        & (F.col("root_a") != F.col("root_b"))
        & (F.col("in_main") | (F.col("node_a") > F.col("node_b")))
        & (of * most >= least * (total - most))
        & (_estimate(_equal_positions("bits_a", "bits_b")) >= near)
        & (of * least_sum >= least * (total - least_sum))
        & (F.element_at("bands_a", common.cast("int")) == left["key"]),
    ).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    last = confirmed(across, "last")
    roots = components(links.unionByName(last), scratch)
    scratch.drop(members, sets, loose, side, stars, nodes)
    return sketches.join(roots, "node", "left").select("row", "n_shingles", F.coalesce("root", "node").alias("group"))


def near_report(docs: DataFrame, k: int = 3, least: int = 85, of: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row."""
    found = Scratch(docs.sparkSession, "near-dedup").keep(near_groups(docs, k, least, of), "groups")
    first = found.filter("group IS NOT NULL").groupBy("group").agg(F.min("row").alias("first"))
    component = F.coalesce("first", "row")
    return found.join(first, "group", "left").select(
        F.col("row").alias("doc_id"),
        "n_shingles",
        component.alias("component_id"),
        F.col("row").eqNullSafe(component).alias("kept"),
    )


def near_dedup(docs: DataFrame, k: int = 5, least: int = 80, of: int = 100) -> DataFrame:
    """``docs`` with one document of each group: the smallest ``doc_id``, null last.

    Documents without shingles stay.  Of rows with equal ``doc_id`` and text one stays.
    """
    scratch = Scratch(docs.sparkSession, "near-dedup")
    text_key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    named = docs.select(F.struct("doc_id", text_key.alias("text_key")).alias("id"), "text")
    found = scratch.keep(near_groups(named, k, least, of, key="id"), "groups")
    order = F.struct(F.col("row.doc_id").isNull().alias("no_id"), F.col("row.doc_id").alias("doc_id"), F.col("row.text_key").alias("k"))
    first = found.filter("group IS NOT NULL").groupBy("group").agg(F.min(order).alias("first"))
    gone = found.join(first, "group").filter(
        ~(F.col("row.doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row.text_key") == F.col("first.k")))
    )
    gone = scratch.keep(gone.select(F.col("row").alias("_of")).distinct(), "gone")
    same = lambda of: docs["doc_id"].eqNullSafe(of["_of"]["doc_id"]) & (text_key == of["_of"]["text_key"])
    kept = docs.join(gone, same(gone), "left_anti")
    again = scratch.keep(
        found.filter("group IS NOT NULL").groupBy(F.col("row").alias("_of")).count().filter("count > 1").select("_of"), "again"
    )
    if again.isEmpty():
        return kept
    repeated = docs.join(again, same(again), "left_semi").join(gone, same(gone), "left_anti")
    one = repeated.withColumn("__text_key", text_key).dropDuplicates(["doc_id", "__text_key"]).drop("__text_key")
    return kept.join(again, same(again), "left_anti").unionByName(one)
