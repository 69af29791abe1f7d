"""Operator 13: which documents' n-gram sets are similar, exactly, by partitioning the universe of grams.

Two sets of a and b grams with ``of * intersection >= least * union`` differ in at
most ``H = (of - least) * (a + b) / (of + least)`` grams.

1. A text becomes its set of gram hashes.  Equal sets are one node.
2. Sizes fall into bands.  A band's space cuts the universe of grams into enough
   segments, by hash, and a set falls apart into its segment subsets, each with a
   hash that is the sum of its grams'.  Sets of the next band that can be similar
   to one in this band are in its space too, so all pairs meet in one space.
3. A set may spend 0, 1 or 2 on each segment of a space, ``H + 1`` in all.  If it
   differs in at most H grams from another, then in some segment it differs by less
   than it spent there (pigeonhole): not at all where it spent 1; by at most one gram
   where it spent 2, so that one subset is the other with one deletion or equal.
   What it spends is chosen by cost, the number of sets it would meet; so a segment
   whose subset half the corpus has gets 0, and rare ones get 1 or 2.
4. Sets met are compared by sketch, then in full.  A sketch has a bit for each of
   many buckets: whether an odd number of the set's grams are in it.  Sketches that
   differ in more than H bits are of sets that differ in more than H grams, so none
   that are similar are lost, and most grams are never moved.  Links make components.

No group is spelled out in pairs.  First each node is compared with one other: of
the centres of its shared subsets (the node that shares most) the one it shares most
with.  That makes components, and only pairs of different components are left to
find: the node in the smaller component spends and meets nodes in larger ones.
A subset that only one component has is dropped, a node that can spend on subsets
of its own alone meets nothing, and a hot group, being one component, spends
nothing.  No link is lost: any pair not yet connected has one side that looks for it.

Sets that differ in at most H grams have all but H of a space's segments in common.
So a set is passed over, before its grams are moved, in any space where it shares no
more than that with whatever set; and by the second search where it shares no more
than that with sets of other components.

A null text is empty.  A document without words has no grams and is linked with
nothing; with fewer words than a gram has, the whole sequence is the only one.  A
null ``doc_id`` names no component with an id in it (``component_id`` is null where
there is none).  Repeated rows are rows like any other.  An empty table gives an
empty result.  Columns with clashing names are left as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestline.llm.common import Scratch
from harvestline.llm.near_dedup import components, shingle_sets

FILTER_BITS = 26  # of a bitmap of hashes that lets rows through to a join
_SHIFTS = (64 - FILTER_BITS, 19, 0)  # which bits of a hash name its places in the bitmap
_WIDEN = (3, 2)  # a band's sizes reach to this times its least
_REMEMBERED = 1 << 18  # sets a task remembers, to pass on each once
_ROWS = 1 << 16  # questions in a batch, or one set's
_PIECE = 1 << 18  # bytes of texts or sets in hand at a time


@dataclass(frozen=True)
class Similarity:
    """``of * intersection >= least * union``."""

    least: int
    of: int

    def differing(self, a: int, b: int) -> int:
        """The most grams that similar sets of these sizes differ in."""
        return (self.of - self.least) * (a + b) // (self.of + self.least)

    def largest(self, a: int) -> int:
        """The size of the largest set that can be similar to one of size a."""
        return a * self.of // self.least


@dataclass(frozen=True)
class Space:
    """The partition of the universe for the sets of one band of sizes, and those of the next that reach into it."""

    number: int
    low: int
    high: int
    rule: Similarity

    @property
    def segments(self) -> int:
        return self.rule.differing(self.high, self.rule.largest(self.high)) + 1

    @property
    def words(self) -> int:
        """64-bit words of a sketch: 32 bits for each gram that may differ."""
        return (self.segments + 1) // 2

    def spend(self, size: int) -> int:
        """What a set of this size has to spend here."""
        own = size <= self.high
        other = min(self.rule.largest(size), self.rule.largest(self.high)) if own else self.high
        return self.rule.differing(size, other) + 1


@cache
def spaces_of(size: int, rule: Similarity) -> tuple[Space, ...]:
    """The spaces that a set of this size is in; none where only equal sets are similar."""
    found, low, number = [], 1, 0
    while low <= size:
        high = max(low * _WIDEN[0] // _WIDEN[1], rule.largest(low))
        if size <= max(high, rule.largest(high)):
            space = Space(number, low, high, rule)
            if space.segments > 1:
                found.append(space)
        low, number = high + 1, number + 1
    return tuple(found)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ABOUT = [(0, pa.binary()), (1, pa.int32()), (2, pa.int32()), (3, pa.int32())]
_PLACE = np.uint64(0xD6E8FEB86659FD93)
_BUCKET = np.uint64(0x8EBC6AF09C88C6E3)
_VALUE = np.uint64(0xA0761D6478BD642F)


def _segment_starts(space: Space) -> np.ndarray:
    """Hashes of a space's empty subsets."""
    return _mix(np.arange(space.segments, dtype=np.uint64) + (np.uint64(space.number + 1) << np.uint64(40)))


def segment_hashes(grams: np.ndarray, space: Space) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each segment's subset hash; each gram's segment, and what it adds to the subset's hash."""
    segment = ((_mix(grams * _PLACE) >> np.uint64(33)) % np.uint64(space.segments)).astype(np.int64)
    value = _mix(grams + _VALUE)
    order = np.argsort(segment, kind="stable")
    present, first = np.unique(segment[order], return_index=True)
    hashes = _segment_starts(space)
    hashes[present] += np.add.reduceat(value[order], first)
    return hashes, segment, value


def sketch(grams: np.ndarray, space: Space) -> np.ndarray:
    """Parities of the buckets of a space, packed."""
    bucket = (_mix(grams * _BUCKET) >> np.uint64(33)) % np.uint64(64 * space.words)
    odd = np.bincount(bucket.astype(np.int64), minlength=64 * space.words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _pieces(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch cut into slices of ``_PIECE`` bytes of a column, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        held += size
        if held >= _PIECE or i == len(sizes) - 1:
            yield batch.slice(begin, i + 1 - begin)
            begin, held = i + 1, 0


def _grams(column: pa.Array) -> Iterator[np.ndarray]:
    for raw in column:
        yield np.frombuffer(raw.as_py(), np.uint64)


def _first_halves(nodes: list[bytes]) -> np.ndarray:
    """The first eight bytes of each node as an integer."""
    return np.frombuffer(b"".join(nodes), ">u8").astype(np.uint64)[::2]


def _ints(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array(np.concatenate(arrays).astype(np.uint64).view(np.int64) if arrays else np.zeros(0, np.int64), pa.int64())


_SETS = "size long, node binary, place long, grams binary"


def _sets(k: int, rule: Similarity):
    """Every row's size and node; of each node's rows in a task, as far as it remembers, the first has the set.

    Sets of so few grams that only equal ones are similar are left out.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, known = TaskContext.get().partitionId() << 40, set()
        for batch in batches:
            batch = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.binary())], ["row", "text"])
            for piece in _pieces(batch, 1):
                sizes, nodes, places, grams = [], [], [], []
                for found in shingle_sets([raw or b"" for raw in piece.column(1).to_pylist()], k):
                    raw = found.tobytes()
                    node = hashlib.blake2b(raw, digest_size=16).digest() if raw else None
                    new = bool(raw) and node not in known and bool(spaces_of(len(found), rule))
                    if new:
                        if len(known) >= _REMEMBERED:
                            known.clear()
                        known.add(node)
                        place += 1
                    sizes.append(len(found))
                    nodes.append(node)
                    places.append(place if new else None)
                    grams.append(raw if new else None)
                columns = (sizes, pa.int64()), (nodes, pa.binary()), (places, pa.int64()), (grams, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), *(pa.array(values, kind) for values, kind in columns)],
                    ["row", "size", "node", "place", "grams"],
                )

    return sets


def _subsets(rule: Similarity, twice):
    """``hash, bits``: each subset of each node; of nodes that ``twice`` marks, the node's first half.

    The others have one row, so that none of their subsets is met again as their own.
    """

    def subsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        area = np.frombuffer(twice.value, np.uint8)
        for batch in (piece for whole in batches for piece in _pieces(whole, 1)):
            found, many, nodes = [], [], []
            for node, grams in zip(batch.column(0).to_pylist(), _grams(batch.column(1)), strict=True):
                for space in spaces_of(len(grams), rule):
                    found.append(segment_hashes(grams, space)[0])
                    many.append(len(found[-1]))
                    nodes.append(node)
            halves = np.repeat(_first_halves(nodes), many)
            bits = pa.array(halves.view(np.int64), pa.int64(), mask=~_marked(area, halves))
            yield pa.RecordBatch.from_arrays([_ints(found), bits], ["hash", "bits"])

    return subsets


def _marked(area: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether all of a hash's bits are set in a bitmap."""
    found = np.ones(len(hashes), bool)
    for shift in _SHIFTS:
        at = (hashes >> np.uint64(shift)) & np.uint64((1 << FILTER_BITS) - 1)
        found &= (area[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


def _shared_subsets(rule: Similarity, shared):
    """``hash, space, node, slack``: the subsets that a bitmap lets through.

    ``slack`` is how many segments of the space a set of this size need not spend on.
    """

    def subsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        area = np.frombuffer(shared.value, np.uint8)
        for batch in (piece for whole in batches for piece in _pieces(whole, 1)):
            found, about = [], []
            for node, grams in zip(batch.column(0).to_pylist(), _grams(batch.column(1)), strict=True):
                for space in spaces_of(len(grams), rule):
                    hashes = segment_hashes(grams, space)[0]
                    hashes = hashes[_marked(area, hashes)]
                    found.append(hashes)
                    slack = space.segments - space.spend(len(grams))
                    about += [(space.number, node, slack)] * len(hashes)
            space, node, slack = zip(*about, strict=True) if about else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    _ints(found),
                    pa.array(space, pa.int32()),
                    pa.array(node, pa.binary()),
                    pa.array(slack, pa.int32()),
                ],
                ["hash", "space", "node", "slack"],
            )

    return subsets


def _questions(rule: Similarity):
    """``node, space, spend, segments, segment, hash, deleted``: all that a set could ask for in a space.

    Its subsets, and its subsets without one gram (``deleted``).
    """
    names = ["node", "space", "spend", "segments", "segment", "hash", "deleted"]

    def batch_of(sets: list[tuple], columns: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        many = [len(part[0]) for part in columns]
        fixed = [pa.array([s[i] for s, n in zip(sets, many, strict=True) for _ in range(n)], t) for i, t in _ABOUT]
        segment, hashes, deleted = (np.concatenate(part) for part in zip(*columns, strict=True))
        return pa.RecordBatch.from_arrays(
            [*fixed, pa.array(segment, pa.int32()), pa.array(hashes.view(np.int64), pa.int64()), pa.array(deleted, pa.bool_())], names
        )

    def questions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, columns, held = [], [], 0
        for batch in batches:
            asked = zip(batch.column(0).to_pylist(), _grams(batch.column(1)), batch.column(2).to_pylist(), strict=True)
            for node, grams, numbers in asked:
                for space in spaces_of(len(grams), rule):
                    if space.number not in numbers:
                        continue
                    hashes, segment, value = segment_hashes(grams, space)
                    sets.append((node, space.number, space.spend(len(grams)), space.segments))
                    columns.append(
                        (
                            np.concatenate([np.arange(len(hashes)), segment]),
                            np.concatenate([hashes, hashes[segment] - value]),
                            np.arange(len(hashes) + len(grams)) >= len(hashes),
                        )
                    )
                    held += len(hashes) + len(grams)
                    if held >= _ROWS:
                        yield batch_of(sets, columns)
                        sets, columns, held = [], [], 0
        if sets:
            yield batch_of(sets, columns)

    return questions


def _answers(rule: Similarity, sought, whole, without):
    """``hash, deleted, node, space``: subsets that are asked for, and subsets that are with one deletion.

    Of nodes that ``sought`` marks. ``whole`` marks the hashes that subsets may have, ``without`` those that they
    may have with a gram deleted.
    """

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = [np.frombuffer(area.value, np.uint8) for area in (whole, without)]
        for batch in (piece for some in _marked_nodes(sought)(batches) for piece in _pieces(some, 1)):
            found, deleted, nodes, numbers = [], [], [], []
            for node, grams in zip(batch.column(0).to_pylist(), _grams(batch.column(1)), strict=True):
                for space in spaces_of(len(grams), rule):
                    hashes, segment, value = segment_hashes(grams, space)
                    for kind, every in enumerate((hashes, hashes[segment] - value)):
                        hits = every[_marked(marks[kind], every)]
                        found.append(hits)
                        deleted += [bool(kind)] * len(hits)
                        nodes += [node] * len(hits)
                        numbers += [space.number] * len(hits)
            columns = (deleted, pa.bool_()), (nodes, pa.binary()), (numbers, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [_ints(found), *(pa.array(values, kind) for values, kind in columns)], ["hash", "deleted", "node", "space"]
            )

    return answers


def _answered(equal, shorter):
    """The questions that a bitmap lets through: ``equal`` those for a subset, ``shorter`` those with a gram deleted."""

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = [np.frombuffer(area.value, np.uint8) for area in (equal, shorter)]
        for batch in batches:
            hashes = batch.column("hash").to_numpy(zero_copy_only=False).view(np.uint64)
            deleted = batch.column("deleted").to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(np.where(deleted, _marked(marks[1], hashes), _marked(marks[0], hashes))))

    return answered


def _marked_hashes(shared):
    """The rows whose hash a bitmap lets through."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        area = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            hashes = batch.column("hash").to_numpy(zero_copy_only=False).view(np.uint64)
            yield batch.filter(pa.array(_marked(area, hashes)))

    return marked


def allocate(spend: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """0, 1 or 2 for each segment, ``spend`` in all or one more, from what spending 1 and 2 costs there.

    The cheapest units are taken first.  Where the second unit costs less than the
    first, both are taken together at their mean cost.
    """
    together = two < 2 * one
    first = np.where(together, two / 2, one)
    second = np.where(together, two / 2, two - one)
    segment = np.tile(np.arange(len(one)), 2)
    order = np.lexsort((np.repeat([0, 1], len(one)), segment, np.concatenate([first, second])))[:spend]
    units = np.bincount(segment[order], minlength=len(one))
    return np.where(together & (units == 1), 2, units)


def _allocations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, spaces, segments, units = [], [], [], []
        for node, space, spend, many, costs in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            one, two = np.zeros(many), np.zeros(many)
            for c in costs:
                one[c["segment"]], two[c["segment"]] = c["one"], c["two"]
            spent = allocate(spend, one, two)
            # Where nothing is met it doesn't matter what is spent.
            for segment in (c["segment"] for c in costs if spent[c["segment"]]):
                nodes.append(node)
                spaces.append(space)
                segments.append(segment)
                units.append(int(spent[segment]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.binary()), pa.array(spaces, pa.int32()), pa.array(segments, pa.int32()), pa.array(units, pa.int32())],
            ["node", "space", "segment", "units"],
        )


def _marked_nodes(shared):
    """The sets whose node a bitmap lets through."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        area = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            yield batch.filter(pa.array(_marked(area, _first_halves(batch.column(0).to_pylist()))))

    return marked


def _sketches(rule: Similarity, shared):
    """``node, space, size, bits``: the sketches of the sets whose node a bitmap lets through."""

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for some in _marked_nodes(shared)(batches) for piece in _pieces(some, 1)):
            nodes, spaces, sizes, bits = [], [], [], []
            for node, grams in zip(batch.column(0).to_pylist(), _grams(batch.column(1)), strict=True):
                for space in spaces_of(len(grams), rule):
                    nodes.append(node)
                    spaces.append(space.number)
                    sizes.append(len(grams))
                    bits.append(sketch(grams, space))
            columns = (nodes, pa.binary()), (spaces, pa.int32()), (sizes, pa.int64()), (bits, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in columns], ["node", "space", "size", "bits"])

    return sketches


def _verify(rule: Similarity):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (a, b) in enumerate(zip(_grams(batch.column(2)), _grams(batch.column(3)), strict=True)):
                both = np.intersect1d(a, b, assume_unique=True).size
                if rule.of * both >= rule.least * (len(a) + len(b) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(keep, pa.int64())) for k in (0, 1)], ["a", "b"])

    return verify


def bitmap(hashes: DataFrame) -> bytes:
    """A bitmap of fixed size with some bits set for each of one column of longs."""
    each = [F.shiftrightunsigned(hashes.columns[0], s).bitwiseAND(F.lit((1 << FILTER_BITS) - 1)) + 1 for s in _SHIFTS]
    # Spark's bitmaps are of 32,768 bits each.
    parts = hashes.select(F.explode(F.array(*each)).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket"))
    area = bytearray((1 << FILTER_BITS) // 8)
    # 8 MB at most, in one job; an iterator would run one for each partition.
    for row in parts.agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect():
        begin = (row["bucket"] - 1) * 4096
        area[begin : begin + 4096] = row["bits"]
    return bytes(area)


def _node_bits(nodes: DataFrame) -> DataFrame:
    """The first half of each node."""
    return nodes.select(F.conv(F.hex(F.substring("node", 1, 8)), 16, -10).cast("long").alias("bits"))


class _Join:
    def __init__(self, docs: DataFrame, key: str, k: int, rule: Similarity) -> None:
        self.spark, self.rule = docs.sparkSession, rule
        self.scratch = Scratch(self.spark, "jaccard-join", tidy=True)
        kind = docs.schema[key].dataType.simpleString()
        every = self.scratch.keep(docs.select(key, "text").mapInArrow(_sets(k, rule), f"row {kind}, {_SETS}"), "sets")
        sets = every.filter(F.col("place").isNotNull()).select("node", "grams")
        self.subsets = self.shared_subsets(sets)
        # From here on, only sets that can be similar to another: ``node, grams``, each node once.
        marks = self.shared(_node_bits(self.subsets.select("node")))
        self.sets = self.scratch.keep(sets.mapInArrow(_marked_nodes(marks), sets.schema).dropDuplicates(["node"]), "near")
        marks.destroy()
        self.rows = self.scratch.keep(every.select("row", "size", "node"), "rows")
        self.scratch.drop(every)

    def shared(self, hashes: DataFrame):
        return self.spark.sparkContext.broadcast(bitmap(hashes))

    def shared_subsets(self, sets: DataFrame) -> DataFrame:
        """``node, space, slack, weight, hashes``: the subsets that others have too, where they are more than slack.

        Similar sets have all but H subsets of a space in common.
        """
        twice = self.shared(_node_bits(sets.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1")))
        every = sets.mapInArrow(_subsets(self.rule, twice), "hash long, bits long")
        ends = every.groupBy("hash").agg(
            F.count("*").alias("n"), F.count("bits").alias("known"), F.min("bits").alias("least"), F.max("bits").alias("most")
        )
        several = ends.filter("n > 1 AND (n - known + int(known > 0) > 1 OR least <> most)")
        common = self.scratch.keep(several.select("hash", "n"), "common")
        twice.destroy()
        marks = self.shared(common.select("hash"))
        found = sets.mapInArrow(_shared_subsets(self.rule, marks), "hash long, space int, node binary, slack int")
        of_set = found.join(common, "hash").dropDuplicates(["hash", "node"]).groupBy("node", "space", "slack")
        near = of_set.agg(F.sum("n").alias("weight"), F.collect_list("hash").alias("hashes")).filter(F.size("hashes") > F.col("slack"))
        kept = self.scratch.keep(near, "subsets")
        marks.destroy()
        self.scratch.drop(common)
        return kept

    def sketches(self, nodes: DataFrame, step: str) -> DataFrame:
        """``node, space, size, bits`` of these nodes, and a few more."""
        marks = self.shared(_node_bits(nodes))
        found = self.sets.mapInArrow(_sketches(self.rule, marks), "node binary, space int, size long, bits array<long>")
        kept = self.scratch.keep(found, f"{step}-sketches")
        marks.destroy()
        return kept

    def may_be_similar(self) -> Column:
        """Of ``size_a, bits_a, size_b, bits_b``: not true only where the sets can't be similar."""
        differ = F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
        grams = F.aggregate(differ, F.lit(0), lambda total, n: total + n)
        least, of = self.rule.least, self.rule.of
        near = of * F.least("size_a", "size_b") >= least * F.greatest("size_a", "size_b")
        return near & ((of + least) * grams <= (of - least) * (F.col("size_a") + F.col("size_b")))

    def grams_of(self, nodes: DataFrame) -> tuple[DataFrame, Broadcast]:
        """``node, grams`` of distinct nodes, each once; and the bitmap behind it."""
        marks = self.shared(_node_bits(nodes))
        return self.sets.mapInArrow(_marked_nodes(marks), self.sets.schema).join(nodes, "node", "left_semi"), marks

    def verified(self, pairs: DataFrame, step: str) -> DataFrame:
        """The links among distinct pairs ``a, b``."""
        pairs = self.scratch.keep(pairs, f"{step}-pairs")
        nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        # Grams are dealt by node once, for both sides; what moves again is one set a pair.
        grams, marks = self.grams_of(self.scratch.keep(nodes, f"{step}-nodes"))
        a = grams.select(F.col("node").alias("a"), F.col("grams").alias("of_a"))
        b = grams.select(F.col("node").alias("b"), F.col("grams").alias("of_b"))
        full = pairs.join(a, "a").join(b, "b").select("a", "b", "of_a", "of_b")
        links = self.scratch.keep(full.mapInArrow(_verify(self.rule), "a binary, b binary"), step)
        marks.destroy()
        self.scratch.drop(pairs)
        return links

    def first_links(self) -> DataFrame:
        """Each node and, of the centres of its subsets, the one it shares most with, if they are linked."""
        each = self.subsets.select("node", "space", "slack", "weight", F.explode("hashes").alias("hash"))
        centres = each.groupBy("hash").agg(F.max_by("node", F.struct("weight", "node")).alias("centre"))
        met = each.drop("weight").join(centres, "hash").filter("node <> centre").groupBy("node", "space", "slack", "centre")
        # Similar sets have all but H subsets in common.
        near = met.agg(F.count("*").alias("n")).filter("n > slack")
        best = near.groupBy(F.col("node").alias("a")).agg(F.max_by(F.struct("centre", "space"), F.struct("n", "centre")).alias("best"))
        best = self.scratch.keep(best.select("a", F.col("best.centre").alias("b"), F.col("best.space").alias("space")), "best")
        nodes = best.select(F.col("a").alias("node")).unionByName(best.select(F.col("b").alias("node")))
        sketches = self.sketches(nodes, "first")
        close = best.join(_of_side(sketches, "a"), ["a", "space"]).join(_of_side(sketches, "b"), ["b", "space"])
        links = self.verified(close.filter(self.may_be_similar()).select("a", "b"), "first")
        self.scratch.drop(best, sketches)
        return links

    def outside(self, ranks: DataFrame) -> DataFrame:
        """``node, space, slack, n, lower``: those that share more than slack with sets of other components.

        ``n`` is how many subsets they share so, and ``lower`` how many of them with larger components.
        """
        by_rank = _ranked(self.subsets, ranks).select("rank", F.explode("hashes").alias("hash"))
        tops = by_rank.groupBy("hash").agg(F.max("rank").alias("top"), F.min("rank").alias("bottom")).filter("top <> bottom")
        tops = self.scratch.keep(tops.select("hash", "top"), "tops")
        marks = self.shared(tops.select("hash"))
        each = self.subsets.select("node", "space", "slack", F.explode("hashes").alias("hash"))
        met = _ranked(each.mapInArrow(_marked_hashes(marks), each.schema), ranks).join(tops, "hash")
        of_set = met.groupBy("node", "space", "slack").agg(F.count("*").alias("n"), F.count_if(F.expr("rank < top")).alias("lower"))
        kept = self.scratch.keep(of_set.filter("n > slack"), "outside")
        marks.destroy()
        self.scratch.drop(tops)
        return kept

    def last_links(self, roots: DataFrame) -> DataFrame:
        """All links between nodes of different components."""
        roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        size = roots.groupBy("root").agg(F.count("*").alias("many"))
        ranks = self.scratch.keep(roots.join(size, "root").select("node", F.struct("many", F.xxhash64("root").alias("root")).alias("rank")), "ranks")
        outside = self.outside(ranks)
        # Those that can't spend all on subsets that no larger component shares.
        searching = outside.filter("lower > slack").groupBy("node").agg(F.collect_list("space").alias("spaces"))
        searching = self.scratch.keep(searching, "searching")
        own, marks = self.grams_of(searching.select("node"))
        asked = self.scratch.keep(
            own.join(searching, "node")
            .select("node", "grams", "spaces")
            .mapInArrow(_questions(self.rule), "node binary, space int, spend int, segments int, segment int, hash long, deleted boolean"),
            "questions",
        )
        marks.destroy()
        sought = self.shared(_node_bits(outside.select("node")))
        whole, without = self.shared(asked.select("hash")), self.shared(asked.filter("NOT deleted").select("hash"))
        found = self.sets.mapInArrow(_answers(self.rule, sought, whole, without), "hash long, deleted boolean, node binary, space int")
        answers = self.scratch.keep(_ranked(found.withColumnRenamed("deleted", "against"), ranks), "answers")
        for marks in (sought, whole, without):
            marks.destroy()
        all_of = answers.groupBy("hash", "against").agg(F.count("*").alias("all"), F.max("rank").alias("top"), F.min("rank").alias("bottom"))
        all_of = self.scratch.keep(all_of, "kinds")
        # A set answers what it asks for itself; so an equal subset is of use where several components have it.
        equal, shorter = self.shared(all_of.filter("against OR top <> bottom").select("hash")), self.shared(all_of.filter("NOT against").select("hash"))
        useful = self.scratch.keep(asked.mapInArrow(_answered(equal, shorter), asked.schema), "useful")
        equal.destroy()
        shorter.destroy()
        self.scratch.drop(asked)
        # What a node asks of each kind of answer; the second unit of a segment asks for everything but equal subsets.
        equal, shorter = useful.filter("NOT deleted"), useful.filter("deleted")
        looks = (
            equal.withColumns({"against": F.lit(False), "unit": F.lit(1)})
            .unionByName(equal.withColumns({"against": F.lit(True), "unit": F.lit(2)}))
            .unionByName(shorter.withColumns({"against": F.lit(False), "unit": F.lit(2)}))
            .drop("deleted")
        )
        own_of = answers.groupBy("hash", "against", "rank").agg(F.count("*").alias("own"))
        # Only what meets a node of a larger component has a price; the rest is for nothing.
        met = _ranked(looks.join(all_of.drop("bottom"), ["hash", "against"]), ranks).filter("rank < top")
        met = self.scratch.keep(met.drop("top"), "met")
        priced = met.join(own_of, ["hash", "against", "rank"], "left")
        price = F.col("all") - F.coalesce("own", F.lit(0))
        costs = priced.groupBy("node", "space", "spend", "segments", "segment").agg(
            F.sum(F.when(F.col("unit") == 1, price).otherwise(0)).alias("one"), F.sum(price).alias("two")
        )
        spent = self.scratch.keep(
            costs.groupBy("node", "space", "spend", "segments")
            .agg(F.collect_list(F.struct("segment", "one", "two")).alias("costs"))
            .mapInArrow(_allocations, "node binary, space int, segment int, units int"),
            "spent",
        )
        chosen = met.join(spent, ["node", "space", "segment"]).filter("unit <= units")
        chosen = self.scratch.keep(chosen.select("hash", "against", "space", F.col("node").alias("a"), "rank"), "chosen")
        lowest = chosen.groupBy("hash", "against").agg(F.min("rank").alias("lowest"))
        others = self.scratch.keep(
            answers.join(lowest, ["hash", "against"])
            .filter("rank > lowest")
            .select("hash", "against", "space", F.col("node").alias("b"), F.col("rank").alias("rank_b")),
            "others",
        )
        nodes = chosen.select(F.col("a").alias("node")).unionByName(others.select(F.col("b").alias("node")))
        sketches = self.sketches(nodes, "last")
        asking = chosen.join(_of_side(sketches, "a"), ["a", "space"])
        answering = others.join(_of_side(sketches, "b"), ["b", "space"])
        pairs = (
            asking.join(answering.drop("space"), ["hash", "against"])
            .filter((F.col("rank") < F.col("rank_b")) & self.may_be_similar())
            .select("a", "b")
            .distinct()
        )
        links = self.verified(pairs, "last")
        self.scratch.drop(ranks, outside, searching, answers, all_of, useful, met, spent, chosen, others, sketches)
        return links


def _of_side(sketches: DataFrame, side: str) -> DataFrame:
    """``{side}, space, size_{side}, bits_{side}``."""
    return sketches.select(F.col("node").alias(side), "space", F.col("size").alias(f"size_{side}"), F.col("bits").alias(f"bits_{side}"))


def _ranked(rows: DataFrame, ranks: DataFrame) -> DataFrame:
    """Rows with a node, and its component's rank: by number of nodes, then hash of the root."""
    alone = F.struct(F.lit(1).cast("long").alias("many"), F.xxhash64("node").alias("root"))
    return rows.join(ranks, "node", "left").withColumn("rank", F.coalesce("rank", alone))


def similar_groups(docs: DataFrame, k: int = 3, least: int = 90, of: int = 100, key: str = "doc_id") -> DataFrame:
    """``row`` (the ``key`` column), ``n_shingles``, ``group``: connected components of linked sets.

    Two sets are linked if ``of * intersection >= least * union``.  ``group`` is
    null for documents without grams.
    """
    join = _Join(docs, key, k, Similarity(least, of))
    first = join.first_links()
    last = join.last_links(components(first, join.scratch))
    roots = components(first.unionByName(last), join.scratch)
    join.scratch.drop(join.subsets, join.sets)
    return join.rows.join(roots, "node", "left").select("row", F.col("size").alias("n_shingles"), F.coalesce("root", "node").alias("group"))


def join_report(docs: DataFrame, k: int = 3, least: int = 90, of: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row."""
    found = Scratch(docs.sparkSession, "jaccard-join").keep(similar_groups(docs, k, least, of), "groups")
    first = found.filter("group IS NOT NULL").groupBy("group").agg(F.min("row").alias("first"))
    return found.join(first, "group", "left").select(
        F.col("row").alias("doc_id"), "n_shingles", F.coalesce("first", "row").alias("component_id")
    )
