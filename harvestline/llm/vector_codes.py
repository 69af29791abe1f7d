"""Operator 11: vectors compressed to codes of a codebook entry a part, with memoised grid cells.

1. Components become integers, vectors are cut into parts, and each part position
   starts with the parts of the vectors with the smallest ids as its codebook.
2. A round assigns every part to its nearest entry.  A part falls into a cell of a
   coarse grid (its integers shifted right).  From the least and the greatest
   distance between an entry and the cell's box follow the entries that can be the
   nearest anywhere in it: an entry further than another's greatest distance is
   dominated.  The entries left are remembered by cell, and only those are
   evaluated exactly, all in integers.  A task remembers at most two generations of
   ``CELLS`` cells a part; what is forgotten is found again.
3. Tasks send sums and counts of each entry, not vectors; the new entries are their
   floors.  After the rounds the parts are assigned once more.

The driver holds the codebooks (``entries`` vectors) and nothing that grows with
the rows.  The cell's size changes what is evaluated, never the result.

Rows whose vector is null or holds a null or non-finite component are dropped.  So
are vectors of another length than the first kept one's (the one with the smallest
id): they have no place in its codebooks.  A length that the parts don't divide is
cut as evenly as it goes.  Scaled components are kept within ``LIMIT``, beyond
which squares would overflow.  Rows that repeat an id are rows like any other, in
order of their vectors; null ids come last.  With fewer rows than entries the
codebooks are shorter.  An empty table gives no rows.  Null labels are one label,
and other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestline.llm.common import Scratch

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LIMIT = 1 << 24
CELLS = 4096  # remembered cells of a part and generation
_PAIRS = 1 << 17  # of parts and entries evaluated at a time
_BOXES = 128  # new cells looked at at a time

Codebooks = list[np.ndarray]  # one array (entries x components) a part


def cuts(width: int, parts: int) -> list[tuple[int, int]]:
    """Where each part begins and ends."""
    at = [i * width // parts for i in range(parts + 1)]
    return list(zip(at, at[1:], strict=False))


def grid_shift(book: np.ndarray) -> int:
    """Bits that make a cell about half as wide as entries are apart in one component."""
    if len(book) < 2 or not book.shape[1]:
        return 0
    apart = [np.delete(((book - entry) ** 2).sum(axis=1), k).min() for k, entry in enumerate(book)]
    width = (float(np.median(apart)) / book.shape[1]) ** 0.5 / 2
    return max(0, int(width).bit_length() - 1)


class Cells:
    """A part's codebook, and for each grid cell met the entries that aren't dominated in it."""

    def __init__(self, book: np.ndarray) -> None:
        self.book, self.shift = book, grid_shift(book)
        self.new: dict[bytes, np.ndarray] = {}
        self.old: dict[bytes, np.ndarray] = {}

    def _survivors(self, cells: np.ndarray) -> Iterator[np.ndarray]:
        for at in range(0, len(cells), _BOXES):
            low = (cells[at : at + _BOXES] << self.shift)[:, None, :]
            high = low + ((1 << self.shift) - 1)
            gap = np.maximum(np.maximum(low - self.book, self.book - high), 0)
            span = np.maximum(np.abs(self.book - low), np.abs(self.book - high))
            least, most = (gap**2).sum(axis=2), (span**2).sum(axis=2)
            for alive in least <= most.min(axis=1, keepdims=True):
                yield np.flatnonzero(alive)

    def candidates(self, cells: np.ndarray) -> list[np.ndarray]:
        """The remembered entries of each cell; cells not met before are looked at first."""
        keys = [cell.tobytes() for cell in cells]
        found = [self.new.get(key) for key in keys]
        if len(self.new) > CELLS:
            self.old, self.new = self.new, {}
        for i, key in enumerate(keys):
            if found[i] is None and (known := self.old.get(key)) is not None:
                found[i] = self.new[key] = known
        unknown = [i for i, known in enumerate(found) if known is None]
        for i, alive in zip(unknown, self._survivors(cells[unknown]), strict=True):
            found[i] = self.new[keys[i]] = alive
        return found

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each row's nearest entry, the lower of equal ones, and its squared distance."""
        if x.shape[1]:
            cells, cell_of = np.unique(x >> self.shift, axis=0, return_inverse=True)
        else:
            cells, cell_of = x[:1], np.zeros(len(x), np.int64)
        lists = self.candidates(cells)
        begin = np.concatenate([[0], np.cumsum([len(e) for e in lists])])
        entries = np.concatenate(lists)
        index, distance = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        many = np.diff(begin)[cell_of.ravel()]
        first = begin[cell_of.ravel()]
        ends, at = np.cumsum(many), 0
        while at < len(x):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PAIRS, "right")))
            count = many[at:to]
            start = np.cumsum(count) - count
            row = np.repeat(np.arange(to - at), count)
            entry = entries[np.arange(len(row)) - start[row] + first[at:to][row]]
            apart = ((x[at:to][row] - self.book[entry]) ** 2).sum(axis=1)
            best = np.minimum.reduceat(apart, start)
            hits = np.flatnonzero(apart == best[row])[::-1]  # the last written is the lowest entry
            index[at:to][row[hits]] = entry[hits]
            distance[at:to] = best
            at = to
        return index, distance


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _assigned(books: Codebooks, width: int, batches: Iterator[pa.RecordBatch], at: int):
    """Of each batch: itself, its vectors, and index and distance of every part."""
    memos = [Cells(book) for book in books]
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column(at), width)
            parts = [x[:, a:b] for a, b in cuts(width, len(books))]
            yield batch, parts, [memo.nearest(np.ascontiguousarray(part)) for memo, part in zip(memos, parts, strict=True)]


def _sums(shared, width: int):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books: Codebooks = shared.value
        totals = [np.zeros_like(book) for book in books]
        counts = [np.zeros(len(book), np.int64) for book in books]
        for _, parts, found in _assigned(books, width, batches, 0):
            for total, count, part, (index, _) in zip(totals, counts, parts, found, strict=True):
                np.add.at(total, index, part)
                count += np.bincount(index, minlength=len(count))
        rows = [(p, k) for p, count in enumerate(counts) for k in np.flatnonzero(count).tolist()]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([p for p, _ in rows], pa.int32()),
                pa.array([k for _, k in rows], pa.int32()),
                pa.array([int(counts[p][k]) for p, k in rows], pa.int64()),
                pa.array([totals[p][k] for p, k in rows], pa.list_(pa.int64())),
            ],
            ["part", "entry", "n", "sums"],
        )

    return sums


def _codes(shared, width: int):
    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, found in _assigned(shared.value, width, batches, 2):
            digits = np.stack([index for index, _ in found], axis=1)
            error = sum(distance for _, distance in found)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(["".join(f"{k:02x}" for k in row) for row in digits.tolist()], pa.string()),
                    pa.array(error, pa.int64()),
                ],
                ["id", "label", "code", "error"],
            )

    return codes


def quantised(rows: DataFrame, key: str, vector: str, label: str, scale: int = SCALE) -> DataFrame:
    """``id, label, x``: the rows with a whole vector, its components as integers."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    scaled = lambda c: F.least(F.greatest(c * float(scale), F.lit(-float(LIMIT))), F.lit(float(LIMIT)))
    return (
        rows.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
        .filter(F.col("v").isNotNull() & F.forall("v", finite))
        .select("id", "label", F.transform("v", lambda c: F.floor(scaled(c)).cast("int")).alias("x"))
    )


def _updated(books: Codebooks, sums: DataFrame) -> Codebooks:
    """Floors of the means; entries without parts stay.  ``sums`` comes back as one row an entry."""
    longest = max(book.shape[1] for book in books)
    totals = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(longest)]
    after = [book.copy() for book in books]
    for row in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *totals).collect():
        book = after[row["part"]]
        book[row["entry"]] = [row[f"s{i}"] // row["n"] for i in range(book.shape[1])]
    return after


def vector_codes(
    rows: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> tuple[DataFrame, Codebooks]:
    """``id, label, code, error`` of every row with a whole vector, and the codebooks the codes are of."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "vector-codes")
    kept = scratch.keep(quantised(rows, key, vector, label, scale), "integers")
    order = [F.col("id").asc_nulls_last(), "x"]
    kinds = ", ".join(f"{name} {kept.schema[name].dataType.simpleString()}" for name in ("id", "label"))
    result = f"{kinds}, code string, error long"
    head = kept.orderBy(*order).select("x").first()
    if head is None:
        return spark.createDataFrame([], result), []
    width = len(head["x"])
    kept = kept.filter(F.size("x") == width)
    first = kept.orderBy(*order).select("x").limit(entries).collect()
    starts = np.array([row["x"] for row in first], np.int64).reshape(len(first), width)
    books = [starts[:, a:b].copy() for a, b in cuts(width, parts)]
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)
        sums = kept.select("x").mapInArrow(_sums(shared, width), "part int, entry int, n long, sums array<long>")
        books = _updated(books, sums)
        shared.destroy()
    shared = spark.sparkContext.broadcast(books)
    codes = scratch.keep(kept.select("id", "label", "x").mapInArrow(_codes(shared, width), result), "codes")
    shared.destroy()
    scratch.drop(kept)
    return codes, books


def codebook_digest(books: Codebooks) -> str:
    return hashlib.sha256(",".join(str(c) for book in books for c in book.ravel().tolist()).encode()).hexdigest()


def code_report(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every row with a whole vector."""
    codes, books = vector_codes(rows, key, vector, label)
    of_label = codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return codes.join(of_label, codes["label"].eqNullSafe(of_label["of"])).select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256")
    )
