"""Operator 2: mixing sources to target weights along a curriculum.

Each source has a weight schedule: weights at times from 0 (start of training) to
1 (end), linear between them.  Its integral is the source's share; shares are
scaled to the words the mix is to have.  A source may be repeated ``cap`` times
at most; what is over is shared out again by weight until none is above.

A source's cumulative demand at time t is its target times the share of its
schedule's integral up to t.  Documents of a source stand in a fixed random
order; a copy's place in the source's run of words, put through the inverse of
that demand, is its training position.  Whole passes take every document, the
last pass takes documents up to the target, to the nearest document.

Running sums over a source of any size go in two levels: per slice of the random
order, then within a slice.  Only sizes are shuffled, never texts.

Null or empty text has size 0 and is taken whenever its turn comes, for nothing;
in a source without any words it is taken once, at position 0.  A source whose
schedule is 0 throughout has the target 0: none of its words are taken.
A null source is a source, last in order.  Rows with equal ``doc_id``, source and
text are taken together, as one document of their joint size.  An empty table
gives an empty result.  Columns with clashing names are left as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harvestline.llm.common import SPACE, Scratch

SLICES = 4096
CAP = 3

_SEGMENT = "array<struct<t0 double, w0 double, t1 double, w1 double>>"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def cycled_weights(sources: DataFrame, schedules: list[list[tuple[float, float]]]) -> DataFrame:
    """``schedules`` in turn for the sources in code point order, null last."""
    segments = [
        F.array(
            *(
                F.struct(*(F.lit(float(v)).alias(n) for n, v in zip(("t0", "w0", "t1", "w1"), (*a, *b), strict=True)))
                for a, b in zip(knots, knots[1:], strict=False)
            )
        )
        for knots in schedules
    ]
    # One row a source, not a document.
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    chosen = F.element_at(F.array(*segments), (rank % len(schedules) + 1).cast("int"))
    return sources.withColumn("segments", chosen.cast(_SEGMENT))


def _targets(sources: DataFrame, cap: float) -> DataFrame:
    """``target`` of each source: its share of all words, ``cap`` times its own at most."""
    area = F.aggregate(
        "segments", F.lit(0.0), lambda a, s: a + (s["t1"] - s["t0"]) * (s["w0"] + s["w1"]) / 2
    )
    known = sources.withColumn("weight", area).withColumn("most", cap * F.col("source_size"))
    # Sources fill up in the order of what a unit of weight would have to bring.
    # One without weight never does: its target is 0.
    order = Window.orderBy(F.try_divide("most", "weight").asc_nulls_last(), "source")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = F.try_divide(
        F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("most").over(before), F.lit(0.0)),
        F.sum("weight").over(rest),
    )
    full = F.coalesce(F.col("most") <= F.col("level") * F.col("weight"), F.lit(False))
    # From the first source that isn't full on, one level holds for all.
    first = F.min(F.when(~full, F.struct("place", "level"))).over(Window.partitionBy())
    return (
        known.withColumn("place", F.row_number().over(order))
        .withColumn("level", level)
        .withColumn("open", first["level"])
        .withColumn("target", F.when(full, F.col("most")).otherwise(F.coalesce("open", F.lit(0.0)) * F.col("weight")))
        .select("source", "source_size", "segments", "weight", F.col("target").cast("double").alias("target"))
    )


def _time_of(share: Column) -> Column:
    """The time at which a schedule has met ``share`` (0 to 1) of its integral."""
    with_sums = F.aggregate(
        "segments",
        F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("t")),
        lambda a, s: F.struct(
            (a["sum"] + (s["t1"] - s["t0"]) * (s["w0"] + s["w1"]) / 2).alias("sum"),
            F.coalesce(a["t"], _within(share * F.col("weight") - a["sum"], s)).alias("t"),
        ),
    )
    return F.coalesce(with_sums["t"], F.lit(1.0))


def _within(y: Column, s: Column) -> Column:
    """Where in a segment its integral reaches ``y``; null if it doesn't."""
    long, slope = s["t1"] - s["t0"], (s["w1"] - s["w0"]) / (s["t1"] - s["t0"])
    area = long * (s["w0"] + s["w1"]) / 2
    root = F.sqrt(F.greatest(s["w0"] * s["w0"] + 2 * slope * y, F.lit(0.0)))
    # 2y / (w0 + root) is the root that also holds for a level segment.
    step = F.when(y <= 0, F.lit(0.0)).otherwise(2 * y / (s["w0"] + root))
    return F.when((y < area) & (area > 0), s["t0"] + F.least(step, long))


def unit_key(text: Column) -> Column:
    """What makes rows of equal ``doc_id`` and source the same document."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def plan_mix(
    docs: DataFrame, schedules: list[list[tuple[float, float]]], cap: int = CAP, seed: int = 17, slices: int = SLICES
) -> tuple[DataFrame, DataFrame]:
    """``(rows, plan)``.

    ``rows``: one row a document row with ``doc_id, source, unit, size``.  ``plan``:
    one row a unit (equal rows together) with its key ``_of``, ``source_size, target,
    copies`` and ``positions``, the training position of each copy.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.keep(
        docs.select("doc_id", "source", unit_key(F.col("text")).alias("unit"), word_count(F.col("text")).alias("size")),
        "sizes",
    )
    units = rows.groupBy("doc_id", "source", "unit").agg(F.sum("size").alias("joint"))
    place = F.xxhash64(F.lit(seed), "doc_id", "unit")
    units = units.withColumn("place", place).withColumn("slice", F.pmod(F.shiftrightunsigned("place", 20), F.lit(slices)))
    sizes = scratch.keep(units.groupBy("source", "slice").agg(F.sum("joint").alias("slice_size")), "slices")
    sources = sizes.groupBy("source").agg(F.sum("slice_size").alias("source_size"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    targets = scratch.keep(_targets(cycled_weights(sources, schedules), cap), "targets")
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("start", F.coalesce(F.sum("slice_size").over(earlier), F.lit(0)))
    starts = starts.join(targets, same(starts, targets)).drop(targets["source"])
    inner = (
        Window.partitionBy("source", "slice")
        .orderBy("place", "doc_id", "unit")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offset = units.withColumn("inner", F.coalesce(F.sum("joint").over(inner), F.lit(0)))
    placed = offset.join(
        starts, same(offset, starts) & (offset["slice"] == starts["slice"])
    ).select(offset["*"], "start", "source_size", "target", "segments", "weight")

    middle = F.col("start") + F.col("inner") + F.col("joint") / 2
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1)).cast("int")
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    # Without words in its source a document is taken once, at the start.
    more = (F.col("source_size") > 0) & (F.col("whole") < cap) & (F.col("middle") <= rest)
    share = lambda k: F.coalesce(F.try_divide(k * F.col("source_size") + F.col("middle"), F.col("target")), F.lit(0.0))
    plan = (
        placed.withColumn("middle", middle)
        .withColumn("whole", whole)
        .withColumn("copies", F.col("whole") + F.when(more, 1).otherwise(0))
        .withColumn(
            "positions",
            F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda k: _time_of(share(k)))),
        )
        .select(F.struct("doc_id", "source", "unit").alias("_of"), "source_size", "target", "copies", "positions")
    )
    return rows, plan


def _same_unit(unit: str, doc_id: Column, source: Column) -> Column:
    return (F.col(unit) == F.col("_of.unit")) & doc_id.eqNullSafe(F.col("_of.doc_id")) & source.eqNullSafe(F.col("_of.source"))


def mix_report(docs: DataFrame, schedules: list[list[tuple[float, float]]], cap: int = CAP) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies, first_position`` for every row."""
    rows, plan = plan_mix(docs, schedules, cap)
    return rows.join(plan, _same_unit("unit", F.col("doc_id"), F.col("source"))).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
        "copies",
        F.get("positions", F.lit(0)).alias("first_position"),
    )


def mix_documents(
    docs: DataFrame, schedules: list[list[tuple[float, float]]], cap: int = CAP, partitions: int | None = None
) -> DataFrame:
    """The mix: each document as often as it is taken, range-sorted by training position."""
    _, plan = plan_mix(docs, schedules, cap)
    taken = Scratch(docs.sparkSession, "mixing").keep(
        plan.filter("copies > 0").select("_of", F.explode("positions").alias("_at")),
        "taken",
    )
    named = docs.select(
        F.struct(*(docs[c] for c in docs.columns)).alias("doc"), unit_key(docs["text"]).alias("unit"), "doc_id", "source"
    )
    copies = named.join(taken, _same_unit("unit", F.col("doc_id"), F.col("source")))
    order = ["_at", "unit"]
    spread = copies.repartitionByRange(partitions, *order) if partitions else copies.repartitionByRange(*order)
    return spread.sortWithinPartitions(*order).select("doc.*")
