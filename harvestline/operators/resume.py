"""Which records are new, and how far a run got."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from harvestline.functions.once import compute_once
from harvestline.functions.ordering import order_key
from harvestline.functions.text import blank_to_null
from harvestline.functions.variants import dotted_get_any, is_object, scalar_text

RUN = ("source_id", "run_id")


def resolve_bounds(specs: DataFrame, status: DataFrame, backfills: DataFrame) -> DataFrame:
    """the range each source's next run covers.

    ``status``: ``(source_id, watermark)``; ``backfills``: at most one request a
    source, ``(source_id, request_id, from_value, to_value)``.  A backfill takes
    its range as given; otherwise the stored value, else the initial one.
    Without resume settings the run is a full pull.

    Where ``specs`` has a ``run_id``, bounds are one row a run and requests are
    ``backfills`` with ``run_id`` and ``kind``, of which ``trigger`` takes the
    scheduled range.
    """
    by_run = "run_id" in specs.columns
    keys = ["source_id", "run_id"] if by_run else ["source_id"]
    asked = backfills.select(
        *keys,
        "request_id",
        "from_value",
        "to_value",
        (F.col("kind") if by_run else F.lit("backfill")).alias("asked_kind"),
    )
    joined = specs.join(
        status.select("source_id", F.col("watermark").alias("stored")), "source_id", "left"
    ).join(asked, keys, "left")
    wm = F.col("watermark")
    resumes = wm.isNotNull() & (F.coalesce(wm["record_field"], F.lit("")) != "")
    is_backfill = F.coalesce(F.col("asked_kind") == "backfill", F.lit(False))
    scheduled_from = F.coalesce(blank_to_null(F.col("stored")), blank_to_null(wm["initial_value"]))
    return joined.select(
        *keys,
        F.coalesce("asked_kind", F.lit("scheduled")).alias("kind"),
        F.when(is_backfill, F.col("request_id")).alias("backfill_id"),
        F.when(resumes, wm["record_field"]).alias("record_field"),
        F.when(resumes, F.coalesce(wm["format"], F.lit(""))).alias("format"),
        F.when(
            resumes, F.when(is_backfill, blank_to_null(F.col("from_value"))).otherwise(scheduled_from)
        ).alias("from_value"),
        F.when(resumes & is_backfill, blank_to_null(F.col("to_value"))).alias("to_value"),
    )


def range_predicate(key: Column, from_key: Column, to_key: Column) -> Column:
    """Keep ``from < key <= to``; anything that cannot be compared is kept."""
    seen = F.coalesce(key <= from_key, F.lit(False))
    beyond = F.coalesce(key > to_key, F.lit(False))
    return ~(seen | beyond)


def keyed_bounds(bounds: DataFrame) -> DataFrame:
    """Bounds with their comparable keys, computed once a source or run instead of once a record."""
    return bounds.select(
        *[c for c in RUN if c in bounds.columns],
        "kind",
        "record_field",
        "format",
        order_key(F.col("from_value"), F.col("format")).alias("from_key"),
        order_key(F.col("to_value"), F.col("format")).alias("to_key"),
    )


def mark_records(
    records: DataFrame, bounds: DataFrame, known_fields: list[str] | None = None
) -> DataFrame:
    """Label each record ``rejected``, ``skipped`` or ``accepted``.

    Adds ``verdict``, ``resume_value`` and ``resume_key``.  ``bounds`` is one row
    a source or run; ``known_fields`` lists its record fields when the caller has them.
    """
    joined = records.join(keyed_bounds(bounds), [c for c in RUN if c in bounds.columns])
    field = dotted_get_any(F.col("record"), F.col("record_field"), known_fields)
    found = compute_once(joined, resume_field=F.when(F.col("record_field").isNotNull(), field))
    valued = compute_once(found, resume_value=scalar_text(F.col("resume_field")))
    read = compute_once(valued, resume_key=order_key(F.col("resume_value"), F.col("format")))
    keep = range_predicate(F.col("resume_key"), F.col("from_key"), F.col("to_key"))
    verdict = (
        F.when(~is_object(F.col("record")), "rejected").when(~keep, "skipped").otherwise("accepted")
    )
    return read.withColumn("verdict", verdict).drop(
        "from_key", "to_key", "record_field", "resume_field"
    )


def high_water_order(fmt: Column, key: Column, page_no: Column, pos: Column) -> Column:
    """A1, A2: what the reported value maximises.

    Ordered formats: the key, earliest record on ties; unreadable values never
    win.  Opaque: delivery order.  NULL rows take no part.
    """
    page_no, pos = page_no.cast("bigint"), pos.cast("bigint")

    def ranked(*parts: Column | int) -> Column:
        parts = [F.lit(p) if isinstance(p, int) else p for p in parts]
        return F.struct(*[p.cast("bigint").alias(f"o{i}") for i, p in enumerate(parts)])

    ordered = F.when(key.isNotNull(), ranked(key["major"], key["minor"], -page_no, -pos))
    return F.when(fmt == "Opaque", ranked(page_no, pos, 0, 0)).otherwise(ordered)


def high_water(marked: DataFrame) -> DataFrame:
    """The resume value each run reports; backfills and full pulls report none."""
    order = high_water_order(
        F.col("format"), F.col("resume_key"), F.col("page_no"), F.col("record_pos")
    )
    usable = (
        (F.col("verdict") == "accepted")
        & F.col("resume_value").isNotNull()
        & (F.col("kind") != "backfill")
    )
    return marked.groupBy(*RUN).agg(
        F.max_by("resume_value", F.when(usable, order)).alias("high_water")
    )


def run_counts(marked: DataFrame) -> DataFrame:
    """A3: record counts of each run by what became of them."""
    verdict = F.col("verdict")
    return marked.groupBy(*RUN).agg(
        F.count_if(verdict == "accepted").alias("rows_accepted"),
        F.count_if(verdict == "rejected").alias("rows_rejected"),
        F.count_if(verdict == "skipped").alias("rows_skipped"),
    )
