"""The shape of a run's records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from harvestline.functions.text import short_digest
from harvestline.functions.variants import flatten_shape, shape_signature
from harvestline.operators.resume import RUN, high_water_order


def merged_type(types: Column) -> Column:
    """Null yields to anything, two concrete types are ``mixed``.

    ``types`` is the set of types seen; order plays no part, so partial
    aggregation is safe.
    """
    solid = F.array_remove(types, "null")
    return (
        F.when(F.size(solid) == 0, "null").when(F.size(solid) == 1, solid[0]).otherwise("mixed")
    )


def distinct_shapes(records: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """One record per distinct shape of each group.

    Records of a source repeat a few shapes, so taking shapes apart record by
    record is wasted work: this collapses them map-side on a compiled signature.
    """
    described = records.withColumn("schema_text", F.schema_of_variant("record"))
    signature = shape_signature("record", "schema_text")
    return described.groupBy(*keys, signature.alias("signature")).agg(
        F.first("record").alias("record")
    )


def observe_shape(records: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """A4, A5: ``(keys, path, type)`` over all records of each group."""
    return merge_shapes(distinct_shapes(records, keys), keys)


def merge_shapes(samples: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Take sample records apart and merge the types seen at each path."""
    leaves = samples.select(*keys, F.explode(flatten_shape("record")).alias("leaf"))
    return (
        leaves.groupBy(*keys, F.col("leaf.path").alias("path"))
        .agg(F.collect_set("leaf.type").alias("types"))
        .select(*keys, "path", merged_type(F.col("types")).alias("type"))
    )


def shape_text(leaves: Column) -> Column:
    """Shape as sorted ``path:type`` lines; sorted by path, not by line."""
    return F.concat_ws(
        "",
        F.transform(
            F.array_sort(leaves),
            lambda x: F.concat(x["path"], F.lit(":"), x["type"], F.lit("\n")),
        ),
    )


def fingerprint(shape: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Short digest and sorted paths of each group's shape."""
    return (
        shape.groupBy(*keys)
        .agg(F.collect_list(F.struct("path", "type")).alias("leaves"))
        .select(
            *keys,
            short_digest(shape_text(F.col("leaves"))).alias("schema_fingerprint"),
            F.array_sort(F.transform("leaves", lambda x: x["path"])).alias("paths"),
        )
    )


def profile_runs(marked: DataFrame) -> DataFrame:
    """Counts, high-water mark and distinct shapes of every run in one pass over the records.

    One row per ``(run, signature)``: a few rows a run however many records it
    has.  ``summarise`` and ``merge_shapes`` finish the job on that.
    """
    # A row its table refuses has still been seen: it shapes the run and moves its resume point.
    accepted = F.col("verdict").isin("accepted", "refused")
    order = high_water_order(
        F.col("format"), F.col("resume_key"), F.col("page_no"), F.col("record_pos")
    )
    usable = accepted & F.col("resume_value").isNotNull() & (F.col("kind") != "backfill")
    best = F.when(usable, order)
    described = marked.withColumn("schema_text", F.when(accepted, F.schema_of_variant("record")))
    return described.groupBy(
        *RUN, "verdict", shape_signature("record", "schema_text").alias("signature")
    ).agg(
        F.count("*").alias("rows"),
        F.max_by("resume_value", best).alias("high_water"),
        F.max(best).alias("high_water_order"),
        F.first(F.when(accepted, F.col("record"))).alias("record"),
    )


def summarise(profile: DataFrame) -> DataFrame:
    """A1-A3 from ``profile_runs``."""
    of = lambda v: F.coalesce(F.sum(F.when(F.col("verdict") == v, F.col("rows"))), F.lit(0))
    return profile.groupBy(*RUN).agg(
        of("accepted").alias("rows_accepted"),
        of("rejected").alias("rows_rejected"),
        of("skipped").alias("rows_skipped"),
        of("refused").alias("rows_refused"),
        F.max_by("high_water", "high_water_order").alias("high_water"),
    )
