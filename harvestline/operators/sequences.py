"""Order-dependent columns on groups of any size.

A window over ``source_id`` puts a whole source in one task.  These cut the
group into buckets of the ordering column, run the window inside a bucket, and
carry one row per bucket across.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

_BUCKET = "__bucket"


def lag_in_buckets(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, str],
    bucket: Column,
) -> DataFrame:
    """``lag`` of several columns per group, exact across buckets.

    ``bucket`` must not decrease along ``order``.  ``values`` maps source column
    to the name of its lagged copy.
    """
    keys, order = list(keys), list(order)
    cut = df.withColumn(_BUCKET, bucket)
    inside = Window.partitionBy(*keys, _BUCKET).orderBy(*order)
    carried = F.struct(*[F.col(v) for v in values])
    # The last row of each bucket, one row per bucket from here on.
    tails = cut.groupBy(*keys, _BUCKET).agg(F.max_by(carried, F.struct(*order)).alias("__tail"))
    across = Window.partitionBy(*keys).orderBy(_BUCKET)
    heads = tails.select(*keys, _BUCKET, F.lag("__tail").over(across).alias("__carry"))
    ranked = cut.withColumn("__prev", F.lag(carried).over(inside)).withColumn(
        "__first", F.row_number().over(inside) == 1
    )
    joined = ranked.join(heads, [*keys, _BUCKET])
    previous = F.when(F.col("__first"), F.col("__carry")).otherwise(F.col("__prev"))
    return joined.select(
        *df.columns, *[previous[v].alias(name) for v, name in values.items()]
    )


def running_since_reset(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    counted: Column,
    reset: Column,
    bucket: Column,
    name: str,
) -> DataFrame:
    """Running count of ``counted`` rows since the last ``reset`` row, exact across buckets."""
    keys, order = list(keys), list(order)
    cut = (
        df.withColumn(_BUCKET, bucket)
        .withColumn("__n", counted.cast("int"))
        .withColumn("__r", reset.cast("int"))
    )
    inside = (
        Window.partitionBy(*keys, _BUCKET)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    cut = cut.withColumn("__grp", F.sum("__r").over(inside))
    segment = (
        Window.partitionBy(*keys, _BUCKET, "__grp")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    cut = cut.withColumn("__inside", F.sum("__n").over(segment))
    tails = cut.groupBy(*keys, _BUCKET).agg(
        F.max("__r").alias("__r"),
        F.max_by("__inside", F.struct(*order)).alias("__n"),
    )
    # A bucket with a reset starts a new chain; one without adds to it.
    upto = Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, 0)
    tails = tails.withColumn("__chain", F.sum("__r").over(upto))
    chain = (
        Window.partitionBy(*keys, "__chain")
        .orderBy(_BUCKET)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    tails = tails.withColumn("__streak", F.sum("__n").over(chain))
    before = Window.partitionBy(*keys).orderBy(_BUCKET)
    heads = tails.select(
        *keys, _BUCKET, F.coalesce(F.lag("__streak").over(before), F.lit(0)).alias("__carry")
    )
    total = F.col("__inside") + F.when(F.col("__grp") == 0, F.col("__carry")).otherwise(0)
    return cut.join(heads, [*keys, _BUCKET]).select(*df.columns, total.alias(name))
