"""Pages landed in any order, numbered by following what each one points to.

A page of a cursor or link walk says what was asked for it (``request_cursor``:
the cursor, or the URL of a followed link; none for the first) and what to ask
for next.  Those are the edges of one chain a run, and a page's number is its
place on it.  Places are found by pointer doubling: a pointer that skips 2, 4, 8
pages is two pointers one after the other, so a walk of n pages takes log2(n)
rounds of joins, for all runs of all sources together.  Only keys move, a few
dozen bytes a page, and they are spread by run and key, so one endless walk is
no hot spot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from harvestline.plans.staging import stage
from harvestline.sources.pages import decode_pages, next_key, one_answer

RUN = ["source_id", "run_id"]
Keep = Callable[[DataFrame, str], DataFrame]


def request_key() -> Column:
    """What was asked for; empty for a walk's first page."""
    return F.coalesce("request_cursor", F.lit(""))


def page_steps(pages: DataFrame, config: DataFrame, keep: Keep = stage) -> DataFrame:
    """``source_id, run_id, key, after``: what each answered page asked for, and what it says to ask next."""
    decoded = decode_pages(one_answer(pages, keep), config)
    after = F.when(F.col("page_error").isNull(), next_key())
    return decoded.select(*RUN, request_key().alias("key"), after.alias("after")).where(
        F.col("after").isNotNull() & (F.col("after") != F.col("key"))
    )


def chain_places(starts: DataFrame, steps: DataFrame, longest: int, keep: Keep = stage) -> DataFrame:
    """``source_id, run_id, key, place, loops``: where each key stands on its run's chain, from 1.

    ``starts`` names the runs; each begins at the empty key.  A chain that comes
    back to a key ``loops`` (true in all its rows) and keeps the first place of
    each.  Places beyond ``longest`` may be left out.
    """
    first = starts.select(*RUN).distinct().select(
        *RUN, F.lit("").alias("key"), F.lit(1).alias("place"), F.lit(False).alias("again")
    )
    reached, jumps = keep(first, "reached"), keep(steps.select(*RUN, "key", "after").distinct(), "jumps")
    known, span = reached.count(), 1
    while True:
        ahead = reached.join(jumps, [*RUN, "key"]).select(
            *RUN, F.col("after").alias("key"), (F.col("place") + span).alias("place"), "again"
        )
        reached = keep(
            reached.unionByName(ahead)
            .groupBy(*RUN, "key")
            .agg(F.min("place").alias("place"), (F.max("again") | (F.min("place") < F.max("place"))).alias("again")),
            "reached",
        )
        before, known, span = known, reached.count(), span * 2
        if known == before or span >= longest:
            break
        far = jumps.select(*RUN, F.col("key").alias("after"), F.col("after").alias("farther"))
        jumps = keep(
            jumps.join(far, [*RUN, "after"]).select(*RUN, "key", F.col("farther").alias("after")), "jumps"
        )
    looped = reached.groupBy(*RUN).agg(F.max("again").alias("loops"))
    return reached.drop("again").join(looped, RUN)


def number_pages(pages: DataFrame, config: DataFrame, keep: Keep = stage) -> DataFrame:
    """Pages with ``page_no`` where it was missing, and whether their walk ``loops``.

    Every attempt at a page gets its number, answered or not, so a page that the
    chain asks for and nobody answered is known by number.  Pages off the chain
    have none and are never read.  Numbered pages stay as they are; bodies meet
    only the short list of places.
    """
    loose = pages.where(F.col("page_no").isNull()).drop("page_no")
    # The rounds go as far as the greatest page cap: configuration, one value.
    longest = config.agg(F.max("max_pages")).first()[0] or 1
    steps = page_steps(loose.withColumn("page_no", F.lit(None).cast("int")), config, keep)
    places = keep(chain_places(loose, steps, longest, keep), "places")
    found = (
        loose.withColumn("key", request_key())
        .join(places, [*RUN, "key"], "left")
        .withColumn("page_no", F.col("place").cast("int"))
        .withColumn("loops", F.coalesce("loops", F.lit(False)))
    )
    columns = [*pages.columns, "loops"]
    numbered = pages.where(F.col("page_no").isNotNull()).withColumn("loops", F.lit(False))
    return numbered.select(*columns).unionByName(found.select(*columns))
