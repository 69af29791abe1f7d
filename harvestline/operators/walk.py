"""Where each run's pagination ends and whether it ended well."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from harvestline.model import PAGINATION_TYPES

RUN = ("source_id", "run_id")
STRETCH = 1024  # page numbers that are collected together


def walk_runs(facts: DataFrame) -> DataFrame:
    """One row per run: last page to read, how many are there, and the walk's outcome.

    ``complete``            a terminal page was reached with no page missing before it
    ``failed``              a page before the end could not be decoded
    ``max_pages_exceeded``  the page cap was read without reaching the end, or
                            the pages lead back to one another and never would
    ``truncated``           pages are missing before the end
    ``unsupported``         the pagination type is unknown

    Pages past the cap would never have been requested and are ignored.  Page
    numbers are collected in stretches of ``STRETCH``, of which one fact each goes
    on, so no buffer grows with a run's length but one entry a stretch.  A page
    number below 1 fails the run.  Everything else combines map-side.
    """
    number = F.when(F.col("page_no").between(1, F.col("max_pages")), F.col("page_no"))
    has_error = F.col("page_error").isNotNull()
    stretches = facts.groupBy(*RUN, F.floor((number - 1) / STRETCH).alias("stretch")).agg(
        F.first("pagination_type").alias("pagination_type"),
        F.first("max_pages").alias("max_pages"),
        F.min(F.when(F.col("terminal") & ~has_error, number)).alias("stop_page"),
        F.min(F.when(has_error, number)).alias("error_page"),
        F.min_by("page_error", F.when(has_error, number)).alias("page_error"),
        F.sort_array(F.collect_set(number)).alias("seen"),
        F.count_if(F.col("page_no") < 1).alias("strays"),
        F.max("loops").alias("loops"),
    )
    # Sorted distinct page numbers equal their position up to the first gap.
    begin = F.col("stretch") * STRETCH
    unbroken = F.size(F.filter("seen", lambda p, i: p == begin + i + 1))
    runs = stretches.groupBy(*RUN).agg(
        F.first("pagination_type").alias("pagination_type"),
        F.first("max_pages").alias("max_pages"),
        F.min("stop_page").alias("stop_page"),
        F.min("error_page").alias("error_page"),
        F.min_by("page_error", "error_page").alias("page_error"),
        F.sort_array(
            F.collect_list(F.when(F.col("stretch").isNotNull(), F.struct(begin.cast("int").alias("begin"), unbroken.alias("pages"))))
        ).alias("parts"),
        F.sum("strays").alias("strays"),
        F.max("loops").alias("loops"),
    )
    # A stretch counts where all before it are whole.
    reach = F.aggregate(
        "parts", F.lit(0), lambda so_far, part: so_far + F.when(part["begin"] == so_far, part["pages"]).otherwise(0)
    )
    runs = runs.withColumn("reach", reach)
    stop, err = F.col("stop_page"), F.col("error_page")
    supported = F.col("pagination_type").isin(*PAGINATION_TYPES)
    failed = (err <= F.col("reach")) & (stop.isNull() | (err < stop))
    status = (
        F.when((F.col("strays") > 0) | F.coalesce(failed, F.lit(False)), "failed")
        .when(~supported, "unsupported")
        .when(F.coalesce(stop <= F.col("reach"), F.lit(False)), "complete")
        .when((F.col("reach") >= F.col("max_pages")) | F.col("loops"), "max_pages_exceeded")
        .otherwise("truncated")
    )
    runs = runs.withColumn("walk_status", status)
    is_status = lambda s: F.col("walk_status") == s
    end = (
        F.when(is_status("complete"), stop)
        .when(F.col("strays") > 0, F.lit(0))
        .when(is_status("failed"), err - 1)
        .when(is_status("unsupported"), F.least(F.col("reach"), F.lit(1)))
        .otherwise(F.col("reach"))
    )
    # What a walk that didn't end well says.
    error = (
        F.when(F.col("strays") > 0, F.lit("page numbers start at 1"))
        .when(is_status("failed"), F.col("page_error"))
        .when(
            is_status("unsupported"),
            F.format_string('unsupported pagination type "%s"', F.col("pagination_type")),
        )
        .when(
            is_status("max_pages_exceeded"),
            F.format_string(
                "stopped after maxPages=%d without reaching the end of the result set",
                F.col("max_pages"),
            ),
        )
        .when(is_status("truncated"), F.lit("landed pages end before the result set does"))
    )
    # End of fixed values.
    return runs.select(
        *RUN,
        "pagination_type",
        end.alias("end_page"),
        "walk_status",
        error.alias("walk_error"),
    )


def keep_walked(pages: DataFrame, walks: DataFrame) -> DataFrame:
    """Drop pages after the end of each run's walk.

    ``walks`` has one short row per run.  Give it as a staged table (see
    ``plans.staging``): its true size is then known and Catalyst broadcasts it
    while it fits, else sort-merges with skew splitting.
    """
    ends = walks.select(*RUN, "end_page")
    return pages.join(ends, list(RUN)).where(
        F.col("page_no").between(1, F.col("end_page"))
    ).drop("end_page")
