"""Landed response pages to records."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from harvestline.functions.once import compute_once
from harvestline.functions.variants import dotted_get, dotted_text, is_array, has_element, kind_sql, parse_body
from harvestline.functions.web import header, next_link
from harvestline.model import (
    DEFAULT_MAX_PAGES,
    DEFAULT_PAGINATION,
    MAX_RESPONSE_BYTES,
    PAGES,
)
from harvestline.plans.staging import stage


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Landed pages as a batch.  Lay the zone out by ``source_id`` to prune by source."""
    return spark.read.format(fmt).schema(PAGES).load(path)


def read_page_stream(
    spark: SparkSession, path: str, fmt: str = "parquet", files_per_batch: int | None = None
) -> DataFrame:
    """The same landing zone as a file stream."""
    reader = spark.readStream.format(fmt).schema(PAGES)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def page_config(specs: DataFrame) -> DataFrame:
    """The per-source settings page decoding needs, with defaults filled in."""
    page = F.col("source.pagination")
    return specs.select(
        "source_id",
        F.coalesce(F.col("source.records_path"), F.lit("")).alias("records_path"),
        F.coalesce(F.nullif(page["type"], F.lit("")), F.lit(DEFAULT_PAGINATION)).alias(
            "pagination_type"
        ),
        page["next_cursor_path"].alias("next_cursor_path"),
        F.coalesce(page["page_size"], F.lit(0)).alias("page_size"),
        F.when(page["max_pages"] > 0, page["max_pages"])
        .otherwise(DEFAULT_MAX_PAGES)
        .alias("max_pages"),
    )


def responses(pages: DataFrame) -> DataFrame:
    """The answered requests; retries that were refused carry no document."""
    return pages.where(F.col("status") < 300)


def page_key() -> Column:
    """What tells a run's pages apart: their number, or what was asked for where they have none."""
    return F.coalesce(
        F.concat(F.lit("#"), F.col("page_no").cast("string")), F.concat(F.lit("@"), "request_cursor"), F.lit("@")
    )


def one_answer(pages: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = stage) -> DataFrame:
    """One answer a page, however often it was fetched or delivered: the last attempt's.

    Only page keys are counted; the bodies of pages with one answer stay where
    they are, and those of the others alone are shuffled to pick one.
    """
    page = ["source_id", "run_id", "page_key"]
    answered = responses(pages).withColumn("page_key", page_key())
    several = keep(answered.groupBy(*page).count().where("count > 1").select(*page), "answers")
    if several.isEmpty():
        return answered.drop("page_key")
    last = Window.partitionBy(*page).orderBy(
        F.desc_nulls_last("attempt"), F.desc_nulls_last("requested_at"), F.xxhash64("body"), "body"
    )
    picked = answered.join(several, page, "left_semi").withColumn("k", F.row_number().over(last)).where("k = 1")
    return answered.join(several, page, "left_anti").unionByName(picked.drop("k")).drop("page_key")


def decode_pages(pages: DataFrame, config: DataFrame) -> DataFrame:
    """Parse each body once and find its record array.

    Adds ``doc``, ``records`` and ``page_error``; a body that cannot be decoded
    or does not hold an array where the source says so is an error, never an
    empty page.
    """
    joined = pages.join(config, "source_id").withColumn(
        "too_big", F.octet_length("body") > MAX_RESPONSE_BYTES
    )
    parsed = compute_once(joined, doc=parse_body(F.col("body"))).drop("body")
    found = compute_once(parsed, records=dotted_get(F.col("doc"), F.col("records_path")))
    kind = F.expr(kind_sql("schema_of_variant(records)"))
    # What a page in error says.
    named = F.concat(F.lit('recordsPath "'), F.col("records_path"), F.lit('"'))
    error = (
        F.when(F.col("too_big"), F.lit(f"response is larger than {MAX_RESPONSE_BYTES} bytes"))
        .when(F.col("doc").isNull(), F.lit("decode response: not valid JSON"))
        .when(F.col("records").isNull(), F.concat(named, F.lit(" not found in response")))
        .when(
            ~is_array(F.col("records")),
            F.concat(
                named,
                F.lit(" is "),
                F.when(kind == "object", "an object").otherwise(kind),
                F.lit(", want an array"),
            ),
        )
    )
    # End of fixed values.
    return found.withColumn("page_error", error).drop("too_big")


def next_key() -> Column:
    """What a decoded page says to ask for next; null where it names nothing."""
    cursor = F.when(
        F.col("next_cursor_path").isNotNull(), dotted_text(F.col("doc"), F.col("next_cursor_path"))
    )
    kind = F.col("pagination_type")
    return F.when(kind == "Cursor", cursor).when(
        kind == "LinkHeader", next_link(header(F.col("headers"), "Link"))
    )


def page_facts(decoded: DataFrame) -> DataFrame:
    """What the walk needs to know of each page: is it in error, is it the last one.

    Carries no body, so everything after it moves only a few dozen bytes a page.
    """
    kind, following = F.col("pagination_type"), next_key()
    short = ~has_element(F.col("records"), 0) | (
        (F.col("page_size") > 0) & ~has_element(F.col("records"), F.col("page_size") - 1)
    )
    terminal = (
        F.when(kind == "None", F.lit(True))
        .when(kind == "Cursor", following.isNull() | following.eqNullSafe(F.col("request_cursor")))
        .when(kind.isin("PageNumber", "Offset"), short)
        .when(kind == "LinkHeader", following.isNull())
    )
    loops = F.col("loops") if "loops" in decoded.columns else F.lit(False)
    return decoded.select(
        "source_id",
        "run_id",
        "page_no",
        "pagination_type",
        "max_pages",
        "page_error",
        terminal.alias("terminal"),
        loops.alias("loops"),
    )


def explode_records(decoded: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per record, in page order by ``(page_no, record_pos)``.

    The generator streams elements, so a page is never held as an array of
    values each with its own copy of the key dictionary.  ``keep`` names further
    page columns to carry along.
    """
    # ``variant_explode`` would also take objects apart; a page in error has no records.
    spark = decoded.sparkSession
    good = decoded.where(F.col("page_error").isNull()).select(
        "source_id", "run_id", "page_no", *keep, "records"
    )
    rows = good.lateralJoin(spark.tvf.variant_explode(F.col("records").outer()))
    return rows.select(
        "source_id",
        "run_id",
        "page_no",
        *keep,
        F.col("pos").alias("record_pos"),
        F.col("value").alias("record"),
    )
