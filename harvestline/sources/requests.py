"""The requests a run would send, as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from harvestline.functions.web import query_escape
from harvestline.model import DEFAULT_PAGINATION


def _own_query(query: Column) -> Column:
    """Parameters already in the configured URL, decoded, in their order."""
    parts = F.filter(
        F.transform(
            F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.contains(";")),
            lambda p: F.struct(
                F.try_url_decode(F.split(p, "=", 2)[0]).alias("k"),
                F.try_url_decode(
                    F.coalesce(F.try_element_at(F.split(p, "=", 2), F.lit(2)), F.lit(""))
                ).alias("v"),
            ),
        ),
        lambda e: e["k"].isNotNull() & e["v"].isNotNull(),
    )
    return F.coalesce(parts, F.array().cast("array<struct<k:string,v:string>>"))


def _param(name: Column, value: Column) -> Column:
    """A one-entry list, or an empty one when the name or value is missing."""
    present = (F.coalesce(name, F.lit("")) != "") & value.isNotNull()
    return F.when(
        present, F.array(F.struct(name.alias("k"), value.cast("string").alias("v")))
    ).otherwise(F.array().cast("array<struct<k:string,v:string>>"))


def page_position(first: Column, index: Column, kind: Column, size: Column) -> Column:
    """Page number or offset of the ``index``-th request (from zero)."""
    start = F.when((kind == "PageNumber") & (first == 0), 1).otherwise(first)
    step = F.when(kind == "Offset", size).otherwise(1)
    return start + index * step


def plan_requests(specs: DataFrame, bounds: DataFrame, steps: DataFrame) -> DataFrame:
    """Request URLs, one per row of ``steps``.

    ``bounds``: ``(source_id, from_value, to_value)``.
    ``steps``: ``(source_id, page_index, cursor, next_url)``; the index counts
    requests from zero, the last two come from the page before.
    """
    wm, page, src = F.col("watermark"), F.col("source.pagination"), F.col("source")
    kind = F.coalesce(F.nullif(page["type"], F.lit("")), F.lit(DEFAULT_PAGINATION))
    size = F.coalesce(page["page_size"], F.lit(0))
    position = page_position(
        F.coalesce(page["start_page"], F.lit(0)), F.col("page_index"), kind, size
    )
    static = F.coalesce(
        F.transform(
            F.map_entries(src["query"]),
            lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")),
        ),
        F.array().cast("array<struct<k:string,v:string>>"),
    )
    lower = F.nullif(F.col("from_value"), F.lit(""))
    upper = F.nullif(F.col("to_value"), F.lit(""))
    # Later entries win over earlier ones of the same name.
    settings = F.concat(
        static,
        _param(wm["param"], lower),
        _param(F.when(F.coalesce(wm["param"], F.lit("")) != "", wm["to_param"]), upper),
        _param(
            F.when(kind == "Cursor", page["cursor_param"]), F.nullif(F.col("cursor"), F.lit(""))
        ),
        _param(F.when(kind.isin("PageNumber", "Offset"), page["page_param"]), position),
        _param(F.when(size > 0, page["size_param"]), size),
    )
    last_wins = F.filter(
        settings,
        lambda e, i: ~F.exists(
            F.slice(settings, i + 2, F.greatest(F.size(settings) - i - 1, F.lit(0))),
            lambda later: later["k"] == e["k"],
        ),
    )
    bare = F.split(F.split(src["url"], "#", 2)[0], r"\?", 2)
    own = F.filter(
        _own_query(F.try_element_at(bare, F.lit(2))),
        lambda e: ~F.exists(settings, lambda s: s["k"] == e["k"]),
    )
    numbered = F.transform(
        F.concat(own, last_wins), lambda e, i: F.struct(e["k"].alias("k"), i.alias("i"), e["v"].alias("v"))
    )
    query = F.array_join(
        F.transform(
            F.array_sort(numbered),
            lambda e: F.concat(query_escape(e["k"]), F.lit("="), query_escape(e["v"])),
        ),
        "&",
    )
    fragment = F.try_element_at(F.split(src["url"], "#", 2), F.lit(2))
    built = F.concat(
        bare[0],
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
        F.coalesce(F.concat(F.lit("#"), fragment), F.lit("")),
    )
    url = F.coalesce(F.nullif(F.col("next_url"), F.lit("")), built)
    planned = (
        steps.join(specs.select("source_id", "source", "watermark"), "source_id")
        .join(bounds.select("source_id", "from_value", "to_value"), "source_id", "left")
    )
    return planned.select("source_id", "page_index", url.alias("url"))


def counted_steps(specs: DataFrame, pages: Column) -> DataFrame:
    """Steps of the page-number and offset styles, whose requests are known up front."""
    return specs.where(F.col("source.pagination.type").isin("PageNumber", "Offset")).select(
        "source_id",
        F.explode(F.sequence(F.lit(0), pages - 1)).alias("page_index"),
        F.lit(None).cast("string").alias("cursor"),
        F.lit(None).cast("string").alias("next_url"),
    )
