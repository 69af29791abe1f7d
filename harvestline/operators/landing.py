"""Turning accepted records into rows, and refused ones into dead letters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from harvestline.functions.text import canonical_json, cut_bytes, digest
from harvestline.functions.variants import OBJECT_TYPE, dotted_get, kind_sql, scalar_text
from harvestline.model import (
    LANDING_TYPES,
    WAREHOUSE_TYPES,
)


def _mapped(kind: Column, table: dict[str, str], default: str) -> Column:
    out = F.lit(None).cast("string")
    for key, value in table.items():
        out = F.when(kind == key, value).otherwise(out)
    return F.coalesce(out, F.lit(default))


def table_columns(shape: DataFrame, keys: Sequence[str] = ("source_id",)) -> DataFrame:
    """K6, K7: columns a table made from a shape has: top-level paths, in order.

    A group with no top-level path yields no row; it cannot make a table.
    """
    top = shape.where(~F.col("path").contains("."))
    return top.select(
        *keys,
        F.col("path").alias("column_name"),
        F.col("type").alias("observed_type"),
        _mapped(F.col("type"), WAREHOUSE_TYPES, "STRING").alias("column_type"),
        _mapped(F.col("type"), LANDING_TYPES, "string").alias("landing_type"),
    )


def column_maps(columns: DataFrame, keys: Sequence[str] = ("source_id",)) -> DataFrame:
    """One map ``column -> landing type`` per group."""
    return columns.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("column_name", "landing_type"))).alias("target")
    )


def cell(value: Column, landing_type: str) -> Column:
    """K8: one table cell.  Nested values land as JSON text, scalars as they are."""
    if landing_type != "string":
        return value.try_cast(landing_type)
    text = F.schema_of_variant(value)
    nested = text.startswith("OBJECT<") | text.startswith("ARRAY<")
    return (
        F.when(nested, F.to_json(value))
        .when(text == "STRING", value.try_cast("string"))
        .otherwise(scalar_text(value, text))
    )


def typed_rows(records: DataFrame, columns: Sequence[tuple[str, str]], keep: Sequence[str]) -> DataFrame:
    """K8: records as table rows with the given ``(name, landing type)`` columns."""
    return records.select(
        *keep,
        *[
            cell(dotted_get(F.col("record"), name), kind).alias(landed_name(name, keep))
            for name, kind in columns
        ],
    )


def landed_name(name: str, taken: Sequence[str]) -> str:
    """K8: a record key as a column name; the table's own columns keep theirs."""
    return name if name.lower() not in {c.lower() for c in taken} else f"{name}_"


def clashing_names(shapes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """K6: top-level keys that no table can hold side by side, since only their case differs."""
    top = shapes.where(~F.col("path").contains(".")).withColumn("folded", F.lower("path"))
    several = top.groupBy(*keys, "folded").agg(F.array_sort(F.collect_set("path")).alias("names"))
    return several.where(F.size("names") > 1)


def row_reasons(record: str, target: str) -> Column:
    """K9: why a table would refuse a row; an empty list means it fits.

    ``target`` names a map from column to landing type, so one plan checks the
    rows of every source against its own table.  Text may stand for a number or
    a boolean; numbers and booleans never stand for each other.
    """
    kind = kind_sql("f.text")
    cannot = "concat('cannot convert value of ', f.key, ' to ', f.wanted)"
    return F.expr(
        f"""filter(transform(
          transform(map_entries(try_cast({record} AS {OBJECT_TYPE})), e -> named_struct(
            'key', e.key, 'value', e.value, 'wanted', {target}[e.key],
            'text', schema_of_variant(e.value))),
          f -> CASE WHEN f.wanted IS NULL THEN concat('no such field: ', f.key)
            WHEN f.text = 'VOID' OR f.wanted = 'string' THEN NULL
            WHEN f.wanted = 'double' AND ({kind} NOT IN ('number', 'string')
              OR try_cast(f.value AS double) IS NULL) THEN {cannot}
            WHEN f.wanted = 'boolean' AND ({kind} NOT IN ('bool', 'string')
              OR try_cast(f.value AS boolean) IS NULL) THEN {cannot} END),
          r -> r IS NOT NULL)"""
    )


def check_rows(records: DataFrame, targets: DataFrame, keys: Sequence[str] = ("source_id",)) -> DataFrame:
    """Add ``reasons`` to each record; ``targets`` is one row a group."""
    return records.join(targets, list(keys)).withColumn(
        "reasons", row_reasons("record", "target")
    ).drop("target")


def dead_letters(
    refused: DataFrame,
    rejected_at: Column,
    extra: Sequence[Column] = (),
    reason_bytes: int | None = None,
    payload_bytes: int | None = None,
) -> DataFrame:
    """Refused records as dead letters.

    A letter is the only copy of its record left, so it is whole.  For a sink
    with a row limit the two sizes cut reason and payload; the digest is of the
    whole payload all the same.
    """
    payload = canonical_json(F.col("record"))

    def cut(text: Column, limit: int | None) -> Column:
        return text if limit is None else cut_bytes(text, limit)

    known = "digest" in refused.columns
    return refused.select(
        "source_id",
        "run_id",
        rejected_at.alias("rejected_at"),
        cut(F.array_join("reasons", "; "), reason_bytes).alias("reason"),
        cut(payload, payload_bytes).alias("payload"),
        F.col("digest") if known else digest(payload).alias("digest"),
        *extra,
    )


def with_digest(records: DataFrame) -> DataFrame:
    """Add the record's identity and its position as one number."""
    packed = F.shiftleft(F.col("page_no").cast("bigint"), 32) + F.col("record_pos")
    return records.withColumn("digest", digest(canonical_json(F.col("record")))).withColumn(
        "at", packed
    )


def digest_index(digested: DataFrame, keys: Sequence[str] = ("source_id",)) -> DataFrame:
    """One short row per distinct record of a group: first position and copies.

    Only digests move.  Copies combine map-side, so any number of copies of one
    record reaches the shuffle as one row per task.
    """
    return digested.groupBy(*keys, "digest").agg(
        F.min("at").alias("first_at"), F.count("*").alias("copies")
    )


def dedup_records(records: DataFrame, keys: Sequence[str] = ("source_id",)) -> DataFrame:
    """Digest and first position of each distinct record of a group."""
    at = F.col("first_at")
    return digest_index(with_digest(records), keys).select(
        *keys,
        "digest",
        F.shiftright(at, 32).cast("int").alias("page_no"),
        at.bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("record_pos"),
        "copies",
    )


def first_copies(
    digested: DataFrame, repeated: DataFrame, keys: Sequence[str] = ("source_id",)
) -> DataFrame:
    """Whole records without their copies.

    ``repeated`` is the part of ``digest_index`` with more than one copy, staged:
    usually little, then broadcast, so the records themselves stay where they
    are.  When it is large Spark shuffles both sides and splits hot digests.
    """
    marks = repeated.select(*keys, "digest", "first_at")
    joined = digested.join(marks, [*keys, "digest"], "left")
    return joined.where(F.col("first_at").isNull() | (F.col("at") == F.col("first_at"))).drop(
        "first_at"
    )


def not_landed(fresh: DataFrame, landed_digests: DataFrame) -> DataFrame:
    """Drop records whose digest the target already holds.

    ``landed_digests``: ``(source_id, digest)``, staged after being cut down to
    the digests of this batch (``digest_index`` semi-joined with the target), so
    the records are not shuffled to find the few that were delivered before.
    """
    return fresh.join(landed_digests, ["source_id", "digest"], "left_anti")


_RECORD = ',"record":'


def ndjson_line(source_id: Column, run_id: Column, record: Column) -> Column:
    """K1: a record and the run it is of, as one JSON document."""
    run = F.to_json(F.struct(source_id.alias("_source_id"), run_id.alias("_run_id")))
    return F.concat(F.substring(run, F.lit(1), F.length(run) - 1), F.lit(_RECORD), canonical_json(record), F.lit("}")).alias("value")


def read_ndjson_line(line: Column) -> list[Column]:
    """K1: ``value``, ``_source_id`` and ``_run_id`` of such a line; the record's text as it was written."""
    # Quotes inside an id are escaped, so this is where the record begins.
    at = F.instr(line, _RECORD)
    start = at + len(_RECORD)
    run = F.from_json(F.concat(F.substring(line, F.lit(1), at - 1), F.lit("}")), "_source_id string, _run_id string")
    value = F.substring(line, start, F.length(line) - start)
    return [value.alias("value"), run["_source_id"].alias("_source_id"), run["_run_id"].alias("_run_id")]


def ndjson(records: DataFrame) -> DataFrame:
    """K1: one JSON document a line, ready for ``write.text``."""
    return records.select(canonical_json(F.col("record")).alias("value"))
