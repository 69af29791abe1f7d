"""Comparable keys for resume values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Accepted spellings of the two ordered formats.
RFC3339_PATTERN = (
    r"^\d{4}-\d{2}-\d{2}T\d{1,2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})$"
)
INTEGER_PATTERN = r"^[+-]?[0-9]+$"
# End of fixed values.

KEY_TYPE = "struct<major:bigint,minor:int>"


def _key(major: Column, minor: Column | int) -> Column:
    minor = F.lit(minor) if isinstance(minor, int) else minor
    return F.when(
        major.isNotNull(), F.struct(major.alias("major"), minor.cast("int").alias("minor"))
    )


def rfc3339_key(text: Column) -> Column:
    """Instant as (microseconds, nanoseconds below that); NULL when not RFC 3339.

    Spark's own cast is faster than any format parser but takes bare dates, so
    the pattern decides what counts as a timestamp.
    """
    valid = F.when(text.rlike(RFC3339_PATTERN), F.translate(text, ",", "."))
    micros = F.unix_micros(valid.try_cast("timestamp"))
    fraction = F.regexp_extract(valid, r"\.(\d+)", 1)
    below = F.when(
        F.length(fraction) > 6, F.substring(F.rpad(fraction, 9, "0"), 7, 3).try_cast("int")
    ).otherwise(0)
    return _key(micros, below)


def unix_key(text: Column) -> Column:
    """Signed 64-bit seconds; NULL when not an integer or out of range."""
    return _key(F.when(text.rlike(INTEGER_PATTERN), text.try_cast("bigint")), 0)


def order_key(text: Column, fmt: Column | str) -> Column:
    """Key for a value under its source's format; NULL means "no order"."""
    fmt = F.lit(fmt) if isinstance(fmt, str) else fmt
    return (
        F.when(F.coalesce(fmt, F.lit("")).isin("", "RFC3339"), rfc3339_key(text))
        .when(fmt == "UnixSeconds", unix_key(text))
        .otherwise(F.lit(None).cast(KEY_TYPE))
    )


def key_seconds(key: Column, fmt: Column | str) -> Column:
    """Key as fractional epoch seconds (RFC 3339) or whole seconds (unix)."""
    fmt = F.lit(fmt) if isinstance(fmt, str) else fmt
    return F.when(fmt == "UnixSeconds", key["major"].cast("double")).otherwise(
        key["major"] / F.lit(1e6)
    )
