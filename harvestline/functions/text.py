"""Digests and byte-bounded text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from harvestline.model import FINGERPRINT_HEX


def cut_bytes(text: Column, limit: int) -> Column:
    """O3: at most ``limit`` bytes of UTF-8, mended when the cut lands inside a character."""
    cut = F.substring(text.cast("binary"), 1, limit).cast("string")
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.make_valid_utf8(cut))


def digest(text: Column) -> Column:
    """Hex SHA-256."""
    return F.sha2(text, 256)


def short_digest(text: Column, length: int = FINGERPRINT_HEX) -> Column:
    return F.substring(digest(text), 1, length)


def canonical_json(record: Column) -> Column:
    """Compact JSON with sorted keys, the text a record's digest is taken of."""
    return F.to_json(record)


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))
