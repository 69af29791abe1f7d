"""Registered queries and the SQL each is checked against."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("fetching", "resuming", "shaping", "landing", "ledgers", "specifying", "streams")


def all_queries() -> dict:
    """Name -> callable ``(spark, sf_dir) -> DataFrame``."""
    found: dict = {}
    for module in _MODULES:
        found.update(import_module(f"harvestline.queries.{module}").BOOK.queries)
    return found


def all_oracles() -> dict[str, str]:
    """Name -> DuckDB SQL giving the same rows."""
    found: dict[str, str] = {}
    for module in _MODULES:
        found.update(import_module(f"harvestline.queries.{module}").BOOK.oracles)
    return found
