"""A module's queries by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from harvestline.session import configure


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, oracle: str | None = None):
        """Register a query; without an oracle only its rows are checked."""

        def register(fn: Callable[[SparkSession, str], DataFrame]):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return fn(configure(spark), sf_dir)

            self.queries[name] = run
            if oracle is not None:
                self.oracles[name] = oracle
            return fn

        return register
