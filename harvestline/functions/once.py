"""Columns that are computed once a row whatever is done with them later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns as the output of a generator.

    A filter on a plain computed column is pushed below it by copying the
    expression into the filter, once for every mention, so a body parsed for its
    records would be parsed again for each check made on it.  A generator's
    output cannot be copied.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline(F.array(row)))
