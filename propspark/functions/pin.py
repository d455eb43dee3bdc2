"""Columns that are computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def pinned(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that later filters use as a value instead of repeating its expression.

    A filter on an ordinary computed column is moved below the projection and takes the whole expression with it,
    where shared parts are evaluated again for every occurrence. A one-element ``explode`` stops that; filters on
    other columns still move down through it.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c != name]
    return df.select(*kept, F.explode(F.array(value)).alias(name))
