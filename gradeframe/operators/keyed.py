"""First row per key without a window: partial aggregation keeps hot keys cheap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def _pick(df: DataFrame, keys: Sequence[str], chooser, order: Sequence[Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    picked = df.groupBy(*keys).agg(chooser(F.struct(*rest), rank).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def first_per_key(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The row with the smallest ``order`` for every key.

    ``order`` must be unique within a key for the result to be repeatable.
    """
    return _pick(df, keys, F.min_by, order)


def last_per_key(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The row with the largest ``order`` for every key."""
    return _pick(df, keys, F.max_by, order)
