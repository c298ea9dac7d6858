"""Per-page region tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gradeframe import fixed_values as fv
from gradeframe.functions import regions as rg


def suppress_overlaps(boxes: DataFrame, keys: Sequence[str],
                      threshold: float = fv.OVERLAP_THRESHOLD) -> DataFrame:
    """Greedy suppression per page: larger boxes first, overlapping ones dropped.

    Equal boxes suppress each other, so they are reduced to one before the
    shuffle. Equal areas are taken in coordinate order. A page is one image, so
    its distinct boxes form one small array that is folded inside a row.
    """
    keys = list(keys)
    corners = ["x1", "y1", "x2", "y2"]
    distinct = boxes.select(*keys, *corners).distinct()
    size = rg.area(*[F.col(c) for c in corners])
    ordered = F.array_sort(F.collect_list(F.struct((-size).alias("rank"), *corners)))

    def fold(kept: Column, box: Column) -> Column:
        clash = F.exists(kept, lambda k: rg.overlap(k, box) >= threshold)
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(box)))

    return (
        distinct.groupBy(*keys)
        .agg(ordered.alias("_b"))
        .select(*keys, F.inline(F.aggregate("_b", F.slice("_b", 1, 0), fold)))
        .drop("rank")
    )


def primary_region(regions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The region with the largest share of its page; coordinates break ties."""
    rank = F.struct("area_ratio", -F.col("x1"), -F.col("y1"), -F.col("x2"), -F.col("y2"))
    rest = [c for c in regions.columns if c not in keys]
    return regions.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_r")).select(
        *keys, "_r.*"
    )
