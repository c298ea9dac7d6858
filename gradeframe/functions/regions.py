"""Drawn regions: filters, areas, crops and overlap suppression."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gradeframe import fixed_values as fv


def area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return ((x2 - x1) * (y2 - y1)).cast("double")


def area_ratio(box_area: Column, width: Column, height: Column) -> Column:
    return F.bround(F.coalesce(F.try_divide(box_area, (width * height).cast("double")), F.lit(0.0)), 4)


def is_region_label(label: Column) -> Column:
    """Whether the lower-cased label contains one of the listed words."""
    low = F.lower(label)
    hit = F.lit(False)
    for word in fv.REGION_LABELS:
        hit = hit | low.contains(word)
    return F.coalesce(hit, F.lit(False))


def keeps_region(label: Column, confidence: Column, ratio: Column) -> Column:
    """Known label or enough confidence, and a large enough share of the page."""
    known = is_region_label(label) | (confidence >= fv.REGION_MIN_CONFIDENCE)
    return known & (ratio >= fv.REGION_MIN_AREA)


def heuristic_confidence(ratio: Column) -> Column:
    return F.bround(F.least(F.lit(0.5) + ratio, F.lit(0.85)), 3)


def padded(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column,
           padding: int = fv.CROP_PADDING) -> Column:
    """Crop box grown by ``padding`` and kept inside the page."""
    return F.struct(
        F.greatest(F.lit(0), x1 - padding).alias("x1"),
        F.greatest(F.lit(0), y1 - padding).alias("y1"),
        F.least(width, x2 + padding).alias("x2"),
        F.least(height, y2 + padding).alias("y2"),
    )


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two box structs."""
    w = F.greatest(F.lit(0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    inter = (w * h).cast("double")
    both = area(a["x1"], a["y1"], a["x2"], a["y2"]) + area(b["x1"], b["y1"], b["x2"], b["y2"])
    return inter / (both - inter + F.lit(1e-6))
