"""Boxes [left, top, right, bottom] as structs of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return F.struct(left.cast("double").alias("l"), top.cast("double").alias("t"), right.cast("double").alias("r"), bottom.cast("double").alias("b"))


def area(x: Column) -> Column:
    return (x["r"] - x["l"]) * (x["b"] - x["t"])


def intersection(x: Column, y: Column) -> Column:
    w = F.least(x["r"], y["r"]) - F.greatest(x["l"], y["l"])
    h = F.least(x["b"], y["b"]) - F.greatest(x["t"], y["t"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(x: Column, y: Column) -> Column:
    i = intersection(x, y)
    return F.coalesce(F.try_divide(i, area(x) + area(y) - i), F.lit(0.0))


def overlap_ratio(x: Column, y: Column) -> Column:
    return F.coalesce(F.try_divide(intersection(x, y), F.least(area(x), area(y))), F.lit(0.0))


def overlaps(x: Column, y: Column) -> Column:
    return intersection(x, y) > 0


def contained(outer: Column, inner: Column, tolerance: float = 0.0) -> Column:
    return (inner["l"] >= outer["l"] - tolerance) & (inner["t"] >= outer["t"] - tolerance) & (inner["r"] <= outer["r"] + tolerance) & (inner["b"] <= outer["b"] + tolerance)


def center_in(outer: Column, inner: Column) -> Column:
    x, y = (inner["l"] + inner["r"]) / 2, (inner["t"] + inner["b"]) / 2
    return x.between(outer["l"], outer["r"]) & y.between(outer["t"], outer["b"])


def tile_starts(height: Column, tile: int, overlap: int) -> Column:
    """Starts of overlapping tiles; the last one ends with the page."""
    step = tile - overlap
    starts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((height - overlap) / step).cast("int") - 1)), lambda k: F.greatest(F.lit(0), F.least(k * step, height - tile)))
    return F.array_distinct(starts)


def flipped(x: Column, height: float) -> Column:
    """x with the vertical axis turned round on a page of height."""
    return box(x["l"], F.lit(height) - x["b"], x["r"], F.lit(height) - x["t"])


def scaled(x: Column, factor: float) -> Column:
    return box(x["l"] * factor, x["t"] * factor, x["r"] * factor, x["b"] * factor)
