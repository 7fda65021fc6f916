"""A surface's parts joined across small gaps, with an account of what that did.

Outlines are not traced: buffering a mask out and in again is a closing, and
only areas and counts of parts are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corridor.config import CONFIG
from corridor.operators import kernels, raster


def growth(before: Column, after: Column) -> Column:
    """By how many percent an area grew; nothing counts as one unit."""
    return (after / F.greatest(before, F.lit(1)) - 1) * 100


def _account(mask: DataFrame, gsd: float, least_m2: float | None, name: str) -> tuple[DataFrame, DataFrame]:
    parts = raster.components(mask)
    if least_m2:
        parts = raster.at_least(parts, int(-(-least_m2 // gsd**2)))
    sums = raster.sizes(parts).agg(F.count(F.lit(1)).alias(f"parts_{name}"), F.coalesce(F.sum("size"), F.lit(0)).alias(f"px_{name}"))
    return parts.select("tile", "prow", "pcol"), sums.select(f"parts_{name}", (F.col(f"px_{name}") * gsd**2).alias(f"area_{name}"))


def dissolve(mask: DataFrame, frame: DataFrame, gsd: float, opening: bool = False, c=CONFIG) -> tuple[DataFrame, DataFrame]:
    """(the joined mask, one row: parts and areas before, after and, if asked for, after opening, with the changes)."""
    kept, before = _account(mask, gsd, c.min_polygon_m2, "before")
    closed = raster.closing(kept, round(c.dissolve_buffer_m / gsd), frame)
    joined, after = _account(closed, gsd, None, "after")
    row = before.crossJoin(after)  # one row each
    if opening:
        disk = kernels.disk(round(c.open_buffer_m / gsd))
        opened = raster.dilation(raster.erosion(joined, disk), disk)
        joined, last = _account(opened, gsd, c.min_polygon_m2, "open")
        row = row.crossJoin(last)
    else:
        row = row.select("*", F.lit(None).cast("long").alias("parts_open"), F.lit(None).cast("double").alias("area_open"))
    return joined, row.select(
        "*",
        (F.col("area_after") - F.col("area_before")).alias("area_added"),
        F.coalesce(F.col("area_after") - F.col("area_open"), F.lit(0.0)).alias("area_removed"),
        (F.col("parts_before") - F.col("parts_after")).alias("parts_joined"),
        growth(F.col("area_before"), F.col("area_after")).alias("growth_percent"),
    )
