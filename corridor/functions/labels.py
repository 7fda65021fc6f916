"""Labels by rule: road classes, materials, and what lies between lane and road."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from corridor import config as C

LINES = ("LineString", "MultiLineString")


def category(highway="highway", bicycle="bicycle", keys=C.CYCLEWAY_KEYS) -> Column:
    """bikelane or street, from the tags of a way."""
    bike = F.coalesce(F.col(highway).isin(*C.BIKE_LANE_HIGHWAY_VALUES), F.lit(False)) | F.coalesce(F.col(bicycle) == "designated", F.lit(False))
    for k in keys:
        bike |= F.coalesce(F.col(k).isin(*C.BIKE_LANE_CYCLEWAY_VALUES), F.lit(False))
    return F.when(bike, "bikelane").otherwise("street")


def wanted(highway="highway", bicycle="bicycle", keys=C.CYCLEWAY_KEYS) -> Column:
    """Ways that carry any of the tags asked for."""
    out = F.coalesce(F.col(highway).isin(*C.BIKE_LANE_HIGHWAY_VALUES, *C.STREET_HIGHWAY_VALUES), F.lit(False)) | F.coalesce(F.col(bicycle) == "designated", F.lit(False))
    for k in keys:
        out |= F.col(k).isNotNull()
    return out


def is_line(kind="kind") -> Column:
    return F.col(kind).isin(*LINES)


def road_width(highway="highway") -> Column:
    widths = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in C.ROAD_WIDTH_M.items()))
    return F.coalesce(F.try_element_at(widths, F.coalesce(F.col(highway), F.lit(""))), F.lit(C.ROAD_WIDTH_FALLBACK_M))


def material(shadow_fraction: Column, in_marking: Column, ndvi: Column, redness: Column, brightness: Column, c=C.CONFIG) -> Column:
    """The first rule that holds names a run."""
    return (
        F.when(shadow_fraction >= c.shadow_run_fraction, C.SHADOW_UNKNOWN)
        .when(in_marking, C.MARKING)
        .when(ndvi > c.ndvi_vegetation, C.VEGETATION)
        .when(redness > c.redness_paint, C.RED_PAINT)
        .when(brightness > c.brightness_marking, C.MARKING)
        .otherwise(C.ASPHALT)
    )


def is_illumination(material_: Column, illumination: Column, c=C.CONFIG) -> Column:
    """An edge whose light changes far more than its material."""
    return illumination > c.illumination_ratio * F.greatest(material_, F.lit(1e-9))


def composition(gap: Column, runs: Column) -> Column:
    """From the runs between road and lane, an array of (start_m, end_m, label)."""
    shadow = F.exists(runs, lambda r: r["label"] == C.SHADOW_UNKNOWN)
    # widest first, of equal widths the one that starts first
    by_width = F.array_sort(F.transform(runs, lambda r: F.struct((r["start_m"] - r["end_m"]).alias("w"), r["start_m"].alias("s"), r["label"].alias("label"))))
    return (
        F.when(gap <= 0, "contiguous")
        .when(F.size(runs) == 0, "abutting")
        .when(shadow, C.SHADOW_UNKNOWN)
        .otherwise(F.get(by_width, F.lit(0))["label"])
    )


def reliable(shadow: Column, fraction: Column, c=C.CONFIG) -> Column:
    return ~shadow & (fraction < c.shadow_run_fraction)


def within(x: Column, start: Column, end: Column) -> Column:
    """A run holds both its ends."""
    return (x >= start) & (x <= end)


def remaining(done: Column, total: Column, elapsed_s: Column) -> Column:
    """Seconds that the rest takes at the rate so far; null before anything is done."""
    return F.when(done > 0, elapsed_s / done * (total - done))
