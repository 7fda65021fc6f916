"""Gap records: summaries, shares, neighbouring sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corridor.config import CONFIG
from corridor.functions import color, labels


def summary(gaps: DataFrame) -> DataFrame:
    """Measured rows, lanes, median gap and the share without a strip."""
    return gaps.agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("lane_id").alias("lanes"),
        F.round(F.median("gap_m"), 6).alias("median_gap"),
        F.round(F.avg(F.when(F.col("gap_m") == 0, 1.0).otherwise(0.0)), 6).alias("no_strip_share"),
    )


def report(gaps: DataFrame) -> DataFrame:
    """What a report says: measured and total, in shadow, median and share of the reliable rows."""
    ok = F.col("reliable")
    return gaps.agg(
        F.count_if(ok).alias("measured"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(~ok).alias("in_shadow"),
        F.round(F.median(F.when(ok, F.col("gap_m"))), 6).alias("median_gap"),
        F.round(100 * F.avg(F.when(ok, F.when(F.col("composition") == "contiguous", 1.0).otherwise(0.0))), 6).alias("no_strip_percent"),
    )


def counts(rows: DataFrame, by: str) -> DataFrame:
    """Rows by value, the most frequent first."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by)


def percentiles(rows: DataFrame, value: str, by: list[str], shares: dict[str, float]) -> DataFrame:
    """Exact interpolated percentiles by group."""
    return rows.groupBy(*by).agg(*[F.round(F.percentile(value, F.lit(p)), 6).alias(n) for n, p in shares.items()])


def neighbours(gaps: DataFrame, max_step: float = 3.2, max_jump: float = 5.0) -> DataFrame:
    """Sections of a lane paired with the next one, if near enough; value is the mean of both gaps."""
    w = Window.partitionBy("lane_id").orderBy("offset_m")
    nxt = {c: F.lead(c).over(w) for c in ("offset_m", "gap_m", "x", "y", "road_edge_m", "lane_edge_m")}
    rows = gaps.select("*", *[v.alias(f"next_{c}") for c, v in nxt.items()])
    jump = F.hypot(F.col("next_x") - F.col("x"), F.col("next_y") - F.col("y"))
    span = lambda p: F.col(f"{p}lane_edge_m") - F.col(f"{p}road_edge_m")
    near = (F.col("next_offset_m") - F.col("offset_m") <= max_step) & (jump <= max_jump) & (span("") != 0) & (span("next_") != 0)
    return rows.where(near).withColumn("pair_gap", (F.col("gap_m") + F.col("next_gap_m")) / 2)


def quads(pairs: DataFrame) -> DataFrame:
    """The four corners of the ribbon between two neighbouring sections (across is taken along y)."""
    corner = lambda p, e: F.struct(F.col(f"{p}x").alias("x"), (F.col(f"{p}y") + F.col(f"{p}{e}")).alias("y"))
    ring = F.array(corner("", "road_edge_m"), corner("", "lane_edge_m"), corner("next_", "lane_edge_m"), corner("next_", "road_edge_m"))
    return pairs.withColumn("quad", ring).withColumn("colour_class", color.break_class(F.col("pair_gap")))


def skip_reason(c=CONFIG) -> Column:
    """Why a candidate section is not measured, the first test that fails; null if it is."""
    return (
        F.when(F.col("separation").isNull(), "far")
        .when(~F.col("in_frame"), "off")
        .when(F.col("near_edge"), "shadow")
        .when(~F.col("has_run") | F.col("lane_edge_m").isNull(), "unresolved")
    )


def osm_gap(lane_edge: Column, road_width: Column) -> Column:
    return F.when(lane_edge.isNotNull() & road_width.isNotNull(), F.greatest(lane_edge - road_width / 2, F.lit(0.0)))


def composition_osm(runs: Column, road_edge: Column, lane_edge: Column, lane_start: Column) -> Column:
    """Runs that overlap the strip between road and lane, but not the lane's own, name it."""
    gap = F.greatest(lane_edge - road_edge, F.lit(0.0))
    between = F.filter(runs, lambda r: (r["end_m"] > road_edge) & (r["start_m"] < lane_edge) & (r["start_m"] != lane_start))
    return labels.composition(gap, between)


def composition_pixel(runs: Column, lane_start: Column, carriage_end: Column) -> Column:
    """The pixel branch: only runs wholly between the carriageway's and the lane's run count."""
    gap = F.greatest(lane_start - carriage_end, F.lit(0.0))
    between = F.filter(runs, lambda r: (r["start_m"] >= carriage_end) & (r["end_m"] <= lane_start))
    return labels.composition(gap, between)


def tile_stats(pixels: DataFrame, bands: list[str]) -> DataFrame:
    """Per tile and band: least, largest, mean, deviation."""
    long = pixels.select("tile", F.explode(F.create_map(*[x for b in bands for x in (F.lit(b), F.col(b).cast("double"))])).alias("band", "v"))
    return long.groupBy("tile", "band").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("deviation"), F.count("v").alias("n"))


def way_widths(samples: DataFrame, least: int = CONFIG.min_samples_per_way) -> DataFrame:
    """Width samples of a way put together; ways with too few samples go."""
    return (
        samples.groupBy("way_id")
        .agg(
            F.round(F.median("width_m"), 6).alias("width_median_m"),
            F.round(F.avg("width_m"), 6).alias("width_mean_m"),
            F.min("width_m").alias("width_min_m"),
            F.max("width_m").alias("width_max_m"),
            F.count(F.lit(1)).alias("n_samples"),
            F.round(F.avg(F.col("buffer_limited").cast("double")), 6).alias("buffer_limited_fraction"),
            F.round(F.avg(F.col("unbounded").cast("double")), 6).alias("unbounded_fraction"),
        )
        .where(F.col("n_samples") >= least)
    )
