"""Queries on gap records and pixels' statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from corridor.config import CONFIG
from corridor.functions import color, labels
from corridor.operators import measure
from corridor.sources.relations import load, with_

G = with_("gaps")
C = "CASE WHEN {0} THEN 1.0 ELSE 0.0 END"


def gaps(spark, sf_dir):
    return load(spark, sf_dir, "gaps")


def gap_summary(spark, sf_dir):
    return measure.summary(gaps(spark, sf_dir))


def gap_report_reliable(spark, sf_dir):
    return measure.report(gaps(spark, sf_dir))


def gap_composition_counts(spark, sf_dir):
    return measure.counts(gaps(spark, sf_dir).where("reliable"), "composition")


def gap_percentiles(spark, sf_dir):
    return measure.percentiles(gaps(spark, sf_dir), "gap_m", ["composition"], {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9})


def lane_nunique(spark, sf_dir):
    return gaps(spark, sf_dir).groupBy("tile").agg(F.countDistinct("lane_id").alias("lanes"), F.min("x").alias("west"), F.max("x").alias("east"), F.min("y").alias("south"), F.max("y").alias("north"))


def no_strip_share(spark, sf_dir):
    return gaps(spark, sf_dir).groupBy("tile").agg(F.round(F.avg(F.when(F.col("gap_m") == 0, 1.0).otherwise(0.0)), 6).alias("share"), F.count(F.lit(1)).alias("n"))


def gap_lead_pairs(spark, sf_dir):
    return measure.neighbours(gaps(spark, sf_dir), max_jump=400.0).select("lane_id", "offset_m", "next_offset_m", "pair_gap")


def gap_quads(spark, sf_dir):
    rows = measure.quads(measure.neighbours(gaps(spark, sf_dir), max_jump=400.0))
    xy = [F.round(F.col("quad")[k][a], 6).alias(f"{a}{k}") for k in range(4) for a in ("x", "y")]
    return rows.select("lane_id", "offset_m", "colour_class", *xy)


def gap_colour_bins(spark, sf_dir):
    rows = gaps(spark, sf_dir).withColumn("bin", color.break_class(F.col("gap_m")))
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("gap_m"), 6).alias("mean_gap"))


def reliable_flag(spark, sf_dir):
    flag = labels.reliable(F.col("composition") == "asphalt", F.col("shadow_fraction"))
    return gaps(spark, sf_dir).groupBy("composition").agg(F.count_if(flag).alias("n_reliable"), F.count(F.lit(1)).alias("n"))


def gap_sink(spark, sf_dir):
    """What is written for a map: records without the lane point, by tile."""
    return gaps(spark, sf_dir).drop("x", "y").withColumn("gap_m", F.round("gap_m", 6)).groupBy("tile", "composition").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("gap_m"), 4).alias("total_gap"))


_SPANS = "lane_edge_m - road_edge_m"
_PAIRS = f"""{G}, w AS (SELECT *, lead(offset_m) OVER o AS no, lead(gap_m) OVER o AS ng, lead(x) OVER o AS nx, lead(y) OVER o AS ny,
    lead(road_edge_m) OVER o AS nr, lead(lane_edge_m) OVER o AS nl FROM gaps WINDOW o AS (PARTITION BY lane_id ORDER BY offset_m)),
    p AS (SELECT *, (gap_m + ng) / 2 AS pair_gap FROM w WHERE no - offset_m <= 3.2 AND sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) <= 400.0 AND lane_edge_m <> road_edge_m AND nl <> nr)"""
_CLASS = "CASE WHEN {0} >= 4 THEN 4 WHEN {0} >= 2 THEN 3 WHEN {0} >= 1 THEN 2 WHEN {0} >= 0.5 THEN 1 ELSE 0 END"

QUERIES = {f.__name__: f for f in (gap_summary, gap_report_reliable, gap_composition_counts, gap_percentiles, lane_nunique, no_strip_share, gap_lead_pairs, gap_quads, gap_colour_bins, reliable_flag, gap_sink)}
ORACLES = {
    "gap_summary": f"{G} SELECT count(*) AS n, count(DISTINCT lane_id) AS lanes, round(median(gap_m), 6) AS median_gap, round(avg({C.format('gap_m = 0')}), 6) AS no_strip_share FROM gaps",
    "gap_report_reliable": f"{G} SELECT count(*) FILTER (reliable) AS measured, count(*) AS total, count(*) FILTER (NOT reliable) AS in_shadow, round(median(gap_m) FILTER (reliable), 6) AS median_gap, round(100 * avg({C.format(chr(39).join(['composition = ', 'contiguous', '']))}) FILTER (reliable), 6) AS no_strip_percent FROM gaps",
    "gap_composition_counts": f"{G} SELECT composition, count(*) AS n FROM gaps WHERE reliable GROUP BY 1",
    "gap_percentiles": f"{G} SELECT composition, " + ", ".join(f"round(quantile_cont(gap_m, {p}), 6) AS p{int(p * 100)}" for p in (0.1, 0.25, 0.5, 0.75, 0.9)) + " FROM gaps GROUP BY 1",
    "lane_nunique": f"{G} SELECT tile, count(DISTINCT lane_id) AS lanes, min(x) AS west, max(x) AS east, min(y) AS south, max(y) AS north FROM gaps GROUP BY 1",
    "no_strip_share": f"{G} SELECT tile, round(avg({C.format('gap_m = 0')}), 6) AS share, count(*) AS n FROM gaps GROUP BY 1",
    "gap_lead_pairs": f"{_PAIRS} SELECT lane_id, offset_m, no AS next_offset_m, pair_gap FROM p",
    "gap_quads": f"{_PAIRS} SELECT lane_id, offset_m, {_CLASS.format('pair_gap')} AS colour_class, x AS x0, round(y + road_edge_m, 6) AS y0, x AS x1, round(y + lane_edge_m, 6) AS y1, nx AS x2, round(ny + nl, 6) AS y2, nx AS x3, round(ny + nr, 6) AS y3 FROM p",
    "gap_colour_bins": f"{G} SELECT {_CLASS.format('gap_m')} AS bin, count(*) AS n, round(avg(gap_m), 6) AS mean_gap FROM gaps GROUP BY 1",
    "reliable_flag": f"{G} SELECT composition, count(*) FILTER (composition <> 'asphalt' AND shadow_fraction < {CONFIG.shadow_run_fraction}) AS n_reliable, count(*) AS n FROM gaps GROUP BY 1",
    "gap_sink": f"{G} SELECT tile, composition, count(*) AS n, round(sum(round(gap_m, 6)), 4) AS total_gap FROM gaps GROUP BY 1, 2",
}
