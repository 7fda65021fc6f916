"""Queries on detectors, run on the phantom tile."""

from __future__ import annotations

from pyspark.sql import functions as F

from corridor.operators import detect, embed, measure, raster, scan
from corridor.plans.detect import HEIGHT, PHANTOM, WIDTH
from corridor.sources.relations import load, with_

KEY = ("tile", "prow", "pcol")
SIZE, STRIDE = 10, 5
T = with_("phantom")


def phantom(spark, sf_dir):
    return load(spark, sf_dir, "phantom")


def references(pixels):
    """Crops of the phantom itself: windows that lie in one material."""
    rows = embed.descriptor(pixels, SIZE, STRIDE)
    label = F.expr(f"CASE WHEN win_row >= 140 AND win_row + {SIZE} <= 160 THEN 'bikelane' WHEN win_row + {SIZE} <= 126 THEN 'road' WHEN win_row >= 126 AND win_row + {SIZE} <= 140 THEN 'negative' END")
    return rows.withColumn("label", label).where("label IS NOT NULL").select("label", F.concat_ws("_", "win_row", "win_col").alias("stem"), "embedding")


def texture_scores(spark, sf_dir):
    px = phantom(spark, sf_dir)
    scores = detect.lane_detector(SIZE, STRIDE).scores(px, references(px))
    return scores.groupBy("win_row").agg(F.round(F.avg("score"), 6).alias("score"), F.count(F.lit(1)).alias("n"))


def texture_hits(spark, sf_dir):
    """Rows of windows that count as lane, with how many of them."""
    px = phantom(spark, sf_dir)
    hits, mask = detect.lane_detector(SIZE, STRIDE).predict(px, references(px))
    return hits.join(mask.groupBy("tile").agg(F.count(F.lit(1)).alias("n_px"), F.min("prow").alias("top"), F.max("prow").alias("bottom")), "tile").withColumn("score", F.round("score", 6))


def road_scores(spark, sf_dir):
    px = phantom(spark, sf_dir)
    scores = detect.road_detector(SIZE, STRIDE).scores(px, references(px))
    return scores.groupBy("win_row").agg(F.round(F.avg("score"), 6).alias("score"), F.count_if(embed.beats(detect.CONFIG.road_score)).alias("hits"))


def lane_bands(spark, sf_dir):
    """The lane as traced: its parts with their rows."""
    px = phantom(spark, sf_dir)
    parts = detect.lane_bands(px, px.where("lane AND pcol % 50 < 40").select(*KEY), 0.1)
    return parts.groupBy("comp").agg(F.count(F.lit(1)).alias("n_px"), F.min("prow").alias("top"), F.max("prow").alias("bottom"))


def lane_centerlines(spark, sf_dir):
    px = phantom(spark, sf_dir)
    out = detect.centerlines(px.where("lane").select(*KEY), PHANTOM, 0.1, 800)
    return out.select("lane_id", "seq", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def road_surface(spark, sf_dir):
    """Parts of the road's surface, shadows and their margin taken out."""
    px = phantom(spark, sf_dir)
    coarse, shadow = px.where("prow < 120").select(*KEY), px.where("prow < 120 AND pcol BETWEEN 195 AND 204").select(*KEY)
    return detect.part_sizes(detect.road_surface(px.where("prow < 120 AND NOT pcol BETWEEN 185 AND 214"), coarse, shadow, 0.1))


def class_surface(spark, sf_dir):
    streets = spark.createDataFrame([(1, "residential", 0.0, 10.02, 40.0, 10.02)], "feature_id long, highway string, x0 double, y0 double, x1 double, y1 double")
    return detect.class_surface(phantom(spark, sf_dir), streets, PHANTOM)


def detect_roads(spark, sf_dir):
    """Widths along ways on the class's surface."""
    ways = spark.createDataFrame([(1, 0.0, 10.02, 40.0, 10.02), (2, 0.0, 18.0, 40.0, 18.0)], "way_id long, x0 double, y0 double, x1 double, y1 double")
    rows, _ = detect.detect_roads(class_surface(spark, sf_dir), ways, PHANTOM, HEIGHT, WIDTH, 0.1)
    return rows


def lanes_measured(spark, sf_dir):
    """From a lane mask to gap records: centre lines found, their sections measured."""
    from corridor.operators import sections
    from corridor.sources.store import materialise

    px = phantom(spark, sf_dir)
    lines = materialise(detect.as_segments(detect.centerlines(px.where("lane").select(*KEY), PHANTOM, 0.1, 800)), "lanes")
    roads = spark.createDataFrame([(1, "residential", 0.0, 10.02, 40.0, 10.02)], "feature_id long, highway string, x0 double, y0 double, x1 double, y1 double")
    rows = sections.measure_gaps(px.withColumns({"shadow": F.lit(False), "near_edge": F.lit(False)}), lines, roads, PHANTOM, "phantom", HEIGHT, WIDTH)
    return measure.counts(rows.where("skip IS NULL").withColumn("gap", F.round("gap_m", 2).cast("string")), "gap")


def window_components(spark, sf_dir):
    """Hits put together to parts."""
    px = phantom(spark, sf_dir)
    mask = scan.paint(scan.windows(px, SIZE, STRIDE).where("win_row % 25 = 0 AND win_col % 20 = 0"), SIZE)
    return raster.sizes(raster.components(mask.select(*KEY))).groupBy("size").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (texture_scores, texture_hits, road_scores, lane_bands, lane_centerlines, road_surface, class_surface, detect_roads, lanes_measured, window_components)}
ORACLES = {
    # rows 2.75 m either way of y = 10.02, by pixel centres
    "class_surface": f"{T} SELECT tile, prow, pcol FROM phantom WHERE abs(pcol + 0.5 - least(400, greatest(0, pcol + 0.5))) = 0 AND abs(prow + 0.5 - (20 - 10.02) / 0.1) <= 27.5",
    "window_components": "SELECT 100 AS size, count(*) AS n FROM range(0, 191, 25) r, range(0, 391, 20) c",
}
