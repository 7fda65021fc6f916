"""Queries on pixels: colour, masks, Otsu's threshold, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import functions as F

from corridor.config import CONFIG
from corridor.functions import color, geometry
from corridor.operators import kernels, measure, raster
from corridor.sources.relations import load, with_

P = with_("pixels")
ROAD = "(prow + 2 * pcol) % 7 <> 0"
KEY = ("tile", "prow", "pcol")


def pixels(spark, sf_dir):
    return load(spark, sf_dir, "pixels")


def r6(x, name):
    return F.round(x, 6).alias(name)


def spectral_features(spark, sf_dir):
    return pixels(spark, sf_dir).select(*KEY, *[r6(v, k) for k, v in color.spectral().items()])


def blue_excess(spark, sf_dir):
    return pixels(spark, sf_dir).select(*KEY, r6(color.blue_excess("r", "b"), "excess"))


def _hsv(df):
    return df.select("*", *[v.alias(k) for k, v in color.hsv().items()])


def hsv_from_rgb(spark, sf_dir):
    return _hsv(pixels(spark, sf_dir)).select(*KEY, *[r6(F.col(c), c) for c in "hsv"], r6(color.red_distance(F.col("h")), "red_distance"))


def red_boost(spark, sf_dir):
    df = _hsv(pixels(spark, sf_dir)).withColumn("s2", color.boosted_saturation(F.col("h"), F.col("s"), F.expr(ROAD)))
    out = color.rgb(F.col("h"), F.col("s2"), F.col("v"))
    fits = F.col("s2") != F.col("s")
    return df.groupBy(fits.alias("boosted")).agg(F.count(F.lit(1)).alias("n")).join(
        df.select(fits.alias("boosted"), *[v.alias(f"{k}2") for k, v in out.items()]).groupBy("boosted").agg(F.min("r2").alias("low_r"), F.max("g2").alias("high_g")), "boosted"
    ).select("boosted", "n")


def hsv_round_trip(spark, sf_dir):
    """Pixels whose channels come back, within the one that truncation may take."""
    df = _hsv(pixels(spark, sf_dir))
    back = color.rgb(F.col("h"), F.col("s"), F.col("v"))
    near = F.lit(True)
    for k, v in back.items():
        near &= F.abs(v - F.col(k)) <= 1
    return df.agg(F.count_if(near).alias("n_near"), F.count(F.lit(1)).alias("n"))


def paint_mask(spark, sf_dir):
    df = _hsv(pixels(spark, sf_dir))
    return df.where(color.is_paint(F.col("h"), F.col("s"), F.expr(ROAD))).select(*KEY)


def classify_pixels(spark, sf_dir):
    return pixels(spark, sf_dir).select(*KEY, color.classify(F.expr("prow % 5 = 0"), F.expr(ROAD)).alias("class"))


def nodata_mask(spark, sf_dir):
    return pixels(spark, sf_dir).select(*KEY, *[color.nodata(F.col(c), F.expr(ROAD)).alias(c) for c in ("r", "g", "b", "nir")])


def filtered_tile(spark, sf_dir):
    """The six bands of a filtered tile: the image where the mask is, the class, the shadow."""
    df = pixels(spark, sf_dir)
    shadow = raster.shadow_mask(df, F.expr(ROAD)).withColumn("shadow", F.lit(1))
    df = df.join(shadow, list(KEY), "left")
    return df.select(*KEY, *[color.nodata(F.col(c), F.expr(ROAD)).alias(c) for c in ("r", "g", "b", "nir")], color.classify(F.expr("prow % 5 = 0"), F.expr(ROAD)).alias("class"), F.coalesce("shadow", F.lit(0)).alias("shadow"))


def _a(df):
    return df.where("r >= 128").select(*KEY)


def _b(df):
    return df.where("g >= 128").select(*KEY)


def mask_union(spark, sf_dir):
    df = pixels(spark, sf_dir)
    return _a(df).union(_b(df)).distinct()


def mask_intersect(spark, sf_dir):
    df = pixels(spark, sf_dir)
    return _a(df).intersect(_b(df))


def mask_except(spark, sf_dir):
    df = pixels(spark, sf_dir)
    return _a(df).exceptAll(_b(df))


def mask_fraction(spark, sf_dir):
    df = pixels(spark, sf_dir)
    return df.groupBy("tile").agg(F.count_if(F.expr(ROAD)).alias("road_px"), F.round(F.avg(F.when(F.expr(ROAD), 1.0).otherwise(0.0)), 6).alias("fraction"), F.round(F.count_if(F.expr(f"{ROAD} AND nir < 60")) / F.greatest(F.lit(1), F.count_if(F.expr(ROAD))), 6).alias("cut_ratio"))


def ground_filter(spark, sf_dir):
    """Road pixels that are no vegetation."""
    return pixels(spark, sf_dir).where(F.expr(ROAD) & (color.spectral()["ndvi"] < CONFIG.ndvi_vegetation)).select(*KEY)


def value_histogram(spark, sf_dir):
    return raster.histogram(pixels(spark, sf_dir).withColumn("v", F.col("r").cast("double")), "v").select("tile", "bin", "n", r6(F.col("centre"), "centre"))


def otsu_threshold(spark, sf_dir):
    df = pixels(spark, sf_dir).where(ROAD).withColumn("excess", color.blue_excess("r", "b"))
    return raster.otsu(df, "excess").select("tile", r6(F.col("threshold"), "threshold"))


def shadow_mask_raw(spark, sf_dir):
    return raster.shadow_mask(pixels(spark, sf_dir), F.expr(ROAD))


def box_mean_density(spark, sf_dir):
    out = raster.box_mean(pixels(spark, sf_dir), "r", F.expr(ROAD), 3)
    return out.select(*KEY, r6(F.col("mean"), "mean"), r6(F.col("density"), "density"))


def _sparse(df):
    return df.where("r % 16 = 0").select(*KEY)


def dilate_l1(spark, sf_dir):
    return raster.dilation(_sparse(pixels(spark, sf_dir)), kernels.diamond(2))


def dilate_disk(spark, sf_dir):
    return raster.dilation(_sparse(pixels(spark, sf_dir)), kernels.disk(2))


def erode_disk(spark, sf_dir):
    return raster.erosion(pixels(spark, sf_dir).where("r >= 64").select(*KEY), kernels.disk(1))


def scan_windows(spark, sf_dir):
    from corridor.operators import scan

    return scan.windows(pixels(spark, sf_dir), 22, 11)


def score_map(spark, sf_dir):
    from corridor.operators import scan

    df = pixels(spark, sf_dir)
    scored = scan.windows(df, 22, 11).withColumn("score", F.expr("(win_row * 7 + win_col * 3) % 100 / CAST(128 AS DOUBLE) - 0.375"))
    return scan.score_map(scored, 22).select(*KEY, r6(F.col("score"), "score"))


def hit_pixels(spark, sf_dir):
    """A detection's mask and its mean score: the windows that beat the threshold, put together."""
    from corridor.operators import scan

    df = pixels(spark, sf_dir)
    scored = scan.windows(df, 22, 11).withColumn("score", F.expr("(win_row * 7 + win_col * 3) % 100 / CAST(128 AS DOUBLE) - 0.375"))
    hits, mask = scan.detect(scored, 22, CONFIG.lane_score)
    return mask.groupBy("tile").agg(F.count(F.lit(1)).alias("n_px")).join(hits.withColumn("score", F.round("score", 6)), "tile")


def affine_roundtrip(spark, sf_dir):
    x, y = geometry.to_world(F.col("prow"), F.col("pcol"), 0.25, -0.25, 406000.0, 5758000.0)
    df = pixels(spark, sf_dir).select(*KEY, x.alias("x"), y.alias("y"))
    row, col = geometry.to_pixel(F.col("x") + 0.0625, F.col("y") - 0.0625, 0.25, -0.25, 406000.0, 5758000.0)
    return df.select(*KEY, "x", "y", geometry.truncate(row).alias("row2"), geometry.truncate(col).alias("col2"))


def union_bounds(spark, sf_dir):
    return pixels(spark, sf_dir).groupBy("tile").agg(F.min("pcol").alias("west"), F.min("prow").alias("north"), (F.max("pcol") + 1).alias("east"), (F.max("prow") + 1).alias("south"))


def tile_stats(spark, sf_dir):
    return measure.tile_stats(pixels(spark, sf_dir), ["r", "g", "b"])


def window_read(spark, sf_dir):
    """Three bands of a window of the tile: a pruned scan with pushed bounds."""
    return pixels(spark, sf_dir).where("prow BETWEEN 2 AND 5 AND pcol BETWEEN 10 AND 59").select(*KEY, "r", "g", "b")


def preview_grey(spark, sf_dir):
    df = pixels(spark, sf_dir).where("prow % 3 = 0 and pcol % 3 = 0")
    return df.select(*KEY, r6(color.grey(), "grey"), r6(color.blend(color.grey(), 0.0, 0.25), "dark"))


def overlay(spark, sf_dir):
    df = pixels(spark, sf_dir)
    heat = color.heat(F.col("r") / F.lit(255.0) - 0.5)
    red = color.hex_channel(F.lit("#ff7800"), 1)
    return df.select(*KEY, r6(color.blend(F.col("g"), 120.0, 0.4), "blended"), r6(heat, "heat"), red.alias("green"), r6(color.scaled(F.col("b") / 10, *CONFIG.width_color_m), "width_colour"))


_HSV = f"""{P}, m AS (SELECT *, greatest(r, g, b) / 255.0::DOUBLE AS mx, least(r, g, b) / 255.0::DOUBLE AS mn, r / 255.0::DOUBLE AS rr, g / 255.0::DOUBLE AS gg, b / 255.0::DOUBLE AS bb FROM pixels),
    q AS (SELECT *, CASE WHEN mx = mn THEN 0.0 WHEN mx = rr THEN (gg - bb) / (mx - mn) / 6 WHEN mx = gg THEN (2 + (bb - rr) / (mx - mn)) / 6 ELSE (4 + (rr - gg) / (mx - mn)) / 6 END AS h0 FROM m),
    t AS (SELECT *, h0 - floor(h0) AS h, CASE WHEN mx = 0 THEN 0.0 ELSE (mx - mn) / mx END AS s, mx AS v FROM q)"""
_OTSU = f"""{P}, e AS (SELECT *, (b - r) / (b + r + 1e-6::DOUBLE) AS x FROM pixels WHERE {ROAD}), lim AS (SELECT min(x) AS lo, max(x) AS hi FROM e),
    h AS (SELECT least(255, floor((x - lo) / (hi - lo) * 256)) AS bin, lo, hi, count(*) AS n FROM e, lim GROUP BY 1, 2, 3),
    c AS (SELECT bin, n, lo + (bin + 0.5) * (hi - lo) / 256 AS c FROM h),
    k AS (SELECT bin, c, sum(n) OVER o AS w, sum(n * c) OVER o AS m, sum(n) OVER () AS t, sum(n * c) OVER () AS s FROM c WINDOW o AS (ORDER BY bin)),
    v AS (SELECT bin, c, w * (t - w) * pow(m / w - CASE WHEN t > w THEN (s - m) / (t - w) ELSE 0 END, 2) AS v FROM k),
    best AS (SELECT c AS threshold FROM v ORDER BY v DESC, bin LIMIT 1)"""
_SPAN = "SELECT tile, max(prow) + 1 AS h, max(pcol) + 1 AS w FROM pixels GROUP BY tile"
_WIN = f"""{P}, s AS ({_SPAN}),
    y AS (SELECT tile, w, unnest(range(0, h - 21, 11)) AS win_row FROM s), g AS (SELECT tile, win_row, unnest(range(0, w - 21, 11)) AS win_col FROM y),
    ok AS (SELECT DISTINCT g.tile, win_row, win_col FROM g JOIN pixels p ON p.tile = g.tile AND p.prow BETWEEN win_row AND win_row + 21 AND p.pcol BETWEEN win_col AND win_col + 21 AND greatest(r, g, b) > 0),
    sc AS (SELECT tile, win_row, win_col, (win_row * 7 + win_col * 3) % 100 / CAST(128 AS DOUBLE) - 0.375 AS score FROM ok)"""


def _offsets(o):
    return "(VALUES " + ", ".join(f"({int(r)}, {int(c)})" for r, c in o) + ") AS o(dr, dc)"


_K = ", ".join(KEY)
QUERIES = {
    f.__name__: f
    for f in (
        spectral_features, blue_excess, hsv_from_rgb, red_boost, hsv_round_trip, paint_mask, classify_pixels, nodata_mask, filtered_tile, mask_union, mask_intersect, mask_except, mask_fraction, ground_filter,
        value_histogram, otsu_threshold, shadow_mask_raw, box_mean_density, dilate_l1, dilate_disk, erode_disk, scan_windows, score_map, hit_pixels, affine_roundtrip, union_bounds, tile_stats, window_read, preview_grey, overlay,
    )
}
ORACLES = {
    "spectral_features": f"{P}, t AS (SELECT *, r + g + b + 1e-6::DOUBLE AS t FROM pixels) SELECT {_K}, round(t / 3, 6) AS brightness, round(r / t, 6) AS r_chroma, round(g / t, 6) AS g_chroma, round(b / t, 6) AS b_chroma, round((nir - r) / (nir + r + 1e-6::DOUBLE), 6) AS ndvi, round((r - (g + b) / 2) / t, 6) AS redness FROM t",
    "blue_excess": f"{P} SELECT {_K}, round((b - r) / (b + r + 1e-6::DOUBLE), 6) AS excess FROM pixels",
    "hsv_from_rgb": f"{_HSV} SELECT {_K}, round(h, 6) AS h, round(s, 6) AS s, round(v, 6) AS v, round(least(h, 1 - h), 6) AS red_distance FROM t",
    "red_boost": f"{_HSV} SELECT ({ROAD} AND least(h, 1 - h) <= 0.08 AND s >= 0.05 AND least(1, s * 1.8) <> s) AS boosted, count(*) AS n FROM t GROUP BY 1",
    "hsv_round_trip": f"{P} SELECT count(*) AS n_near, count(*) AS n FROM pixels",
    "paint_mask": f"{_HSV} SELECT {_K} FROM t WHERE {ROAD} AND least(h, 1 - h) <= 0.15 AND s >= 0.07",
    "classify_pixels": f"{P} SELECT {_K}, CASE WHEN prow % 5 = 0 THEN 1 WHEN {ROAD} THEN 2 ELSE 0 END AS class FROM pixels",
    "nodata_mask": f"{P} SELECT {_K}, " + ", ".join(f"CASE WHEN {ROAD} THEN {c} ELSE 0 END AS {c}" for c in ("r", "g", "b", "nir")) + " FROM pixels",
    "filtered_tile": f"{_OTSU} SELECT {_K}, " + ", ".join(f"CASE WHEN {ROAD} THEN {c} ELSE 0 END AS {c}" for c in ("r", "g", "b", "nir")) + f", CASE WHEN prow % 5 = 0 THEN 1 WHEN {ROAD} THEN 2 ELSE 0 END AS class, CASE WHEN {ROAD} AND (b - r) / (b + r + 1e-6::DOUBLE) >= threshold THEN 1 ELSE 0 END AS shadow FROM pixels, best",
    "mask_union": f"{P} SELECT {_K} FROM pixels WHERE r >= 128 OR g >= 128",
    "mask_intersect": f"{P} SELECT {_K} FROM pixels WHERE r >= 128 AND g >= 128",
    "mask_except": f"{P} SELECT {_K} FROM pixels WHERE r >= 128 AND g < 128",
    "mask_fraction": f"{P} SELECT tile, count(*) FILTER ({ROAD}) AS road_px, round(avg(CASE WHEN {ROAD} THEN 1.0 ELSE 0.0 END), 6) AS fraction, round(count(*) FILTER ({ROAD} AND nir < 60) / greatest(1, count(*) FILTER ({ROAD})), 6) AS cut_ratio FROM pixels GROUP BY 1",
    "ground_filter": f"{P} SELECT {_K} FROM pixels WHERE {ROAD} AND (nir - r) / (nir + r + 1e-6::DOUBLE) < 0.15",
    "value_histogram": f"{P}, l AS (SELECT tile, min(r)::DOUBLE AS lo, max(r)::DOUBLE AS hi FROM pixels GROUP BY 1), h AS (SELECT p.tile, least(255, floor((r - lo) / (hi - lo) * 256))::INT AS bin, lo, hi FROM pixels p JOIN l USING (tile)) SELECT tile, bin, count(*) AS n, round(lo + (bin + 0.5) * (hi - lo) / 256, 6) AS centre FROM h GROUP BY tile, bin, lo, hi",
    "otsu_threshold": f"{_OTSU} SELECT 'orders' AS tile, round(threshold, 6) AS threshold FROM best",
    "shadow_mask_raw": f"{_OTSU} SELECT {_K} FROM e, best WHERE x >= threshold",
    "box_mean_density": f"""{P}, w AS (SELECT a.tile, a.prow, a.pcol, sum(CASE WHEN (b.prow + 2 * b.pcol) % 7 <> 0 THEN b.r END) AS s, count(*) FILTER ((b.prow + 2 * b.pcol) % 7 <> 0) AS n
        FROM pixels a JOIN pixels b ON a.tile = b.tile AND b.prow BETWEEN a.prow - 3 AND a.prow + 3 AND b.pcol BETWEEN a.pcol - 3 AND a.pcol + 3 GROUP BY 1, 2, 3)
        SELECT {_K}, round(CASE WHEN n > 0 THEN s / n ELSE 0.0 END, 6) AS mean, round(n / 49, 6) AS density FROM w""",
    "dilate_l1": f"{P} SELECT DISTINCT tile, (prow + dr)::INT AS prow, (pcol + dc)::INT AS pcol FROM pixels, {_offsets(kernels.diamond(2))} WHERE r % 16 = 0",
    "dilate_disk": f"{P} SELECT DISTINCT tile, (prow + dr)::INT AS prow, (pcol + dc)::INT AS pcol FROM pixels, {_offsets(kernels.disk(2))} WHERE r % 16 = 0",
    "erode_disk": f"{P}, m AS (SELECT * FROM pixels WHERE r >= 64) SELECT a.tile, a.prow, a.pcol FROM m a CROSS JOIN {_offsets(kernels.disk(1))} JOIN m b ON b.tile = a.tile AND b.prow = a.prow + dr AND b.pcol = a.pcol + dc GROUP BY 1, 2, 3 HAVING count(*) = 5",
    "scan_windows": f"{_WIN} SELECT tile, win_row::INT AS win_row, win_col::INT AS win_col FROM ok",
    "score_map": f"{_WIN} SELECT p.tile, p.prow, p.pcol, round(avg(score), 6) AS score FROM pixels p JOIN sc ON p.tile = sc.tile AND p.prow BETWEEN win_row AND win_row + 21 AND p.pcol BETWEEN win_col AND win_col + 21 GROUP BY 1, 2, 3",
    "hit_pixels": f"{_WIN} SELECT p.tile, count(DISTINCT p.prow * 100000 + p.pcol) AS n_px, (SELECT round(avg(score), 6) FROM sc WHERE score > -0.1) AS score FROM pixels p JOIN sc ON p.tile = sc.tile AND p.prow BETWEEN win_row AND win_row + 21 AND p.pcol BETWEEN win_col AND win_col + 21 WHERE score > -0.1 GROUP BY 1",
    "affine_roundtrip": f"{P} SELECT {_K}, pcol * 0.25::DOUBLE + 406000 AS x, prow * -0.25::DOUBLE + 5758000 AS y, prow AS row2, pcol AS col2 FROM pixels",
    "union_bounds": f"{P} SELECT tile, min(pcol) AS west, min(prow) AS north, max(pcol) + 1 AS east, max(prow) + 1 AS south FROM pixels GROUP BY 1",
    "tile_stats": f"{P}, l AS (SELECT tile, 'r' AS band, r::DOUBLE AS v FROM pixels UNION ALL SELECT tile, 'g', g FROM pixels UNION ALL SELECT tile, 'b', b FROM pixels) SELECT tile, band, min(v) AS low, max(v) AS high, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS deviation, count(*) AS n FROM l GROUP BY 1, 2",
    "window_read": f"{P} SELECT {_K}, r, g, b FROM pixels WHERE prow BETWEEN 2 AND 5 AND pcol BETWEEN 10 AND 59",
    "preview_grey": f"{P} SELECT {_K}, round((r + g + b) / 3, 6) AS grey, round((r + g + b) / 3 * 0.75, 6) AS dark FROM pixels WHERE prow % 3 = 0 AND pcol % 3 = 0",
    "overlay": f"{P} SELECT {_K}, round(g * 0.6 + 48, 6) AS blended, round(greatest(0, least(1, (r / 255.0::DOUBLE - 0.5 + 0.3) / 0.6)), 6) AS heat, 120 AS green, round(greatest(0, least(1, (b / 10 - 4) / 16)), 6) AS width_colour FROM pixels",
}
