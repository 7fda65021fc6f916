"""Queries on detected bands, the measurement of the phantom tile, widths and surfaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from corridor.config import CONFIG
from corridor.operators import centerline, dissolve, embed, kernels, measure, raster, sections, widths
from corridor.sources.relations import load, table, with_

P, L = with_("pixels"), with_("lanes")
KEY = ("tile", "prow", "pcol")
PHANTOM = (0.1, -0.1, 0.0, 20.0)  # affine of the phantom tile
HEIGHT, WIDTH = 200, 400


def _mask(spark, sf_dir, where="r % 3 = 0"):
    return load(spark, sf_dir, "pixels").where(where).select(*KEY)


def connected_components(spark, sf_dir):
    return raster.components(_mask(spark, sf_dir))


def component_sizes(spark, sf_dir):
    return raster.sizes(raster.components(_mask(spark, sf_dir))).groupBy("size").agg(F.count(F.lit(1)).alias("n"))


def min_component_filter(spark, sf_dir):
    parts = raster.components(_mask(spark, sf_dir))
    return raster.at_least(parts, 4).groupBy("tile").agg(F.count(F.lit(1)).alias("kept_ge"), F.countDistinct("comp").alias("parts")).join(raster.at_least(parts, 4, strict=True).groupBy("tile").agg(F.count(F.lit(1)).alias("kept_gt")), "tile")


def closing_disk(spark, sf_dir):
    return raster.closing(_mask(spark, sf_dir, "r % 5 = 0"), 1, raster.frame(load(spark, sf_dir, "pixels")))


def edt(spark, sf_dir):
    df = load(spark, sf_dir, "pixels")
    out = raster.distance(df.where("r % 16 = 0"), df, 6)
    return out.select(*KEY, F.round("distance", 6).alias("distance"))


def nearest_sunlit(spark, sf_dir):
    """Each shaded pixel with the blue of the nearest sunlit one, however far (ties: upper, then left)."""
    df = load(spark, sf_dir, "pixels")
    near = raster.nearest(df.where("nir >= 128 AND r % 64 = 0"), df.where("nir < 128"))
    lit = df.select("tile", F.col("prow").alias("near_row"), F.col("pcol").alias("near_col"), F.col("b").alias("value"))
    return near.join(lit, ["tile", "near_row", "near_col"], "left").select(*KEY, F.round("distance", 6).alias("distance"), "value")


def shadow_correct(spark, sf_dir):
    df = load(spark, sf_dir, "pixels").withColumns({"road": F.expr("pcol % 9 <> 0"), "shadow": F.expr("pcol >= 40 AND pcol < 60 AND pcol % 9 <> 0")})
    return raster.correct_shadows(df, 1.0, CONFIG)


def shadow_mask_clean(spark, sf_dir):
    """Shadow as it is used: Otsu's cut, closed and sifted."""
    df = load(spark, sf_dir, "pixels")
    return raster.clean_mask(raster.shadow_mask(df, F.expr("(prow + 2 * pcol) % 7 <> 0")), raster.frame(df), 1.0, 0.6, 3.0)


def connect_coarse(spark, sf_dir):
    """Gaps of a sparse mask closed along lines of twelve directions."""

    def kernel(g):
        joined = kernels.connect(g["known"], 5, CONFIG.bridge_orientations)
        return {"fill": joined, "inside": joined}

    return raster.apply_blocks(_mask(spark, sf_dir, "r % 11 = 0"), [], kernel, "inside boolean", 12).select(*KEY)


def _bands(spark, sf_dir):
    return load(spark, sf_dir, "pixels").where("prow % 8 < 5 AND r % 2 = 0").withColumn("comp", F.floor(F.col("prow") / 8).cast("int"))


def pca_axis(spark, sf_dir):
    out = centerline.axis(_bands(spark, sf_dir))
    return out.select("comp", *[(F.round(c, 6) + 0.0).alias(c) for c in ("row", "col", "ar", "ac")])


def binned_centerline(spark, sf_dir):
    out = centerline.binned(_bands(spark, sf_dir), 6.0)
    return out.select("comp", "bin", F.round("row", 6).alias("row"), F.round("col", 6).alias("col"))


def regularised_band(spark, sf_dir):
    return centerline.regularised(_bands(spark, sf_dir), 6.0).groupBy("comp").agg(F.count(F.lit(1)).alias("n_px"), F.round(F.max("radius"), 6).alias("radius"))


def _segments(spark, sf_dir):
    base = load(spark, sf_dir, "lanes").withColumn("seg_id", F.split("lane_id", ":")[0].cast("long"))
    step = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.struct((F.col("x0") + j * (F.col("seg_id") % 3 - 1) * 2).alias("row"), (F.col("y0") + j * (F.col("seg_id") % 4 + 1)).alias("col")))
    return base.select("seg_id", (F.col("seg_id") % 4 + 1).cast("double").alias("radius"), step.alias("points"))


def bridge_pairs(spark, sf_dir):
    out = centerline.bridges(_segments(spark, sf_dir))
    return out.select("a", "b", F.round("gap", 6).alias("gap"), "place_a", "place_b")


def bridge_pixels(spark, sf_dir):
    return centerline.drawn(centerline.bridges(_segments(spark, sf_dir))).select("a", "b", F.size("px").cast("long").alias("n_px"))


def texture_descriptor(spark, sf_dir):
    out = embed.descriptor(load(spark, sf_dir, "pixels"), 22, 11)
    return out.select("tile", "win_row", "win_col", *[F.round(F.col("embedding")[k], 6).alias(f"e{k}") for k in range(6)])


def _phantom(spark, sf_dir, shadow="false"):
    df = load(spark, sf_dir, "phantom").withColumns({"shadow": F.expr(shadow), "near_edge": F.lit(False)})
    lanes = spark.createDataFrame([("lane:0", 0.0, 5.0, 40.0, 5.0)], "lane_id string, x0 double, y0 double, x1 double, y1 double")
    roads = spark.createDataFrame([(1, "residential", 0.0, 10.02, 40.0, 10.02)], "feature_id long, highway string, x0 double, y0 double, x1 double, y1 double")
    return df, lanes, roads


def _records(rows):
    return rows.select("lane_id", "k", "offset_m", F.round("osm_separation_m", 6).alias("osm_separation_m"), "skip", F.round("gap_m", 6).alias("gap_m"), "composition", F.round("road_edge_m", 6).alias("road_edge_m"), F.round("lane_edge_m", 6).alias("lane_edge_m"), F.round("shadow_fraction", 6).alias("shadow_fraction"), "reliable")


def gap_records(spark, sf_dir):
    """The flagship: gaps of the phantom tile, whose answer is known: 1.25 m of vegetation at every section."""
    df, lanes, roads = _phantom(spark, sf_dir)
    return _records(sections.measure_gaps(df, lanes, roads, PHANTOM, "phantom", HEIGHT, WIDTH))


def gap_records_by_pixels(spark, sf_dir):
    """The same by the surface's own edge instead of the class's width."""
    df, lanes, roads = _phantom(spark, sf_dir)
    return _records(sections.measure_gaps(df, lanes, roads, PHANTOM, "phantom", HEIGHT, WIDTH, "pixels"))


def run_tile(spark, sf_dir):
    """A tile's whole chain, shadows found and corrected first."""
    df, lanes, roads = _phantom(spark, sf_dir)
    return _records(sections.run_tile(df.drop("shadow", "near_edge"), lanes, roads, PHANTOM, "phantom", HEIGHT, WIDTH))


def skip_counts(spark, sf_dir):
    """Measured sections and skipped ones by reason: all candidates, once each."""
    df, lanes, roads = _phantom(spark, sf_dir)
    df = df.withColumn("near_edge", F.expr("pcol < 60"))
    roads = roads.withColumn("x1", F.lit(30.0))
    rows = sections.measure_gaps(df, lanes, roads, PHANTOM, "phantom", HEIGHT, WIDTH)
    return rows.groupBy(F.coalesce("skip", F.lit("measured")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def _rays(spark, sf_dir):
    df, _, _ = _phantom(spark, sf_dir)
    ways = spark.createDataFrame([(1, 0.0, 12.0, 40.0, 12.0), (2, 10.0, 8.5, 30.0, 19.0)], "way_id long, x0 double, y0 double, x1 double, y1 double")
    return widths.rays(ways, df.where("prow BETWEEN 40 AND 125"), PHANTOM, HEIGHT, WIDTH)


def ray_extent(spark, sf_dir):
    return _rays(spark, sf_dir).withColumn("extent_m", F.round("extent_m", 6))


def width_samples(spark, sf_dir):
    return widths.samples(_rays(spark, sf_dir), 0.1).withColumn("width_m", F.round("width_m", 6))


def _lineitem_widths(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("way_id"), F.col("l_quantity").alias("width_m"), (F.col("l_returnflag") == "R").alias("buffer_limited"), (F.col("l_linestatus") == "F").alias("unbounded"))


def way_width_aggregate(spark, sf_dir):
    return measure.way_widths(_lineitem_widths(spark, sf_dir))


def top_ways(spark, sf_dir):
    return measure.way_widths(_lineitem_widths(spark, sf_dir)).orderBy(F.desc("n_samples"), "way_id").limit(20).select("way_id", "n_samples", "width_median_m")


def dissolve_accounting(spark, sf_dir):
    _, row = dissolve.dissolve(_mask(spark, sf_dir, "r % 2 = 0"), raster.frame(load(spark, sf_dir, "pixels")), 1.0, opening=True)
    return row


_RECUR = """{0}, m AS (SELECT tile, prow, pcol FROM pixels WHERE r % 3 = 0),
    e AS (SELECT a.tile, a.prow, a.pcol, b.prow AS prow2, b.pcol AS pcol2 FROM m a JOIN m b ON a.tile = b.tile AND ((abs(a.prow - b.prow) = 1 AND a.pcol = b.pcol) OR (a.prow = b.prow AND abs(a.pcol - b.pcol) = 1))),
    reach AS (SELECT tile, prow, pcol, prow::BIGINT * 2147483648 + pcol AS root FROM m UNION SELECT e.tile, e.prow2, e.pcol2, reach.root FROM reach JOIN e ON e.tile = reach.tile AND e.prow = reach.prow AND e.pcol = reach.pcol WHERE reach.root < e.prow2::BIGINT * 2147483648 + e.pcol2),
    c AS (SELECT tile, prow, pcol, min(root) AS comp FROM reach GROUP BY 1, 2, 3)""".format(P.replace("WITH ", "WITH RECURSIVE ", 1))
_D1 = "(VALUES " + ", ".join(f"({int(r)}, {int(c)})" for r, c in kernels.disk(1)) + ") AS o(dr, dc)"
_BANDS = f"{P}, d AS (SELECT floor(prow / 8)::INT AS comp, prow, pcol FROM pixels WHERE prow % 8 < 5 AND r % 2 = 0), m AS (SELECT comp, avg(prow) AS row, avg(pcol) AS col, 0.5 * atan2(2 * covar_pop(prow, pcol), var_pop(prow) - var_pop(pcol)) AS t FROM d GROUP BY 1), x AS (SELECT comp, row, col, CASE WHEN CASE WHEN abs(cos(t)) >= abs(sin(t)) THEN cos(t) ELSE sin(t) END < 0 THEN -1 ELSE 1 END AS s, cos(t) AS a, sin(t) AS b FROM m)"
_TIPS = """{0}, g AS (SELECT split_part(lane_id, ':', 1)::BIGINT AS id, x0, y0 FROM lanes), s AS (SELECT id, (id % 4 + 1)::DOUBLE AS radius, x0, y0, ((id % 3 - 1) * 2)::DOUBLE AS dr, (id % 4 + 1)::DOUBLE AS dc FROM g),
    tips AS (SELECT id, radius, 0 AS place, x0 AS r, y0 AS c, -dr / sqrt(dr * dr + dc * dc) AS tr, -dc / sqrt(dr * dr + dc * dc) AS tc FROM s UNION ALL SELECT id, radius, 1, x0 + 7 * dr, y0 + 7 * dc, dr / sqrt(dr * dr + dc * dc), dc / sqrt(dr * dr + dc * dc) FROM s),
    j AS (SELECT a.id AS a, b.id AS b, sqrt(pow(b.r - a.r, 2) + pow(b.c - a.c, 2)) AS gap, a.place AS place_a, b.place AS place_b, least(a.radius, b.radius) AS radius, (b.r - a.r) * a.tr + (b.c - a.c) * a.tc AS da, -(b.r - a.r) * b.tr - (b.c - a.c) * b.tc AS db
          FROM tips a JOIN tips b ON a.id < b.id AND abs(a.r - b.r) <= 16 AND abs(a.c - b.c) <= 16)""".format(L)
QUERIES = {
    f.__name__: f
    for f in (
        connected_components, component_sizes, min_component_filter, closing_disk, edt, nearest_sunlit, shadow_correct, shadow_mask_clean, connect_coarse, pca_axis, binned_centerline, regularised_band, bridge_pairs, bridge_pixels,
        texture_descriptor, gap_records, gap_records_by_pixels, run_tile, skip_counts, ray_extent, width_samples, way_width_aggregate, top_ways, dissolve_accounting,
    )
}
_WAYS = "SELECT l_suppkey AS way_id, round(median(l_quantity), 6) AS width_median_m, round(avg(l_quantity), 6) AS width_mean_m, min(l_quantity) AS width_min_m, max(l_quantity) AS width_max_m, count(*) AS n_samples, round(avg((l_returnflag = 'R')::INT), 6) AS buffer_limited_fraction, round(avg((l_linestatus = 'F')::INT), 6) AS unbounded_fraction FROM lineitem GROUP BY 1 HAVING count(*) >= 3"
ORACLES = {
    "connected_components": f"{_RECUR} SELECT * FROM c",
    "component_sizes": f"{_RECUR} SELECT size, count(*) AS n FROM (SELECT comp, count(*) AS size FROM c GROUP BY tile, comp) GROUP BY 1",
    "min_component_filter": f"{_RECUR}, z AS (SELECT tile, comp, count(*) AS size FROM c GROUP BY 1, 2) SELECT tile, sum(size) FILTER (size >= 4)::BIGINT AS kept_ge, count(*) FILTER (size >= 4) AS parts, sum(size) FILTER (size > 4)::BIGINT AS kept_gt FROM z GROUP BY 1",
    "closing_disk": f"""{P}, m AS (SELECT tile, prow, pcol FROM pixels WHERE r % 5 = 0), h AS (SELECT max(prow) AS h, max(pcol) AS w FROM pixels),
        d AS (SELECT DISTINCT tile, prow + dr AS prow, pcol + dc AS pcol FROM m, {_D1}),
        e AS (SELECT a.tile, a.prow, a.pcol FROM d a CROSS JOIN {_D1} JOIN d b ON b.tile = a.tile AND b.prow = a.prow + dr AND b.pcol = a.pcol + dc GROUP BY 1, 2, 3 HAVING count(*) = 5)
        SELECT e.tile, e.prow::INT AS prow, e.pcol::INT AS pcol FROM e, h WHERE prow BETWEEN 1 AND h - 1 AND pcol BETWEEN 1 AND w - 1""",
    "edt": f"{P}, m AS (SELECT tile, prow, pcol FROM pixels WHERE r % 16 = 0) SELECT p.tile, p.prow, p.pcol, round(min(CASE WHEN pow(p.prow - m.prow, 2) + pow(p.pcol - m.pcol, 2) <= 36 THEN sqrt(pow(p.prow - m.prow, 2) + pow(p.pcol - m.pcol, 2)) END), 6) AS distance FROM pixels p LEFT JOIN m ON m.tile = p.tile AND m.prow BETWEEN p.prow - 6 AND p.prow + 6 AND m.pcol BETWEEN p.pcol - 6 AND p.pcol + 6 GROUP BY 1, 2, 3",
    "nearest_sunlit": f"""{P}, m AS (SELECT tile, prow, pcol, b FROM pixels WHERE nir >= 128 AND r % 64 = 0),
        q AS (SELECT p.tile, p.prow, p.pcol, min(struct_pack(d := (p.prow - m.prow) * (p.prow - m.prow) + (p.pcol - m.pcol) * (p.pcol - m.pcol), r := m.prow, c := m.pcol, b := m.b)) AS n FROM pixels p JOIN m ON m.tile = p.tile AND abs(m.prow - p.prow) <= 60 WHERE p.nir < 128 GROUP BY 1, 2, 3)
        SELECT p.tile, p.prow, p.pcol, round(sqrt(n.d), 6) AS distance, n.b AS value FROM pixels p LEFT JOIN q USING (tile, prow, pcol) WHERE p.nir < 128""",
    "pca_axis": f"{_BANDS} SELECT comp, round(row, 6) AS row, round(col, 6) AS col, CASE WHEN round(s * a, 6) = 0 THEN 0.0 ELSE round(s * a, 6) END AS ar, CASE WHEN round(s * b, 6) = 0 THEN 0.0 ELSE round(s * b, 6) END AS ac FROM x",
    "binned_centerline": f"{_BANDS}, n AS (SELECT d.comp, floor(((prow - row) * s * a + (pcol - col) * s * b) / 6.0 + 1e-9)::INT AS bin, prow, pcol FROM d JOIN x USING (comp)), g AS (SELECT comp, bin, avg(prow) AS row, avg(pcol) AS col, count(*) OVER (PARTITION BY comp) AS bins FROM n GROUP BY 1, 2) SELECT comp, bin, round(row, 6) AS row, round(col, 6) AS col FROM g WHERE bins >= 7",
    "bridge_pairs": f"{_TIPS} SELECT a, b, round(gap, 6) AS gap, place_a, place_b FROM j WHERE gap > 0 AND gap <= 4 * radius AND da / gap >= 0.82 AND db / gap >= 0.82 QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY place_a, place_b) = 1",
    # by hand: the road's half width is 2.75 m, the lane's mask begins 4.00 m from the road's line
    "gap_records": "SELECT 'lane:0' AS lane_id, k::INT AS k, k * 2.0::DOUBLE AS offset_m, 5.02::DOUBLE AS osm_separation_m, NULL::VARCHAR AS skip, 4.0::DOUBLE - 5.5 / 2 AS gap_m, 'vegetation' AS composition, 2.75::DOUBLE AS road_edge_m, 4.0::DOUBLE AS lane_edge_m, 0.0::DOUBLE AS shadow_fraction, true AS reliable FROM range(0, 20) t(k)",
    "texture_descriptor": f"""{P}, h AS (SELECT max(prow) AS h, max(pcol) AS w FROM pixels), w AS (SELECT r::INT AS win_row, c::INT AS win_col FROM h, range(0, h.h + 1, 11) a(r), range(0, h.w + 1, 11) b(c) WHERE r + 22 <= h.h + 1 AND c + 22 <= h.w + 1)
        SELECT tile, win_row, win_col, round(avg(r / 255::DOUBLE), 6) AS e0, round(stddev_pop(r / 255::DOUBLE), 6) AS e1, round(avg(g / 255::DOUBLE), 6) AS e2, round(stddev_pop(g / 255::DOUBLE), 6) AS e3, round(avg(b / 255::DOUBLE), 6) AS e4, round(stddev_pop(b / 255::DOUBLE), 6) AS e5
        FROM pixels JOIN w ON prow >= win_row AND prow < win_row + 22 AND pcol >= win_col AND pcol < win_col + 22 GROUP BY 1, 2, 3 HAVING max(greatest(r, g, b)) > 0""",
    "way_width_aggregate": _WAYS,
    "top_ways": f"SELECT way_id, n_samples, width_median_m FROM ({_WAYS}) ORDER BY n_samples DESC, way_id LIMIT 20",
}
