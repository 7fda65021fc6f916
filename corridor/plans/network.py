"""Queries on roads and lanes: classes, buffers, nearest roads, points along lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from corridor import config as C
from corridor.functions import geometry as G
from corridor.functions import labels
from corridor.operators import measure, spatial
from corridor.sources.relations import load, with_

R, L, PR = with_("roads"), with_("lanes"), with_("pixels", "roads")
BOX = (50.0, 50.0, 150.0, 150.0)


def roads(spark, sf_dir):
    return load(spark, sf_dir, "roads").where(labels.is_line()).withColumn("category", labels.category())


def streets(spark, sf_dir):
    return roads(spark, sf_dir).where("category = 'street'")


def osm_classify(spark, sf_dir):
    return load(spark, sf_dir, "roads").select("feature_id", labels.category().alias("category"))


def tag_filter(spark, sf_dir):
    return load(spark, sf_dir, "roads").where(labels.is_line() & labels.wanted()).select("feature_id", "kind")


def road_width_lookup(spark, sf_dir):
    return load(spark, sf_dir, "roads").select("feature_id", labels.road_width().alias("width_m"))


def category_counts(spark, sf_dir):
    return measure.counts(roads(spark, sf_dir), "category")


def buffer_semi_join(spark, sf_dir):
    """Pixels within a class's buffer: 4.5 m about bike lanes, 6 m about streets."""
    reach = F.when(F.col("category") == "bikelane", C.CONFIG.bike_lane_buffer_m).otherwise(C.CONFIG.street_buffer_m)
    ways = roads(spark, sf_dir).withColumn("reach", reach)
    return spatial.covered(load(spark, sf_dir, "pixels"), ways, "reach", 6.0)


def class_width_surface(spark, sf_dir):
    """Pixels on a street as wide as its class."""
    ways = streets(spark, sf_dir).withColumn("reach", labels.road_width() / 2)
    return spatial.covered(load(spark, sf_dir, "pixels"), ways, "reach", 6.0)


def clip_lines(spark, sf_dir):
    out = spatial.clip(streets(spark, sf_dir), BOX)
    return out.select("feature_id", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


def arc_samples(spark, sf_dir):
    out = spatial.samples(load(spark, sf_dir, "lanes"), C.CONFIG.section_interval_m)
    return out.groupBy("lane_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("offset_m"), 6).alias("last_m"), F.round(F.sum("px"), 4).alias("sum_x"), F.round(F.sum("py"), 4).alias("sum_y"))


def tangents(spark, sf_dir):
    out = spatial.sections(load(spark, sf_dir, "lanes"), 20.0)
    return out.select("lane_id", "k", F.round("tx", 6).alias("tx"), F.round("ty", 6).alias("ty"))


def point_on_line(spark, sf_dir):
    """Where the middle of each lane projects on the road that has its number."""
    mid = load(spark, sf_dir, "lanes").select(F.split("lane_id", ":")[0].cast("long").alias("feature_id"), ((F.col("x0") + F.col("x1")) / 2).alias("px"), ((F.col("y0") + F.col("y1")) / 2).alias("py"))
    rows = mid.join(load(spark, sf_dir, "roads"), "feature_id")
    args = [F.col(c) for c in ("px", "py", "x0", "y0", "x1", "y1")]
    return rows.select("feature_id", F.round(G.along(*args), 6).alias("t"), F.round(G.segment_distance(*args), 6).alias("distance"))


def _near(spark, sf_dir):
    return spatial.lane_roads(load(spark, sf_dir, "lanes"), streets(spark, sf_dir), 20.0)


def nearest_road(spark, sf_dir):
    out = _near(spark, sf_dir).where("feature_id IS NOT NULL")
    return out.select("lane_id", "k", "feature_id", "highway", "road_width", F.round("separation", 6).alias("separation"))


def nearest_road_angle(spark, sf_dir):
    """``lanes`` has at most 200 places, however many lanes: each counts for the lanes that lie there."""
    out = spatial.counted_roads(load(spark, sf_dir, "lanes"), streets(spark, sf_dir), 20.0)
    n = F.sum("n")
    return out.groupBy("highway").agg(n.alias("n"), F.round(F.sum(F.col("angle") * F.col("n")) / n, 4).alias("mean_angle"), F.round(F.max("separation"), 6).alias("farthest"))


def far_sections(spark, sf_dir):
    return _near(spark, sf_dir).agg(F.count_if(F.col("feature_id").isNull()).alias("far"), F.count(F.lit(1)).alias("n"))


def skip_reasons(spark, sf_dir):
    """Every candidate section counted once, by the first test that it fails."""
    rows = _near(spark, sf_dir).withColumns({"in_frame": F.expr("px < 190 AND py < 190"), "near_edge": F.expr("k % 5 = 0"), "has_run": F.expr("k % 3 <> 0"), "lane_edge_m": F.when(F.expr("k % 7 <> 0"), F.col("separation") - 1)})
    return rows.groupBy(F.coalesce(measure.skip_reason(), F.lit("measured")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def gap_by_class(spark, sf_dir):
    rows = _near(spark, sf_dir).where("feature_id IS NOT NULL").withColumn("gap", measure.osm_gap(F.col("separation") - 1.0, F.col("road_width")))
    return rows.groupBy("highway").agg(F.round(F.median("gap"), 6).alias("median_gap"), F.count_if(F.col("gap") == 0).alias("contiguous"))


def utm_projection(spark, sf_dir):
    """Road ends taken as degrees east and north of (9, 50), projected to zone 32."""
    e, n = G.utm_32(9.0 + (F.col("x0") - 100) / 100, 50.0 + F.col("y0") / 100)
    return load(spark, sf_dir, "roads").select("feature_id", F.round(e, 3).alias("east"), F.round(n, 3).alias("north"))


_CAT = "CASE WHEN coalesce(highway = 'cycleway', false) OR coalesce(bicycle = 'designated', false) OR " + " OR ".join(f"coalesce({k} IN {C.BIKE_LANE_CYCLEWAY_VALUES}, false)" for k in C.CYCLEWAY_KEYS) + " THEN 'bikelane' ELSE 'street' END"
_WIDTH = "CASE highway " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.ROAD_WIDTH_M.items()) + " ELSE 6.0 END"
_LINE = "kind IN ('LineString', 'MultiLineString')"
_LEN2 = "((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))"
_T = f"greatest(0.0, least(1.0, ((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / CASE WHEN {_LEN2} = 0 THEN 1 ELSE {_LEN2} END))"
_DIST = "sqrt(pow(px - x0 - t * (x1 - x0), 2) + pow(py - y0 - t * (y1 - y0), 2))"


def _cover(reach: str, where: str) -> str:
    return f"""{PR}, w AS (SELECT *, {reach} AS reach FROM (SELECT *, {_CAT} AS category FROM roads WHERE {_LINE}) WHERE {where}),
        j AS (SELECT tile, prow, pcol, reach, x0, y0, x1, y1, px, py, {_T} AS t FROM (SELECT tile, prow, pcol, pcol + 0.5 AS px, prow + 0.5 AS py FROM pixels) p
              JOIN w ON px BETWEEN least(x0, x1) - 6 AND greatest(x0, x1) + 6 AND py BETWEEN least(y0, y1) - 6 AND greatest(y0, y1) + 6)
        SELECT DISTINCT tile, prow, pcol FROM j WHERE {_DIST} <= reach"""


def _arc(step: float) -> str:
    return f"""n AS (SELECT *, sqrt({_LEN2}) AS len FROM lanes WHERE {_LEN2} > 0), u AS (SELECT *, unnest(range(0, ceil(len / {step})::INT))::INT AS k FROM n),
        a AS (SELECT *, k * {step}::DOUBLE AS off, x0 + k * {step} / len * (x1 - x0) AS px, y0 + k * {step} / len * (y1 - y0) AS py FROM u WHERE k * {step}::DOUBLE < len)"""


_NEAR = f"""{with_("lanes", "roads")}, {_arc(20.0)},
    s AS (SELECT lane_id, k, px, py, (x1 - x0) / len AS tx, (y1 - y0) / len AS ty FROM a),
    w AS (SELECT feature_id, highway, x0, y0, x1, y1, (x1 - x0) / sqrt({_LEN2}) AS ux, (y1 - y0) / sqrt({_LEN2}) AS uy, {_WIDTH} AS road_width FROM (SELECT *, {_CAT} AS category FROM roads WHERE {_LINE} AND {_LEN2} > 0)
          WHERE category = 'street' AND coalesce(highway, '') <> 'service'),
    j AS (SELECT *, {_T} AS t FROM s JOIN w ON px BETWEEN least(x0, x1) - 20 AND greatest(x0, x1) + 20 AND py BETWEEN least(y0, y1) - 20 AND greatest(y0, y1) + 20),
    d AS (SELECT *, {_DIST} AS separation, degrees(acos(least(1.0, abs(tx * ux + ty * uy)))) AS angle FROM j),
    f AS (SELECT * FROM d WHERE separation > 0.5 AND separation <= 20 AND angle <= 35 QUALIFY row_number() OVER (PARTITION BY lane_id, k ORDER BY separation, feature_id) = 1),
    b AS (SELECT s.*, f.feature_id, f.highway, f.separation, f.angle, f.road_width FROM s LEFT JOIN f ON f.lane_id = s.lane_id AND f.k = s.k)"""

QUERIES = {
    f.__name__: f
    for f in (osm_classify, tag_filter, road_width_lookup, category_counts, buffer_semi_join, class_width_surface, clip_lines, arc_samples, tangents, point_on_line, nearest_road, nearest_road_angle, far_sections, skip_reasons, gap_by_class, utm_projection)
}
ORACLES = {
    "osm_classify": f"{R} SELECT feature_id, {_CAT} AS category FROM roads",
    "tag_filter": f"{R} SELECT feature_id, kind FROM roads WHERE {_LINE} AND (coalesce(highway IN {C.BIKE_LANE_HIGHWAY_VALUES + C.STREET_HIGHWAY_VALUES}, false) OR coalesce(bicycle = 'designated', false) OR cycleway IS NOT NULL OR cycleway_left IS NOT NULL)",
    "road_width_lookup": f"{R} SELECT feature_id, {_WIDTH} AS width_m FROM roads",
    "category_counts": f"{R} SELECT {_CAT} AS category, count(*) AS n FROM roads WHERE {_LINE} GROUP BY 1",
    "buffer_semi_join": _cover("CASE WHEN category = 'bikelane' THEN 4.5 ELSE 6.0 END", "true"),
    "class_width_surface": _cover(f"{_WIDTH} / 2", "category = 'street'"),
    "clip_lines": f"""{R}, w AS (SELECT *, x1 - x0 AS dx, y1 - y0 AS dy FROM (SELECT *, {_CAT} AS category FROM roads WHERE {_LINE}) WHERE category = 'street'),
        t AS (SELECT *, greatest(0, CASE WHEN dx > 0 THEN (50 - x0) / dx WHEN dx < 0 THEN (150 - x0) / dx ELSE 0 END, CASE WHEN dy > 0 THEN (50 - y0) / dy WHEN dy < 0 THEN (150 - y0) / dy ELSE 0 END) AS a,
                     least(1, CASE WHEN dx > 0 THEN (150 - x0) / dx WHEN dx < 0 THEN (50 - x0) / dx ELSE 1 END, CASE WHEN dy > 0 THEN (150 - y0) / dy WHEN dy < 0 THEN (50 - y0) / dy ELSE 1 END) AS b
              FROM w WHERE (dx <> 0 OR x0 BETWEEN 50 AND 150) AND (dy <> 0 OR y0 BETWEEN 50 AND 150))
        SELECT feature_id, round(x0 + a * dx, 6) AS x0, round(y0 + a * dy, 6) AS y0, round(x0 + b * dx, 6) AS x1, round(y0 + b * dy, 6) AS y1 FROM t WHERE a <= b""",
    "arc_samples": f"{L}, {_arc(2.0)} SELECT lane_id, count(*) AS n, round(max(off), 6) AS last_m, round(sum(px), 4) AS sum_x, round(sum(py), 4) AS sum_y FROM a GROUP BY 1",
    "tangents": f"{L}, {_arc(20.0)} SELECT lane_id, k, round((x1 - x0) / len, 6) AS tx, round((y1 - y0) / len, 6) AS ty FROM a",
    "point_on_line": f"{with_('lanes', 'roads')}, m AS (SELECT split_part(lane_id, ':', 1)::BIGINT AS feature_id, (x0 + x1) / 2 AS px, (y0 + y1) / 2 AS py FROM lanes), j AS (SELECT feature_id, px, py, x0, y0, x1, y1, {_T} AS t FROM m JOIN roads USING (feature_id)) SELECT feature_id, round(t, 6) AS t, round({_DIST}, 6) AS distance FROM j",
    "nearest_road": f"{_NEAR} SELECT lane_id, k, feature_id, highway, road_width, round(separation, 6) AS separation FROM b WHERE feature_id IS NOT NULL",
    "nearest_road_angle": f"{_NEAR} SELECT highway, count(*) AS n, round(avg(angle), 4) AS mean_angle, round(max(separation), 6) AS farthest FROM b WHERE feature_id IS NOT NULL GROUP BY 1",
    "far_sections": f"{_NEAR} SELECT count(*) FILTER (feature_id IS NULL) AS far, count(*) AS n FROM b",
    "skip_reasons": f"{_NEAR} SELECT CASE WHEN separation IS NULL THEN 'far' WHEN NOT (px < 190 AND py < 190) THEN 'off' WHEN k % 5 = 0 THEN 'shadow' WHEN k % 3 = 0 OR k % 7 = 0 THEN 'unresolved' ELSE 'measured' END AS reason, count(*) AS n FROM b GROUP BY 1",
    "gap_by_class": f"{_NEAR} SELECT highway, round(median(greatest(separation - 1 - road_width / 2, 0)), 6) AS median_gap, count(*) FILTER (separation - 1 - road_width / 2 <= 0) AS contiguous FROM b WHERE feature_id IS NOT NULL GROUP BY 1",
}
