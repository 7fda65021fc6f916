"""Spatial joins as equi-joins on grid cells, and points along lines.

A range or nearest join on coordinates alone would compare all with all.  Both
sides are therefore keyed by square cells at least as wide as the distance
asked for: a point lies in one cell, a segment in all cells that its inflated
box touches, and only rows of one cell meet.  Where a cell is hot, adaptive
execution splits its side of the sort-merge join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corridor.config import CONFIG
from corridor.functions import geometry as G
from corridor.functions import labels
from corridor.sources.store import materialise


def cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("int")


def segment_cells(rows: DataFrame, distance: float, size: float) -> DataFrame:
    """Rows with x0, y0, x1, y1, once for each cell (cx, cy) within ``distance`` of the segment's box."""
    def span(a: str, b: str) -> Column:
        return F.explode(F.sequence(cell(F.least(a, b) - distance, size), cell(F.greatest(a, b) + distance, size)))

    return rows.withColumn("cx", span("x0", "x1")).withColumn("cy", span("y0", "y1"))


def meeting(points: DataFrame, segments: DataFrame, distance: float, size: float | None = None) -> DataFrame:
    """Pairs of a point and a segment that meet in a cell: all that are at most ``distance`` apart, and others."""
    size = size or max(distance, 1.0)
    p = points.withColumns({"cx": cell(F.col("px"), size), "cy": cell(F.col("py"), size)})
    s = segment_cells(segments, distance, size)
    on = [*(["tile"] if "tile" in points.columns and "tile" in segments.columns else []), "cx", "cy"]
    return p.join(s, on).drop("cx", "cy")


def near_segments(points: DataFrame, segments: DataFrame, distance: float, size: float | None = None) -> DataFrame:
    """Pairs of a point (px, py) and a segment (x0, y0, x1, y1) at most ``distance`` apart, with ``separation``; of one tile, if both have one."""
    d = G.segment_distance(*[F.col(c) for c in ("px", "py", "x0", "y0", "x1", "y1")])
    return meeting(points, segments, distance, size).withColumn("separation", d).where(F.col("separation") <= distance)


def covered(pixels: DataFrame, segments: DataFrame, reach: str, most: float) -> DataFrame:
    """Pixels whose centre lies within the segment's own ``reach`` (at most ``most``) of any segment: a buffer drawn as a mask.

    Segments are in pixels, of a tile or, without that column, of every tile.
    """
    size = max(most, 1.0)
    p = pixels.select("tile", "prow", "pcol", (F.col("pcol") + 0.5).alias("px"), (F.col("prow") + 0.5).alias("py"))
    p = p.withColumns({"cx": cell(F.col("px"), size), "cy": cell(F.col("py"), size)})
    s = segment_cells(segments.where(F.col(reach) <= most), most, size).select("cx", "cy", *[F.col(c).alias(f"s_{c}") for c in ("x0", "y0", "x1", "y1")], F.col(reach).alias("s_reach"), *[F.col("tile").alias("s_tile") for _ in range("tile" in segments.columns)])
    d = G.segment_distance(F.col("px"), F.col("py"), F.col("s_x0"), F.col("s_y0"), F.col("s_x1"), F.col("s_y1"))
    same = (p["cx"] == s["cx"]) & (p["cy"] == s["cy"])
    if "s_tile" in s.columns:
        same &= p["tile"] == s["s_tile"]
    return p.join(s, same & (d <= F.col("s_reach")), "left_semi").select("tile", "prow", "pcol")


def clip(segments: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """The parts of segments inside a box (x0, y0, x1, y1), after Liang and Barsky; those outside go."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    low, high, inside = F.lit(0.0), F.lit(1.0), F.lit(True)
    for p, q in ((-dx, F.col("x0") - box[0]), (dx, box[2] - F.col("x0")), (-dy, F.col("y0") - box[1]), (dy, box[3] - F.col("y0"))):
        t = q / F.when(p == 0, 1.0).otherwise(p)
        low = F.greatest(low, F.when(p < 0, t).otherwise(0.0))
        high = F.least(high, F.when(p > 0, t).otherwise(1.0))
        inside &= (p != 0) | (q >= 0)
    rows = segments.withColumns({"t_in": low, "t_out": high}).where(inside & (F.col("t_in") <= F.col("t_out")))
    moved = {f"{a}{k}": F.col(f"{a}0") + F.col(t) * (F.col(f"{a}1") - F.col(f"{a}0")) for k, t in ((0, "t_in"), (1, "t_out")) for a in ("x", "y")}
    return rows.withColumns(moved).drop("t_in", "t_out")


def samples(lines: DataFrame, interval: float) -> DataFrame:
    """Points every ``interval`` along two-point lines from their start, the end left out: k, offset_m, px, py."""
    n = G.length(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    rows = lines.withColumn("length_m", n).where("length_m > 0")
    count = F.ceil(F.col("length_m") / interval).cast("int")
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), count - 1)))
    rows = rows.withColumn("offset_m", F.col("k") * interval).where("offset_m < length_m")
    t = F.col("offset_m") / F.col("length_m")
    return rows.withColumns({"px": F.col("x0") + t * (F.col("x1") - F.col("x0")), "py": F.col("y0") + t * (F.col("y1") - F.col("y0"))})


def tangent(half_span: float = CONFIG.tangent_half_span_m) -> tuple[Column, Column]:
    """Direction at offset_m from a central difference, clamped to the ends of a two-point line."""
    a = F.greatest(F.lit(0.0), F.col("offset_m") - half_span) / F.col("length_m")
    b = F.least(F.col("length_m"), F.col("offset_m") + half_span) / F.col("length_m")
    return G.unit((b - a) * (F.col("x1") - F.col("x0")), (b - a) * (F.col("y1") - F.col("y0")))


def sections(lanes: DataFrame, interval: float = CONFIG.section_interval_m) -> DataFrame:
    """Candidate sections of lanes with their direction.

    It is the line's own, as any central difference on two points, and taken once a lane: taken
    for each section it makes generated methods that are too long for the JVM to compile.
    """
    tx, ty = G.unit(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    rows = samples(lanes.withColumns({"tx": tx, "ty": ty}), interval)
    return rows.select(*[c for c in ("tile",) if c in lanes.columns], "lane_id", "k", "offset_m", "px", "py", "tx", "ty")


RINGS = (0.25, 1.0)  # shares of the largest distance: most sections have a road in the first


def _nearest(sections_: DataFrame, r: DataFrame, reach: float, key: list[str], c) -> DataFrame:
    """(key, separation, feature_id, highway, angle, road_x, road_y) of the nearest acceptable road within ``reach``.

    Where on the road is an exploded array of one, which Spark calculates once a pair: written into
    every expression that needs it, it makes a generated method that is too long for the JVM to compile.
    """
    t = G.along(*[F.col(x) for x in ("px", "py", "x0", "y0", "x1", "y1")])
    pairs = meeting(sections_, r, reach).select("*", F.explode(F.array(t)).alias("t"))
    pairs = pairs.withColumns({f"road_{a}": F.col(f"{a}0") + F.col("t") * (F.col(f"{a}1") - F.col(f"{a}0")) for a in "xy"})
    pairs = pairs.withColumn("separation", G.length(F.col("px"), F.col("py"), F.col("road_x"), F.col("road_y")))
    pairs = pairs.where((F.col("separation") <= reach) & (F.col("separation") > c.min_lane_to_road_m))
    angle = G.acute_angle(F.col("tx"), F.col("ty"), F.col("ux"), F.col("uy"))
    pairs = pairs.withColumn("angle", angle).where(F.col("angle") <= c.max_road_angle_deg)
    best = F.min(F.struct("separation", "feature_id", "angle", "road_x", "road_y", "highway")).alias("f")
    return pairs.groupBy(*key).agg(best).select(*key, "f.*")


def _one_road(roads: DataFrame, key: list[str], c) -> DataFrame:
    """Of the roads of each place that may be a section's, the one with the smallest id, with its direction (ux, uy)."""
    r = roads.where(F.col("feature_id").isNotNull() & ~F.coalesce(F.col("highway").isin(*c.excluded_classes), F.lit(False)))
    ux, uy = G.unit(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    own = [x for x in ("tile",) if x in roads.columns and x in key]
    place = [*own, "x0", "y0", "x1", "y1"]
    return r.groupBy(*place).agg(F.min(F.struct("feature_id", "highway")).alias("r")).select(*place, "r.*", ux.alias("ux"), uy.alias("uy")).where("ux IS NOT NULL")


def reference_road(sections_: DataFrame, roads: DataFrame, c=CONFIG) -> DataFrame:
    """Each section with its nearest road of a class not excluded, at the right distance and angle, or nulls.

    Of equally near roads the one with the smallest id, which stands for all roads of its
    place; a repeated id is one road, and roads without an id take no part.  Sections of one
    place and direction look once.  They look in a near ring first, and only those that find
    nothing there in the whole distance.  Roads with ``points`` are polylines.
    """
    if "points" in roads.columns:
        from corridor.operators import lines

        return lines.reference_road(sections_, roads, c)
    key = [*[x for x in ("tile",) if x in sections_.columns], "px", "py", "tx", "ty"]
    r = _one_road(roads, key, c)
    todo, best = sections_.select(*key).distinct(), None
    for share in RINGS:
        got = _nearest(todo, r, share * c.max_lane_to_road_m, key, c)
        if share < RINGS[-1]:
            got = materialise(got, "near")
            todo = todo.join(got.select(*key), key, "left_anti")
        best = got if best is None else best.unionByName(got)
    out = sections_.join(best, key, "left").withColumn("road_width", F.when(F.col("feature_id").isNotNull(), labels.road_width()))
    return out.select(*sections_.columns, "separation", "feature_id", "highway", "angle", "road_x", "road_y", "road_width")


def lane_roads(lanes: DataFrame, roads: DataFrame, interval: float = CONFIG.section_interval_m, c=CONFIG) -> DataFrame:
    """``reference_road`` for the sections of two-point lanes; lanes of one place are one lane until all is found."""
    ends = ["x0", "y0", "x1", "y1"]
    place = [*[x for x in ("tile",) if x in lanes.columns], *ends]
    one = lanes.select(*place).distinct().withColumn("lane_id", F.struct(*ends))
    found = reference_road(sections(one, interval), roads, c)
    rest = [x for x in found.columns if x not in ("tile", "lane_id")]
    found = found.select(*place[: -len(ends)], "lane_id.*", *rest)
    return lanes.select("lane_id", *place).join(found, place).select(*place[: -len(ends)], "lane_id", *rest)


def counted_roads(lanes: DataFrame, roads: DataFrame, interval: float = CONFIG.section_interval_m, c=CONFIG) -> DataFrame:
    """What ``lane_roads`` finds, for counts and means: a row for each place and direction of sections with a road, and ``n``, how many sections are there.

    Copies are counted as lanes are read and never made rows again.  It is one plan, without a
    near ring and its table, which pay where sections have many different places.
    """
    own = [x for x in ("tile",) if x in lanes.columns]
    key = [*own, "px", "py", "tx", "ty"]
    places = lanes.groupBy(*own, "x0", "y0", "x1", "y1").agg(F.count(F.lit(1)).alias("lane_id"))
    todo = sections(places, interval).groupBy(*key).agg(F.sum("lane_id").alias("n"))
    return _nearest(todo, _one_road(roads, key, c), c.max_lane_to_road_m, [*key, "n"], c)
