"""What larger tables need: relations of pixels are never broadcast, copies are worked on once, ties fall as in SQL."""

from __future__ import annotations

import re

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from corridor import plans
from corridor.config import CONFIG
from corridor.operators import raster, scan, sections, spatial
from corridor.sources import store
from corridor.sources.relations import load

QUERIES = plans.queries()


def _broadcasts(df):
    """Joins on a pixel's place that broadcast one side."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x.strip() for x in plan.splitlines() if "BroadcastHashJoin" in x and "pcol#" in x.split("],")[0]]


@pytest.mark.parametrize("name", ["tiles_measured", "tiles_run", "scan_view"])
def test_pixels_are_not_broadcast(name, spark, monkeypatch):
    found = []

    def watched(df, tag):
        found.extend(_broadcasts(df))
        return store.materialise(df, tag)

    for module in (raster, scan, sections, spatial):
        if hasattr(module, "materialise"):
            monkeypatch.setattr(module, "materialise", watched)
    found += _broadcasts(QUERIES[name](spark, SF))
    assert not found


NEAR = ["far_sections", "gap_by_class", "nearest_road", "nearest_road_angle", "skip_reasons"]


@pytest.mark.parametrize("name", NEAR)
def test_copies_look_once(name, spark, monkeypatch):
    """Sections of one place and roads of one place are compared once, however many there are."""
    asked, look = [], spatial._nearest

    def watched(sections_, roads, *rest):
        asked.append([(df.count(), df.select(*xs).distinct().count()) for df, xs in ((sections_, ("px", "py", "tx", "ty")), (roads, ("x0", "y0", "x1", "y1")))])
        return look(sections_, roads, *rest)

    monkeypatch.setattr(spatial, "_nearest", watched)
    lanes = spark.range(50).selectExpr("concat(id, ':0') AS lane_id", "0D AS x0", "CAST(id % 2 AS DOUBLE) AS y0", "5D AS x1", "CAST(id % 2 AS DOUBLE) AS y1")
    roads = spark.range(5, 45).selectExpr("id AS feature_id", "'primary' AS highway", "0D AS x0", "4D AS y0", "9D AS x1", "4D AS y1")
    rows = spatial.reference_road(spatial.sections(lanes), roads).collect()
    assert len(rows) == 150 and {(r["feature_id"], r["separation"]) for r in rows} == {(5, 4.0), (5, 3.0)}
    QUERIES[name](spark, "/root/testdata/sf0.01")
    assert asked and all(n == places for pair in asked for n, places in pair)


@pytest.mark.parametrize("name", NEAR)
def test_lanes_of_one_place_are_one_lane(name, spark, monkeypatch):
    """Sections are made once for each place of lanes."""
    asked, make = [], spatial.sections
    monkeypatch.setattr(spatial, "sections", lambda lanes, *rest: (asked.append((lanes.count(), lanes.select("x0", "y0", "x1", "y1").distinct().count())), make(lanes, *rest))[1])
    QUERIES[name](spark, "/root/testdata/sf0.01")
    assert asked == [(200, 200)]


@pytest.mark.parametrize("tile", [False, True])
def test_lane_roads(tile, spark):
    """Every copy of a lane gets what its own sections get, far ones and lanes of other tiles too."""
    rng = np.random.default_rng(3)
    seg = lambda n, size: [(*map(float, a), *map(float, a + rng.uniform(-size, size, 2))) for a in rng.uniform(0, 90, (n, 2))]
    places = [*seg(12, 15), (900.0, 900.0, 905.0, 900.0), (1.0, 1.0, 1.0, 1.0)]
    lanes = spark.createDataFrame([(str(k), f"t{k % 2}", *places[k % 14]) for k in range(57)], "lane_id string, tile string, x0 double, y0 double, x1 double, y1 double")
    roads = spark.createDataFrame([(k, "primary" if k % 3 else None, f"t{k % 2}", *r) for k, r in enumerate(seg(25, 30))], "feature_id long, highway string, tile string, x0 double, y0 double, x1 double, y1 double")
    if not tile:
        lanes, roads = lanes.drop("tile"), roads.drop("tile")
    want = spatial.reference_road(spatial.sections(lanes, 4.0), roads)
    got = spatial.lane_roads(lanes, roads, 4.0)
    assert got.columns == want.columns and got.dtypes == want.dtypes
    rows = sorted(map(str, got.collect()))
    assert rows == sorted(map(str, want.collect())) and 0 < sum("feature_id=None" in r for r in rows) < len(rows)


def test_sections_are_compiled(spark):
    """Generated methods beyond 8000 bytes are never compiled by the JVM: not those that make sections for a join either."""
    key = ["px", "py", "tx", "ty"]
    on = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = spark.createDataFrame([(0.0, 0.0, 1.0, 0.0, 5)], "px double, py double, tx double, ty double, feature_id long")
        rows = spatial.sections(load(spark, SF, "lanes"), 20.0).join(found, key)
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
        sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", rows._jdf.queryExecution().explainString(mode))]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", on)
    assert sizes and max(sizes) < 8000


@pytest.mark.parametrize("broadcast", ["-1", "10m"])
def test_pairs_of_a_section_and_a_road_are_compiled(broadcast, spark):
    """As above, whether pairs are made by merging or by a broadcast."""
    on, most = (spark.conf.get(f"spark.sql.{k}") for k in ("adaptive.enabled", "autoBroadcastJoinThreshold"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        roads = spark.createDataFrame([(7, "primary", 0.0, 4.0, 9.0, 4.0)], "feature_id long, highway string, x0 double, y0 double, x1 double, y1 double")
        found = spatial.counted_roads(load(spark, SF, "lanes"), roads)
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
        sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", found._jdf.queryExecution().explainString(mode))]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", on)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert sizes and max(sizes) < 8000


@pytest.mark.parametrize("tile", [False, True])
def test_counted_roads(tile, spark):
    """As many sections at each place, with the same roads, as ``lane_roads`` has rows; lanes that overlap share places."""
    rng = np.random.default_rng(4)
    seg = lambda n, size: [(*map(float, a), *map(float, a + rng.uniform(-size, size, 2))) for a in rng.uniform(0, 90, (n, 2))]
    places = [*seg(12, 15), (40.0, 40.0, 56.0, 40.0), (44.0, 40.0, 60.0, 40.0), (900.0, 900.0, 905.0, 900.0), (1.0, 1.0, 1.0, 1.0), (None, 1.0, 2.0, 1.0)]
    lanes = spark.createDataFrame([(str(k), f"t{k % 2}", *places[k % 17]) for k in range(75)], "lane_id string, tile string, x0 double, y0 double, x1 double, y1 double")
    roads = spark.createDataFrame([(k if k % 5 else None, "primary" if k % 3 else None, f"t{k % 2}", *r) for k, r in enumerate([*seg(25, 30), (30.0, 45.0, 70.0, 45.0), (30.0, 45.0, 70.0, 45.0)])], "feature_id long, highway string, tile string, x0 double, y0 double, x1 double, y1 double")
    if not tile:
        lanes, roads = lanes.drop("tile"), roads.drop("tile")
    got = spatial.counted_roads(lanes, roads, 4.0)
    found = [x for x in got.columns if x != "n"]
    want = spatial.lane_roads(lanes, roads, 4.0).where("feature_id IS NOT NULL").groupBy(*found).agg(F.count(F.lit(1)).alias("n")).select(*got.columns)
    rows = sorted(map(str, got.collect()))
    assert rows == sorted(map(str, want.collect())) and len(rows) > 20


def test_angles_count_each_lane(spark):
    """``nearest_road_angle`` against SQL where places have 7 or 8 lanes; they are read once and never rows again."""
    import duckdb

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("customer", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = QUERIES["nearest_road_angle"](spark, sf)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet \[c_custkey", plan)) == 1
    got = found.collect()
    want = con.execute(plans.oracle_sql()["nearest_road_angle"]).fetchall()
    plain = lambda rows: sorted((str(h), n, f"{a:.9g}", f"{d:.9g}") for h, n, a, d in rows)
    assert plain(map(tuple, got)) == plain(want) and sum(r["n"] for r in got) > 1500


def test_a_repeated_road_id_is_one_road(spark):
    """A section has one row, however often its road is given; a road without an id hides none."""
    lanes = spark.createDataFrame([("a", 0.0, 0.0, 5.0, 0.0)], "lane_id string, x0 double, y0 double, x1 double, y1 double")
    roads = spark.createDataFrame([(7, "primary", 4.0), (7, "primary", 4.0), (7, "tertiary", 9.0), (None, "primary", 2.0)], "feature_id long, highway string, y0 double").selectExpr("*", "0D AS x0", "9D AS x1", "y0 AS y1")
    got = spatial.reference_road(spatial.sections(lanes, 2.0), roads).collect()
    assert [(r["k"], r["feature_id"], r["highway"], r["separation"]) for r in got] == [(k, 7, "primary", 4.0) for k in range(3)]


def test_equal_segments_are_compared_once(spark, monkeypatch):
    """Copies are one class; all pairs of them come back, in the order of their numbers, a ring's copies with each other too."""
    from corridor.operators import centerline

    seen, look = [], centerline.facing
    monkeypatch.setattr(centerline, "facing", lambda tips, c: (seen.append(tips.count()), look(tips, c))[1])
    line = lambda lo, hi: [(0.0, float(x)) for x in range(lo, hi)]
    ring = [(100 + r, c) for r, c in [*line(2, 8), (5.0, 7.0), (5.0, -7.0), *line(-7, -1)]]
    rows = [(k, 2.0, line(0, 11) if k % 2 else line(14, 25)) for k in range(1, 7)] + [(7, 2.0, ring), (8, 2.0, ring)]
    df = spark.createDataFrame(rows, "seg_id long, radius double, points array<struct<row: double, col: double>>")
    found = centerline.bridges(df)
    got = {(r["a"], r["b"]): (r["place_a"], r["place_b"], r["gap"]) for r in found.collect()}
    want = {(a, b): ((1, 0, 4.0) if a % 2 else (0, 1, 4.0)) for a in range(1, 7) for b in range(a + 1, 7) if (a + b) % 2}
    assert got == want | {(7, 8): (0, 1, 4.0)} and found.count() == 10
    assert seen == [6]


def test_equal_bridges_are_drawn_once(spark, monkeypatch):
    from corridor.operators import centerline

    drawn, keep = [], store.materialise
    monkeypatch.setattr(centerline, "materialise", lambda df, tag: (drawn.append((tag, out := keep(df, tag))), out)[1])
    rows = [(a, b, 4.0, 0.0, 10.0, 0.0, 14.0, 2.0, 1, 0) for a in (1, 3, 5) for b in (6, 8)]
    df = spark.createDataFrame(rows, "a long, b long, gap double, row double, col double, row1 double, col1 double, radius double, place_a int, place_b int")
    px = centerline.bridge_pixels(df).groupBy("a", "b").count().collect()
    assert len(px) == 6 and {r["count"] for r in px} == {5 * 5 + 8}
    assert [(tag, out.count()) for tag, out in drawn] == [("bridges", 1)]


def test_most_alike_with_copies(spark, monkeypatch):
    """Against all pairs: many copies, ties, repeated ids, NaN and rows without a similarity; blocks give no more than k rows each."""
    from corridor.operators import embed

    rnd = np.random.default_rng(5)
    v = [[float(x) for x in rnd.integers(-2, 3, 3)] for _ in range(12)]
    rows = [(int(k), "a", v[k % 12]) for k in rnd.permutation(150)] + [(7, "a", v[7]), (200, "a", None), (201, "a", [1.0, None, 0.0]), (202, "a", [1.0, float("nan"), 0.0]), (203, "a", [1.0, 2.0])]
    df = spark.createDataFrame(rows, "stem long, label string, embedding array<double>")
    kept, keep = [], store.materialise
    monkeypatch.setattr(embed, "materialise", lambda x, tag: (kept.append((tag, out := keep(x, tag))), out)[1])
    every = [tuple(r) for r in embed.pairs(df).select("a", "b", "similarity").orderBy(F.desc("similarity"), "a", "b").limit(220).collect()]
    plain = lambda rows: [(a, b, str(s)) for a, b, s in rows]
    for k, block in ((1, 64), (5, 40), (20, 16), (220, 2048)):
        assert plain(tuple(r) for r in embed.most_alike(df, k, block=block).collect()) == plain(every[:k])
    sizes = [out.groupBy().count().first()[0] for tag, out in kept if tag == "crops"]
    assert sizes[0] < 45 and sizes == sorted(sizes)
    few = df.where("stem >= 200")
    assert len(embed.most_alike(few, 20).collect()) == 6


def test_of_two_nearest_places_the_first_along_the_line(spark):
    """Two polylines of ``path_points`` that a lane's start is equally near to twice."""
    from corridor.operators import lines
    from corridor.sources.relations import RELATIONS

    points = spark.sql(RELATIONS["path_points"], supplier=spark.createDataFrame([(256,), (371,)], "s_suppkey long"))
    starts = spark.createDataFrame([("183:0", 53.0 * 183 % 200, 17.0 * 183 % 200), ("10:0", 53.0 * 10 % 200, 17.0 * 10 % 200)], "lane_id string, px double, py double")
    found = lines.positions(starts, lines.collect(points, "path_id", "j"), 15.0, ["lane_id"], "path_id").collect()
    got = {(r["lane_id"], r["path_id"]): (round(r["separation"], 5), round(r["arc_m"], 5)) for r in found}
    assert got[("10:0", 371)] == (8.48528, 4.24264) and got[("183:0", 256)] == (12.72792, 23.56711)


@pytest.mark.parametrize("tile", [False, True])
def test_positions_of_copies(tile, spark, monkeypatch):
    """Each point's closest place of each line against every segment's; places and courses that occur often are compared once, repeated ids are one."""
    from corridor.operators import lines

    rng = np.random.default_rng(6)
    spots, courses = rng.uniform(0, 40, (6, 2)), rng.uniform(0, 40, (5, 4, 2))
    courses[4, 1] = courses[4, 0]
    # points 38 and 39 have two places, lines 28 and 29 two courses
    own = [(k % 38 if k > 39 else k, k % 2, *map(float, spots[k % 6])) for k in range(40)] + [(k, k % 2, *map(float, spots[3])) for k in (38, 39)] + [(90, 0, None, 1.0), (91, 0, 900.0, 900.0)]
    ways = [(k, k % 2, [(float(x), float(y)) for x, y in courses[k % 5]]) for k in range(30)] + [(k, k % 2, [(float(x), float(y)) for x, y in courses[2]]) for k in (28, 29)] + [(70, 0, [(1.0, 1.0)]), (71, 0, None)]
    p = spark.createDataFrame(own, "lane_id long, tile int, px double, py double")
    r = spark.createDataFrame(ways, "path_id long, tile int, points array<struct<x: double, y: double>>")
    if not tile:
        p, r = p.drop("tile"), r.drop("tile")
    asked, meet = [], spatial.meeting
    monkeypatch.setattr(spatial, "meeting", lambda a, b, *rest: (asked.append((a.count(), a.distinct().count(), b.count(), b.distinct().count())), meet(a, b, *rest))[1])
    monkeypatch.setattr(lines, "CHUNK", 2)
    got = lines.positions(p, r, 9.0, ["lane_id"], "path_id")
    assert got.columns == ["lane_id", "path_id", "separation", "arc_m", "x", "y"]
    want = {}
    for a, s, px, py in own:
        for b, t, line in ways:
            if px is None or line is None or (tile and s != t):
                continue
            start = 0.0
            for u, v in zip(map(np.array, line), map(np.array, line[1:])):
                d = v - u
                k = float(np.clip((np.array([px, py]) - u) @ d / ((d @ d) or 1.0), 0, 1))
                q = u + k * d
                far = float(np.hypot(*(q - (px, py))))
                if far <= 9.0:
                    want[a, b] = min(want.get((a, b), (99.0,)), (round(far, 6), round(start + k * float(np.hypot(*d)), 6), *(round(float(x), 6) for x in q)))
                start += float(np.hypot(*d))
    rows = got.collect()
    found = {(x["lane_id"], x["path_id"]): tuple(round(v, 6) for v in x[2:]) for x in rows}
    assert len(rows) == len(found) == len(want) > 100 and found.keys() == want.keys()
    assert all(np.allclose(found[k], want[k], atol=2e-6) for k in want)
    assert asked and all(n == one for a in asked for n, one in (a[:2], a[2:])) and asked[0][0] < 22
    assert {tuple(x) for x in lines.positions(p, r, 9.0, ["lane_id"], "path_id", digits=2).select("separation", "arc_m").collect()} == {tuple(x) for x in got.select(F.round("separation", 2), F.round("arc_m", 2)).collect()}


def test_sections_belong_to_the_tile_of_their_road(spark):
    """A lane beyond the tile's border is measured where its road lies inside, as in the reference; one whose road lies outside is not."""
    px = spark.createDataFrame([("t", r, c, 100, 100, 100, 90, r < 10, False, False) for r in range(60) for c in range(60)], "tile string, prow int, pcol int, r int, g int, b int, nir int, lane boolean, shadow boolean, near_edge boolean")
    lanes = spark.createDataFrame([("out", 0.0, 6.5, 5.0, 6.5), ("in", 0.0, 0.5, 5.0, 0.5)], "lane_id string, x0 double, y0 double, x1 double, y1 double")
    roads = spark.createDataFrame([(1, "residential", 0.0, 2.0, 9.0, 2.0), (2, "primary", 0.0, -0.5, 9.0, -0.5)], "feature_id long, highway string, x0 double, y0 double, x1 double, y1 double")
    rows = sections.measure_gaps(px, lanes, roads, (0.1, -0.1, 0.0, 6.0), "t", 60, 60).collect()
    got = {(r["lane_id"], r["k"]): (r["skip"], r["highway"], r["gap_m"] and round(r["gap_m"], 1)) for r in rows}
    assert {got["in", k] for k in range(3)} == {("off", "primary", None)}
    assert {got["out", k] for k in range(3)} == {(None, "residential", 0.3)}


def test_tiles_run_tells_gaps_by_class(spark, monkeypatch):
    """Every section is counted by reason and class of road, with the median of reliable gaps; as if no shadow were found, too."""
    from corridor.operators import chain

    got = {tuple(r)[:3] for r in QUERIES["tiles_run"](spark, SF).collect()}
    n = spark.read.parquet(f"{SF}/supplier.parquet").count() * 2
    assert sum(r[2] for r in got) == n and {r[0] for r in got if r[1] is None} == {"far"}
    monkeypatch.setattr(raster, "clean_mask", lambda mask, *rest: mask.limit(0))
    monkeypatch.setattr(chain, "WHOLE", 0)
    rows = [tuple(r) for r in QUERIES["tiles_run"](spark, SF).collect()]
    assert {r[0] for r in rows} == {"far", "measured"} and sum(r[2] for r in rows) == n
    # lanes begin 4 m from the road and 0.1 m more for each of (s % 8)
    assert {r[1]: r[3] for r in rows} == {"residential": 1.55, "primary": 0.0, None: None}


@pytest.mark.parametrize("branch", ["class", "pixels"])
def test_whole_tiles_are_measured_as_pixels_are(branch, spark, monkeypatch):
    """Tiles gone through as arrays, as relations of pixels, and some of each: equal records, with shadows, pixels missing and none at all."""
    from corridor.operators import chain

    rng = np.random.default_rng(9)
    size = {"a": (90, 60), "b": (90, 60), "c": (70, 110), "d": (90, 60), "none": (60, 60)}
    px, tiles, lanes, roads = [], [], [], []
    for k, (tile, (h, w)) in enumerate(size.items()):
        x0, y0 = 1000.0 * k, h / 10
        tiles.append((tile, 0.1, -0.1, x0, y0, h, w))
        lanes += [(tile, "l", x0 + 0.3, y0 - 1.6, x0 + w / 10 + 3, y0 - 1.3), (tile, "m", x0 + 0.5, 0.6, x0 + 4.0, 0.6)]
        roads += [(2 * k, "residential", x0 - 2.0, y0 - 5.0, x0 + w / 10 + 9, y0 - 4.8), (2 * k + 1, "tertiary", x0 + 1.0, -0.8, x0 + 4.0, 0.1)]
        if tile == "none":
            continue
        noise = rng.integers(-6, 7, (4, h, w))
        for r in range(h):
            for q in range(w):
                lane = 10 <= r < 22
                of = np.array([140, 85, 80, 100] if lane else [90, 120, 95, 200] if 22 <= r < 28 + k else [105, 104, 100, 92])
                if (q > w - 25 and r > 45) if k != 1 else q < 20:
                    of = of * np.array([0.4, 0.45, 0.6, 0.4])
                if tile != "d" or not 60 < r < 64:
                    px.append((tile, r, q, *map(int, np.clip(of + noise[:, r, q], 0, 255)), lane))
    px = spark.createDataFrame(px, "tile string, prow int, pcol int, r int, g int, b int, nir int, lane boolean")
    tiles = spark.createDataFrame(tiles, "tile string, a double, e double, x0 double, y0 double, height int, width int")
    lanes = spark.createDataFrame(lanes, "tile string, lane_id string, x0 double, y0 double, x1 double, y1 double")
    roads = spark.createDataFrame(roads, "feature_id long, highway string, x0 double, y0 double, x1 double, y1 double")
    c = type(CONFIG)(section_interval_m=0.25, shadow_edge_margin_m=0.4)
    told = {}
    for most in (chain.WHOLE, 6000, 0):
        monkeypatch.setattr(chain, "WHOLE", most)
        got = sections.run_tiles(px, lanes, roads, tiles, 0.1, branch, c)
        kinds = got.dtypes
        plain = lambda v: [plain(x) for x in v] if isinstance(v, list) else round(v, 6) if isinstance(v, float) else v
        told[most] = kinds, sorted(str([plain(v) for v in r]) for r in got.collect())
    (a, b, d) = told.values()
    assert a[0] == b[0] == d[0] and len(a[1]) > 150
    assert a[1] == d[1]
    assert b[1] == d[1]
    reasons = {x: sum(f"'{x}'" in r for r in a[1]) for x in ("far", "off", "shadow", "unresolved")}
    assert sum(n > 3 for n in reasons.values()) >= 3 and sum("True" in r for r in a[1]) > 10, reasons
