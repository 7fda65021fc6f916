"""Operators on small inputs whose answers are known."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from corridor.config import CONFIG
from corridor.functions import color, geometry, labels
from corridor.operators import centerline, dataset, dissolve, kernels, lines, raster, report, sections, series, spatial, widths
from corridor.plans import detect
from corridor.sources import store


def grid(spark, mask, tile="t"):
    return spark.createDataFrame([(tile, int(r), int(c)) for r, c in np.argwhere(mask)], "tile string, prow int, pcol int")


def back(df, shape):
    out = np.zeros(shape, bool)
    for r in df.collect():
        out[r["prow"], r["pcol"]] = True
    return out


def test_blocks_do_not_show(spark):
    """Components and closings that cross blocks are those of the whole."""
    m = np.random.default_rng(1).random((40, 50)) < 0.5
    got = raster.components(grid(spark, m), block=8).collect()
    want = kernels.label(m)
    assert {((r["comp"] >> 31) * 50 + r["comp"] % 2**31 + 1, r["prow"], r["pcol"]) for r in got} == {(int(want[r, c]), int(r), int(c)) for r, c in np.argwhere(m)}
    frame = spark.createDataFrame([("t", 40, 50)], "tile string, height int, width int")
    closed = raster.closing(grid(spark, m), 2, frame, block=8)
    pixels = grid(spark, np.ones_like(m))
    d = {(r["prow"], r["pcol"]): r["distance"] for r in raster.distance(grid(spark, m), pixels, 5, block=8).collect()}
    assert (back(closed, m.shape) == kernels.close(m, kernels.disk(2))).all()
    want = kernels.edt(m)[0]
    assert all((v is None and want[k] > 5) or abs(v - want[k]) < 1e-9 for k, v in d.items()) and len(d) == m.size


def test_nearest_has_no_reach(spark):
    m = np.zeros((30, 300), bool)
    m[3, 2] = m[25, 140] = True
    asked = np.random.default_rng(2).random(m.shape) < 0.2
    got = {(r["prow"], r["pcol"]): r for r in raster.nearest(grid(spark, m), grid(spark, asked), 16).collect()}
    want, row, col = kernels.edt(m)
    assert set(got) == {tuple(map(int, x)) for x in np.argwhere(asked)}
    assert all(r["distance"] == want[k] and (r["near_row"], r["near_col"]) == (row[k], col[k]) for k, r in got.items())
    other = raster.nearest(grid(spark, m, "other"), grid(spark, asked)).collect()
    assert len(other) == asked.sum() and all(r["distance"] is None and r["near_row"] is None for r in other)


def plain_correction(bands, shadow, road, gsd, c):
    """Pixel by pixel."""
    h, w = shadow.shape
    half = max(1, round(c.shadow_window_m / gsd))
    sun, shade = [(r, q) for r in range(h) for q in range(w) if road[r, q] and not shadow[r, q]], [(r, q) for r in range(h) for q in range(w) if road[r, q] and shadow[r, q]]
    out = bands.astype(float)
    if not sun or not shade:
        return bands
    first = lambda p, places: min(places, key=lambda x: ((x[0] - p[0]) ** 2 + (x[1] - p[1]) ** 2, x))
    inside = lambda p, places: [x for x in places if abs(x[0] - p[0]) <= half and abs(x[1] - p[1]) <= half]
    lift = {}
    for p in shade:
        n = first(p, sun)
        t = min(1.0, np.hypot(n[0] - p[0], n[1] - p[1]) * gsd / c.feather_m)
        lit, dim = inside(p, sun), inside(p, shade)
        for k in range(len(bands)):
            base = max(1.0, np.mean([bands[k][x] for x in dim]))
            goal = float(bands[k][n])
            if len(lit) >= c.min_reference_density * (2 * half + 1) ** 2:
                goal = goal * (1 - t) + np.mean([bands[k][x] for x in lit]) * t
            lift[k, p] = min(max(goal - base, 0.0), base * (c.shadow_max_gain - 1))
            out[k][p] += lift[k, p]
    for p in sun:
        n = first(p, shade)
        t = 1 - np.hypot(n[0] - p[0], n[1] - p[1]) * gsd / c.bleed_m
        for k in range(len(bands)):
            out[k][p] += lift[k, n] * max(0.0, t)
    return np.clip(out, 0, 255).astype(int)


def corrected(spark, bands, shadow, road, gsd, c):
    rows = [("t", r, q, *[int(b[r, q]) for b in bands], bool(road[r, q]), bool(shadow[r, q])) for r in range(shadow.shape[0]) for q in range(shadow.shape[1])]
    px = spark.createDataFrame(rows, "tile string, prow int, pcol int, r int, g int, b int, nir int, road boolean, shadow boolean")
    out = np.zeros(bands.shape, int)
    for x in raster.correct_shadows(px, gsd, c).collect():
        out[:, x["prow"], x["pcol"]] = [x[b] for b in raster.BANDS]
    return out


def test_shadows_are_corrected_pixel_by_pixel(spark):
    c = replace(CONFIG, shadow_window_m=1.5, feather_m=1.0, bleed_m=1.1)
    rng = np.random.default_rng(4)
    bands, shadow, road = rng.integers(0, 256, (4, 14, 21)), np.zeros((14, 21), bool), rng.random((14, 21)) < 0.9
    shadow[2:12, 3:14] = rng.random((10, 11)) < 0.9
    want = plain_correction(bands, shadow, road, 0.5, c)
    assert (np.abs(corrected(spark, bands, shadow, road, 0.5, c) - want) <= (np.abs(want - want.round()) > 1e-9)).all() and (want != bands).any()
    assert (corrected(spark, bands, road, road, 0.5, c) == bands).all()  # nothing sunlit


def test_far_shadows_are_corrected(spark):
    """A strip far longer than a block and the window, with sun in its first pixels only."""
    bands, shadow = np.full((4, 2, 1400), 60), np.ones((2, 1400), bool)
    bands[:, :, :10], shadow[:, :10] = 180, False
    out = corrected(spark, bands, shadow, np.ones_like(shadow), 1.0, CONFIG)
    assert (out[:, :, 10:] == 180).all()


def test_bands_of_constant_width(spark):
    """Against whole grids: depth by the transform, discs by distance."""
    rng = np.random.default_rng(6)
    m = np.zeros((60, 140), bool)
    for q in range(5, 130):
        top = int(20 + 8 * np.sin(q / 17) + rng.integers(0, 3))
        m[top : top + rng.integers(7, 12), q] = True
    parts = {1: m, 2: np.roll(m, 11, axis=0)}
    px = [(k, int(r), int(q)) for k, v in parts.items() for r, q in np.argwhere(v)]
    df = spark.createDataFrame(px, "comp int, prow int, pcol int")
    got = centerline.regularised(df, 3.0).collect()
    assert len(got) == len({(r["comp"], r["prow"], r["pcol"]) for r in got})
    for k, v in parts.items():
        line = sorted((r["bin"], r["row"], r["col"]) for r in centerline.binned(df, 3.0).where(f"comp = {k}").collect())
        wide = np.pad(v, 200)
        at = np.rint([x[1:] for x in line]).astype(int)
        radius = np.median(kernels.edt(~wide)[0][at[:, 0] + 200, at[:, 1] + 200])
        window = max(3, round(CONFIG.smoothing_width_multiple * radius))
        if window < len(at):
            at = np.stack([np.rint(kernels.moving_average(x, window)) for x in at.T], 1).astype(int)
        seeds = np.zeros_like(wide)
        seeds[at[:, 0] + 200, at[:, 1] + 200] = True
        want = {(int(r) - 200, int(q) - 200) for r, q in np.argwhere(kernels.edt(seeds)[0] <= radius)}
        assert {(r["prow"], r["pcol"]) for r in got if r["comp"] == k} == want and {r["radius"] for r in got if r["comp"] == k} == {radius}


def test_bridges_of_mixed_radii(spark):
    """Every pair of tips, whatever the segments' radii, against all pairs."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(120):
        r, q, t = rng.uniform(0, 200), rng.uniform(0, 200), rng.uniform(0, 2 * np.pi)
        rows.append((k, float(rng.choice([0.1, 1.0, 3.0, 40.0])), [(float(r + j * np.sin(t)), float(q + j * np.cos(t))) for j in range(8)]))
    df = spark.createDataFrame(rows, "seg_id long, radius double, points array<struct<row:double,col:double>>")
    tip = {r: (np.array(p[0]), np.array(p[0]) - p[5], np.array(p[-1]), np.array(p[-1]) - p[-6]) for r, _, p in rows}
    want = {}
    for a, ra, _ in rows:
        for b, rb, _ in rows:
            for pa_, pb in ((1, 1), (1, 0), (0, 1), (0, 0)) if a < b else ():
                (x, u), (y, v) = tip[a][2 * pa_ : 2 * pa_ + 2], tip[b][2 * pb : 2 * pb + 2]
                gap = np.hypot(*(y - x))
                if 0 < gap <= 4 * min(ra, rb) and (y - x) @ u / np.hypot(*u) / gap >= 0.82 and -(y - x) @ v / np.hypot(*v) / gap >= 0.82:
                    want[a, b] = (pa_, pb)
    assert {(r["a"], r["b"]): (r["place_a"], r["place_b"]) for r in centerline.bridges(df).collect()} == want and len(want) > 10


def test_otsu_of_a_constant(spark):
    px = spark.createDataFrame([("t", 0, c, 0.25) for c in range(5)], "tile string, prow int, pcol int, v double")
    cut = raster.otsu(px, "v").first()["threshold"]
    assert cut <= 0.25 or abs(cut - 0.25) < 0.01  # all values fall into one bin


def test_empty_masks(spark):
    none = grid(spark, np.zeros((2, 2), bool))
    frame = spark.createDataFrame([("t", 2, 2)], "tile string, height int, width int")
    assert raster.components(none).count() == 0 and raster.closing(none, 1, frame).count() == 0 and raster.dilation(none, kernels.disk(1)).count() == 0
    _, row = dissolve.dissolve(none, frame, 1.0)
    assert row.first()["parts_before"] == 0


def test_phantom_by_pixels(spark):
    rows = detect.gap_records_by_pixels(spark, detect_sf()).collect()
    assert len(rows) == 20 and {r["composition"] for r in rows} == {"vegetation"} and all(abs(r["gap_m"] - 1.4) < 0.1 for r in rows)


def detect_sf():
    from conftest import SF

    return SF


def test_candidates_are_conserved(spark):
    rows = {r["reason"]: r["n"] for r in detect.skip_counts(spark, detect_sf()).collect()}
    assert sum(rows.values()) == 20 and rows["shadow"] > 0 and rows["measured"] > 0


def test_road_nulls_stay_far(spark):
    lanes = spark.createDataFrame([("a", 0.0, 0.0, 10.0, 0.0)], "lane_id string, x0 double, y0 double, x1 double, y1 double")
    roads = spark.createDataFrame([(1, "residential", 5.0, 5.0, 5.0, 5.0), (2, "service", 0.0, 6.0, 10.0, 6.0), (3, None, 0.0, 0.3, 10.0, 0.3)], "feature_id long, highway string, x0 double, y0 double, x1 double, y1 double")
    rows = spatial.reference_road(spatial.sections(lanes), roads).collect()
    # a road without length has no direction, a service road is left out, another is too near
    assert len(rows) == 5 and all(r["separation"] is None and r["road_width"] is None for r in rows)
    near = spark.createDataFrame([(5, "residential", 0.0, 6.0, 10.0, 6.0), (4, "primary", 0.0, -6.0, 10.0, -6.0)], roads.schema)
    rows = spatial.reference_road(spatial.sections(lanes), near).collect()
    assert {(r["feature_id"], r["road_width"]) for r in rows} == {(4, 12.0)}  # a tie goes to the smaller id


def test_utm_origin(spark):
    e, n = geometry.utm_32(F.lit(9.0), F.lit(0.0))
    e2, n2 = geometry.utm_32(F.lit(7.0), F.lit(51.0))
    r = spark.range(1).select(e.alias("e"), n.alias("n"), e2.alias("e2"), n2.alias("n2")).first()
    assert abs(r["e"] - 500000) < 1e-6 and abs(r["n"]) < 1e-6
    # a degree of longitude at 51 degrees is 70.2 km on the ellipsoid
    assert abs((500000 - r["e2"]) / 2 - 70.197e3 * 0.9996) < 30 and 5.64e6 < r["n2"] < 5.66e6


def test_labels(spark):
    rows = spark.createDataFrame([("cycleway", None, None), (None, "designated", None), ("primary", None, "lane"), ("primary", "no", "no"), (None, None, None)], "highway string, bicycle string, cycleway string")
    for k in ("cycleway_left", "cycleway_right", "cycleway_both"):
        rows = rows.withColumn(k, F.lit(None).cast("string"))
    assert [r[0] for r in rows.select(labels.category()).collect()] == ["bikelane", "bikelane", "bikelane", "street", "street"]
    assert [r[0] for r in rows.select(labels.road_width()).collect()] == [6.0, 6.0, 12.0, 12.0, 6.0]
    f = lambda *v: spark.range(1).select(labels.material(*map(F.lit, v))).first()[0]
    assert [f(0.2, True, 0.9, 0.9, 200.0), f(0.1, True, 0.9, 0.9, 200.0), f(0.0, False, 0.16, 0.9, 200.0), f(0.0, False, 0.15, 0.06, 200.0), f(0.0, False, 0.0, 0.05, 165.1), f(0.0, False, 0.0, 0.0, 165.0)] == [
        "unknown (shadow)", "bright/marking", "vegetation", "red paint", "bright/marking", "asphalt",
    ]


def test_hex_and_classes(spark):
    r = spark.range(1).select(*[color.hex_channel(F.lit("#ff7800"), k) for k in range(3)], *[color.break_class(F.lit(v)) for v in (0.0, 0.5, 3.9, 4.0, 99.0)]).first()
    assert tuple(r) == (255, 120, 0, 0, 1, 3, 4, 4)


def test_ray_walk():
    hit = np.array([1, 1, 0, 0, 1, 0, 0, 0, 0, 0], bool)
    inside = np.ones(10, bool)
    assert widths.walk(inside, hit, 0.5, 1.5) == (2.0, False, False)  # more than three misses end it
    assert widths.walk(inside, np.ones(10, bool), 0.5, 1.5) == (4.5, False, True)
    inside[3] = False
    assert widths.walk(inside, hit, 0.5, 1.5) == (0.5, True, False)


def test_road_widths(spark):
    rows = detect.width_samples(spark, detect_sf()).collect()
    # the surface is 86 rows of 0.1 m high and the first way lies in it
    assert all(abs(r["width_m"] - 8.6) < 0.3 for r in rows if r["way_id"] == 1) and any(r["way_id"] == 1 for r in rows)


def test_pca_of_a_diagonal(spark):
    px = spark.createDataFrame([(1, i, i) for i in range(60)], "comp int, prow int, pcol int")
    a = centerline.axis(px).first()
    assert abs(a["ar"] - a["ac"]) < 1e-9 and abs(a["ar"] - 0.5**0.5) < 1e-9
    assert centerline.binned(px, 6.0).count() >= 7 and centerline.binned(px.limit(6), 6.0).count() == 0


def test_bridge(spark):
    point = lambda r, c: (float(r), float(c))
    rows = [(1, 2.0, [point(5, c) for c in range(8)]), (2, 2.0, [point(5, c) for c in range(12, 20)]), (3, 2.0, [point(15 + c, 30) for c in range(8)])]
    df = spark.createDataFrame(rows, "seg_id long, radius double, points array<struct<row:double,col:double>>")
    found = centerline.bridges(df).collect()
    assert [(r["a"], r["b"], r["gap"], r["place_a"], r["place_b"]) for r in found] == [(1, 2, 5.0, 1, 0)]
    px = {(r["prow"], r["pcol"]) for r in centerline.bridge_pixels(centerline.bridges(df)).collect()}
    assert {(5, c) for c in range(7, 13)} <= px


def test_annotations(spark):
    lines = spark.createDataFrame([("a", 1, "0 0.1 0.1 0.5 0.1 0.5 0.9"), ("a", 2, "  "), ("a", 3, "1 0.1 0.2"), ("b", 4, "1 0 0 1 0 1 1")], "stem string, line_no long, line string")
    rows = dataset.parse(lines)
    assert sorted((r["line_no"], r["class_id"], len(r["xy"])) for r in rows.collect()) == [(1, 0, 3), (4, 1, 3)]
    tiles = spark.createDataFrame([("a", 1000, 700)], "stem string, width int, height int")
    have, missing = dataset.with_tiles(rows, tiles)
    assert [r["stem"] for r in missing.collect()] == ["b"]
    chips = dataset.chips(tiles)
    assert sorted((r["x0"], r["y0"], r["w"], r["h"]) for r in chips.collect()) == [(0, 0, 640, 640), (0, 576, 640, 124), (576, 0, 424, 640), (576, 576, 424, 124)]
    cut = dataset.clip(dataset.by_chip(dataset.denormalise(have, 1000, 700), chips)).collect()
    assert all(len(r["label"].split()) >= 7 for r in cut)
    whole = 0.5 * 400 * 560
    top = next(r for r in cut if r["chip"] == "a_0_0")
    assert all(r["label"].split()[1:3] == r["label"].split()[-2:] for r in cut)
    assert abs(top["area"] - whole) < 1e-6 and {"val", "train"} == {r["split"] for r in dataset.split(chips).collect()}


def test_split_is_by_name(spark):
    """As text: a_1000_0 comes before a_576_0, and a stem that begins another comes in between."""
    names = [f"{s}_{x}_{y}" for s in ("a", "a_1", "b") for x in (0, 576, 1152, 1000) for y in (0, 576)]
    chips = spark.createDataFrame([(n.rsplit("_", 2)[0], n) for n in names], "stem string, chip string")
    got = {r["chip"] for r in dataset.split(chips).where("split = 'val'").collect()}
    assert got == set(sorted(names)[-5:])


def test_image_chips(spark):
    tiles = spark.createDataFrame([("a", 70, 50)], "stem string, width int, height int")
    images = spark.createDataFrame([("a", r, c, r, c, (r + c) % 256) for r in range(50) for c in range(70)], "stem string, prow int, pcol int, r int, g int, b int")
    grid_ = dataset.chips(tiles, 32, 8).withColumn("split", F.lit("train"))
    got = dataset.image_chips(images, grid_, 32).collect()
    want = {r["chip"]: r for r in grid_.collect()}
    assert {r["chip"] for r in got} == set(want)
    for r in got:
        x = np.frombuffer(r["rgb"], np.uint8).reshape(r["h"], r["w"], 3)
        c = want[r["chip"]]
        rows, cols = np.mgrid[c["y0"] : c["y0"] + c["h"], c["x0"] : c["x0"] + c["w"]]
        assert (x == np.stack([rows, cols, (rows + cols) % 256], 2)).all()


def plain_line(points, s):
    left = s
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        n = np.hypot(x1 - x0, y1 - y0)
        if left < n or (x1, y1) == points[-1]:
            t = min(left / n, 1.0) if n else 0.0
            return np.array([x0 + t * (x1 - x0), y0 + t * (y1 - y0)])
        left -= n


def test_polylines(spark):
    """Places, directions, projections and nearest streets on bent lines, against walking along them."""
    rng = np.random.default_rng(9)
    shapes = {k: [tuple(map(float, p)) for p in np.cumsum(rng.uniform(-4, 8, (rng.integers(2, 7), 2)), 0) + rng.uniform(0, 60, 2)] for k in range(25)}
    df = spark.createDataFrame([(k, [v]) for k, v in shapes.items()], "feature_id long, parts array<array<struct<x:double,y:double>>>")
    flat = lines.flatten(df)
    assert {r["line_id"] for r in flat.collect()} == {f"{k}:0" for k in shapes}
    total = {k: sum(np.hypot(*np.subtract(b, a)) for a, b in zip(v, v[1:])) for k, v in shapes.items()}
    got = lines.samples(flat, 2.0).collect()
    assert len(got) == sum(int(np.ceil(n / 2)) for n in total.values())

    def direction(k, s):
        d = plain_line(shapes[k], min(total[k], s + 2.5)) - plain_line(shapes[k], max(0.0, s - 2.5))
        return d / np.hypot(*d)

    for r in got:
        k = r["feature_id"]
        assert np.allclose((r["px"], r["py"]), plain_line(shapes[k], r["offset_m"])) and np.allclose((r["tx"], r["ty"]), direction(k, r["offset_m"]))
    lanes = flat.where("feature_id < 8").select(F.lit("t").alias("tile"), F.col("line_id").alias("lane_id"), "points")
    roads = flat.where("feature_id >= 8").select("feature_id", "points", F.lit("residential").alias("highway"))
    found = {(r["lane_id"], r["k"]): r for r in spatial.reference_road(lines.samples(lanes, 2.0), roads).collect()}
    assert len(found) == sum(int(np.ceil(total[k] / 2)) for k in range(8))
    some = 0
    for (lane, _), r in found.items():
        p, own = np.array([r["px"], r["py"]]), np.array([r["tx"], r["ty"]])
        best = None
        for k in range(8, 25):
            at, near = 0.0, (np.inf, 0.0)
            for a, b in zip(shapes[k], shapes[k][1:]):
                a, b = np.array(a), np.array(b)
                t = np.clip((p - a) @ (b - a) / ((b - a) @ (b - a)), 0, 1)
                near = min(near, (np.hypot(*(p - a - t * (b - a))), at + t * np.hypot(*(b - a))))
                at += np.hypot(*(b - a))
            angle = np.degrees(np.arccos(min(1.0, abs(own @ direction(k, near[1])))))
            if 0.5 < near[0] <= 20 and angle <= 35 and (best is None or near[0] < best[0]):
                best = (near[0], k)
        assert (r["feature_id"] is None) == (best is None) and (best is None or (abs(r["separation"] - best[0]) < 1e-9 and r["feature_id"] == best[1]))
        some += best is not None
    assert some > 10


def test_nearest_road_rings(spark):
    """The near ring never hides a nearer road, and far sections look further."""
    rng = np.random.default_rng(11)
    seg = lambda n, size: [(k, *map(float, a), *map(float, a + rng.uniform(-size, size, 2))) for k, a in enumerate(rng.uniform(0, 120, (n, 2)))]
    lanes, roads = seg(40, 15), seg(25, 30)
    l_ = spark.createDataFrame([(str(k), *r) for k, *r in lanes], "lane_id string, x0 double, y0 double, x1 double, y1 double")
    r_ = spark.createDataFrame([(*r, "primary") for r in roads], "feature_id long, x0 double, y0 double, x1 double, y1 double, highway string")
    got = spatial.reference_road(spatial.sections(l_, 4.0), r_).collect()
    near = 0
    for r in got:
        p, own, best = np.array([r["px"], r["py"]]), np.array([r["tx"], r["ty"]]), None
        for k, x0, y0, x1, y1 in roads:
            a, d = np.array([x0, y0]), np.array([x1 - x0, y1 - y0])
            t = np.clip((p - a) @ d / (d @ d), 0, 1)
            sep = np.hypot(*(p - a - t * d))
            if 0.5 < sep <= 20 and np.degrees(np.arccos(min(1.0, abs(own @ d / np.hypot(*d))))) <= 35:
                best = min(best or (np.inf, 0), (sep, k))
        assert (r["feature_id"] is None) == (best is None) and (best is None or r["feature_id"] == best[1])
        near += best is not None and best[0] < 5
    assert 0 < near < len(got)


def test_filter_tile_branches(spark):
    px = spark.createDataFrame([("t", r, c, 120 if c < 20 else 60, 100 if c < 20 else 60, 90 if c < 20 else 100, 80, c % 7 == 0, r > 3) for r in range(30) for c in range(40)], "tile string, prow int, pcol int, r int, g int, b int, nir int, bikelane boolean, street boolean")
    get = lambda mode, boost=False: {(r["prow"], r["pcol"]): r for r in raster.filter_tile(px, 0.5, mode, boost).collect()}
    none, cut, right = get("none"), get("cut"), get("correct")
    assert none[10, 30]["shadow"] == 1 and none[10, 30]["class"] == 2 and none[10, 30]["r"] == 60 and none[10, 10]["shadow"] == 0
    assert none[0, 1]["class"] == 0 and none[0, 1]["r"] == 0 and none[10, 7]["class"] == 1
    assert cut[10, 30]["class"] == 0 and cut[10, 30]["nir"] == 0 and cut[10, 30]["shadow"] == 1 and cut[10, 10] == none[10, 10]
    assert right[10, 30]["r"] > 100 and right[10, 30]["shadow"] == 1 and right[10, 5]["r"] == 120
    red = spark.createDataFrame([("t", 0, c, 150, 100, 100, 80, True, False) for c in range(4)], px.schema)
    assert {(r["r"], r["g"]) for r in raster.filter_tile(red, 0.5).collect()} == {(150, 59)}


def test_split_sizes(spark):
    chips = spark.createDataFrame([("s", f"c{k}") for k in range(8)], "stem string, chip string")
    assert [r["chip"] for r in dataset.split(chips).where("split = 'val'").orderBy("chip").collect()] == ["c6", "c7"]
    one = spark.createDataFrame([("s", "c")], "stem string, chip string")
    assert dataset.split(one).first()["split"] == "train"


def test_marking(spark):
    rows = [(1, i, 230.0 if 60 <= i < 64 else 100.0) for i in range(120)]
    found = series.markings(spark.createDataFrame(rows, "section_id int, i int, brightness double")).collect()
    assert len(found) == 1 and 58 < found[0]["left_at"] < 61 and 62 < found[0]["right_at"] < 65


def test_sinks(spark, tmp_path):
    g = spark.createDataFrame([("a", 1.0, 2.0, 0.5)], "lane_id string, px double, py double, gap_m double")
    store.save_records(g, str(tmp_path / "gaps"))
    assert spark.read.parquet(str(tmp_path / "gaps")).columns == ["lane_id", "gap_m"]
    report.save("# x", spark, str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report")).first()[0] == "# x"
    assert store.result_path("r", "gaps", (1, 2, 3, 4)) != store.result_path("r", "gaps")
    empty = spark.createDataFrame([], "lane_id string, gap_m double, composition string, reliable boolean")
    assert report.bullets(empty) == ["No section was measured."]


def test_unresolved_and_off(spark):
    px = spark.createDataFrame([("t", r, c, 100, 100, 100, 90, False, False, False) for r in range(60) for c in range(60)], "tile string, prow int, pcol int, r int, g int, b int, nir int, lane boolean, shadow boolean, near_edge boolean")
    lanes = spark.createDataFrame([("a", 0.0, 1.0, 10.0, 1.0)], "lane_id string, x0 double, y0 double, x1 double, y1 double")
    roads = spark.createDataFrame([(1, "service", 0.0, 3.0, 10.0, 3.0), (2, "primary", 0.0, 4.0, 10.0, 4.0)], "feature_id long, highway string, x0 double, y0 double, x1 double, y1 double")
    rows = sections.measure_gaps(px, lanes, roads, (0.1, -0.1, 0.0, 6.0), "t", 60, 60, c=CONFIG).collect()
    # beyond 6 m the tile ends; inside it no lane mask holds the lane's line
    assert {(r["k"], r["skip"]) for r in rows} == {(0, "unresolved"), (1, "unresolved"), (2, "unresolved"), (3, "off"), (4, "off")}


def test_export(spark, tmp_path):
    lines = spark.createDataFrame([("a", 1, "0 0.1 0.1 0.5 0.1 0.5 0.9"), ("z", 1, "0 0 0 1 0 1 1")], "stem string, line_no long, line string")
    names = dataset.merged_names(spark.createDataFrame([("e1", 0, "old"), ("e2", 0, "lane")], "export string, class_id int, name string"))
    tiles = spark.createDataFrame([("a", 1000, 700)], "stem string, width int, height int")
    chips, missing = dataset.export(lines, names, tiles, str(tmp_path))
    assert [r["stem"] for r in missing.collect()] == ["z"] and sum(r["n"] for r in chips.collect()) == spark.read.text(str(tmp_path / "labels")).count()
    assert "  0: lane" in [r[0] for r in spark.read.text(str(tmp_path / "dataset")).collect()]
