"""The chain of ``sections.run_tiles`` for tiles no larger than a block: a tile's pixels are arrays, all its steps one task.

What the relational steps find is found here by the same rules; tests hold one against the other.
Pixels beyond their tile's frame, or without a value in a band, are none.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corridor.config import CONFIG, pixels_of
from corridor.operators import kernels, sections
from corridor.operators.raster import BANDS, BLOCK

WHOLE = BLOCK * BLOCK  # pixels of the largest tile that is gone through as a whole


def pack(pixels: DataFrame) -> DataFrame:
    """(tile, n, byte, data): pieces of a tile, the columns of ``n`` pixels one after the other; a batch gives one for each tile in it."""
    px = pixels.select("tile", "prow", "pcol", *BANDS, F.coalesce("lane", F.lit(False)).alias("lane")).where(" AND ".join(f"{b} IS NOT NULL" for b in BANDS))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            tile = batch.column("tile").dictionary_encode()
            code = tile.indices.to_numpy()
            place = np.stack([batch.column(x).to_numpy() for x in ("prow", "pcol")]).astype("<i4")
            bands = np.stack([batch.column(x).to_numpy() for x in BANDS])
            lane = batch.column("lane").to_numpy(zero_copy_only=False).astype("u1")
            if (code[1:] < code[:-1]).any():
                order = np.argsort(code, kind="stable")
                code, place, bands, lane = code[order], place[:, order], bands[:, order], lane[order]
            byte = bands.dtype.kind in "iu" and bands.min() >= 0 and bands.max() <= 255
            bands = bands.astype("u1" if byte else "<f8")
            cuts = np.flatnonzero(np.diff(code)) + 1
            names, n, data = [], [], []
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(code)]):
                names.append(int(code[lo]))
                n.append(hi - lo)
                data.append(place[:, lo:hi].tobytes() + bands[:, lo:hi].tobytes() + lane[lo:hi].tobytes())
            yield pa.RecordBatch.from_arrays([tile.dictionary.take(pa.array(names)).cast(pa.string()), pa.array(n, pa.int32()), pa.array([byte] * len(n)), pa.array(data, pa.binary())], names=["tile", "n", "byte", "data"])

    return px.mapInArrow(run, "tile string, n int, byte boolean, data binary")


def unpack(pieces: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row and column, bands, lane) of a tile's pixels."""
    place, bands, lane = [np.zeros((2, 0), "<i4")], [np.zeros((len(BANDS), 0))], [np.zeros(0, bool)]
    for n, byte, data in zip(*(pieces.column(x).to_pylist() for x in ("n", "byte", "data"))):
        kind = np.dtype("u1" if byte else "<f8")
        at = 8 * n, 8 * n + len(BANDS) * kind.itemsize * n
        place.append(np.frombuffer(data, "<i4", 2 * n).reshape(2, n))
        bands.append(np.frombuffer(data, kind, len(BANDS) * n, at[0]).reshape(len(BANDS), n).astype(float))
        lane.append(np.frombuffer(data, "u1", n, at[1]).astype(bool))
    return np.concatenate(place, 1), np.concatenate(bands, 1), np.concatenate(lane)


def drawn(shape: tuple[int, int], streets: list[tuple], reach: float) -> np.ndarray:
    """Pixels whose centre is within ``reach`` of a street (x0, y0, x1, y1), in pixels; as ``spatial.covered``."""
    out = np.zeros(shape, bool)
    py, px = np.arange(shape[0])[:, None] + 0.5, np.arange(shape[1])[None] + 0.5
    for x0, y0, x1, y1 in streets:
        dx, dy = x1 - x0, y1 - y0
        square = dx * dx + dy * dy
        t = np.clip(((px - x0) * dx + (py - y0) * dy) / (square or 1.0), 0.0, 1.0)
        ax, ay = x0 + t * dx - px, y0 + t * dy - py
        out |= np.sqrt(ax * ax + ay * ay) <= reach
    return out


def otsu(values: np.ndarray, bins: int = 256) -> float:
    """As ``raster.otsu``, of one tile."""
    lo, hi = values.min(), values.max()
    lo, hi = (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi)
    n = np.bincount(np.minimum(bins - 1, np.floor((values - lo) / (hi - lo) * bins)).astype(int), minlength=bins)
    at = np.flatnonzero(n)
    centre = lo + (at + 0.5) * (hi - lo) / bins
    w, m = np.cumsum(n[at]), np.cumsum(n[at] * centre)
    rest = w[-1] - w
    below, above = m / w, np.where(rest > 0, (m[-1] - m) / np.where(rest > 0, rest, 1), 0.0)
    return float(centre[np.argmax(w * rest * (below - above) * (below - above))])


def shadow_of(bands: np.ndarray, known: np.ndarray, ground: np.ndarray, gsd: float, c) -> np.ndarray:
    """As ``raster.clean_mask`` of ``raster.shadow_mask``."""
    if not ground.any():
        return np.zeros_like(known)
    r, b = bands[0], bands[2]
    excess = (b - r) / (b + r + 1e-6)
    mask = ground & (excess >= otsu(excess[ground]))
    radius = max(1, round(c.shadow_closing_m / gsd))
    closed = kernels.close_disk(mask, radius)
    rows, cols = np.nonzero(known)
    inside = np.zeros_like(mask)
    inside[radius : max(rows.max() + 1 - radius, 0), radius : max(cols.max() + 1 - radius, 0)] = True
    label = kernels.label(closed & inside)
    size = np.bincount(label.ravel())
    size[0] = 0
    return (size >= int(np.ceil(c.min_shadow_m2 / gsd**2)))[label] & known & (label > 0)


def corrected(bands: np.ndarray, road: np.ndarray, shadow: np.ndarray, gsd: float, c) -> np.ndarray:
    """As ``raster.correct_shadows``."""
    sunny, shady = road & ~shadow, road & shadow
    more = np.zeros_like(bands)
    if sunny.any() and shady.any():
        half = pixels_of(c.shadow_window_m, gsd)
        d, row, col = kernels.near(sunny, shady)
        at = np.nonzero(shady)
        n_sun, n_shade = (kernels.box(x.astype(np.int64), half)[at] for x in (sunny, shady))
        depth = np.where(n_sun >= c.min_reference_density * (2 * half + 1) ** 2, np.minimum(1.0, d * gsd / c.feather_m), 0.0)
        for k, band in enumerate(bands):
            sun, shade = (kernels.box(np.where(x, band, 0.0), half)[at] for x in (sunny, shady))
            mean = np.where(n_sun > 0, sun / np.maximum(n_sun, 1), 0.0)
            shade = np.maximum(1.0, shade / n_shade)
            light = band[row, col] * (1 - depth) + mean * depth
            more[k][at] = np.maximum(0.0, np.minimum(light - shade, shade * (c.shadow_max_gain - 1)))
        reach = c.bleed_m / gsd
        d, row, col = kernels.near(shady, sunny, int(reach))
        share = 1 - d / reach
        ok = share > 0
        to = tuple(x[ok] for x in np.nonzero(sunny))
        more[:, to[0], to[1]] = more[:, row[ok], col[ok]] * share[ok]
    return np.trunc(np.clip(bands + more, 0.0, 255.0))


def at_border(known: np.ndarray, shadow: np.ndarray, gsd: float, c) -> np.ndarray:
    """Pixels within the margin of a shadow's border, on either side."""
    reach = int(c.shadow_edge_margin_m / gsd)
    out = np.zeros_like(known)
    for own, other in ((shadow, known & ~shadow), (known & ~shadow, shadow)):
        if own.any() and other.any():
            out[own] = kernels.near(other, own, reach)[0] * gsd <= c.shadow_edge_margin_m
    return out


def sampled(todo: list[dict], frame: dict, bands: np.ndarray, known: np.ndarray, flags: dict, c) -> tuple[np.ndarray, dict]:
    """(ends, samples) of sections, as ``sections.profile_points`` and ``sections.sample``."""
    h, w = frame["height"], frame["width"]
    start, step, ends, parts = -c.behind_road_m, c.sample_step_m, [0], []
    for s in todo:
        dist = start + np.arange(int(np.ceil((s["separation"] + c.beyond_lane_m + step - start) / step))) * step
        dx, dy = ((s[f"p{a}"] - s[f"road_{a}"]) / s["separation"] for a in "xy")
        rf, cf = (s["road_y"] + dist * dy - frame["y0"]) / frame["e"], (s["road_x"] + dist * dx - frame["x0"]) / frame["a"]
        r0, c0 = np.floor(rf), np.floor(cf)
        fr, fc = rf - r0, cf - c0
        place = lambda r, q: (np.clip(r, 0, h - 1).astype(int), np.clip(q, 0, w - 1).astype(int))
        total, some = np.zeros((len(BANDS), len(dist))), np.zeros(len(dist), bool)
        for r, q, weight in ((r0, c0, (1 - fr) * (1 - fc)), (r0, c0 + 1, (1 - fr) * fc), (r0 + 1, c0, fr * (1 - fc)), (r0 + 1, c0 + 1, fr * fc)):
            at = place(r, q)
            some |= known[at]
            total += np.where(known[at], weight * bands[:, at[0], at[1]], 0.0)
        at = place(np.rint(rf), np.rint(cf))
        some |= known[at]
        parts.append({"dist_m": dist[some]} | {b: total[k][some] for k, b in enumerate(BANDS)} | {f: (v[at] & known[at])[some] for f, v in flags.items()})
        ends.append(ends[-1] + int(some.sum()))
    return np.array(ends), {x: np.concatenate([p[x] for p in parts]) for x in parts[0]}


def one(pieces: pa.Table, frame: dict, gsd: float, branch: str, c) -> list[dict]:
    """The records of a tile's sections; ``frame`` has its affine and size, its streets and sections."""
    h, w = frame["height"], frame["width"]
    place, values, on_lane = unpack(pieces)
    inside = (place[0] >= 0) & (place[0] < h) & (place[1] >= 0) & (place[1] < w)
    at = place[0][inside], place[1][inside]
    bands, known, lane = np.zeros((len(BANDS), h, w)), np.zeros((h, w), bool), np.zeros((h, w), bool)
    bands[:, at[0], at[1]], known[at], lane[at] = values[:, inside], True, on_lane[inside]
    to_col, to_row = (lambda x: (x - frame["x0"]) / frame["a"]), (lambda y: (y - frame["y0"]) / frame["e"])
    streets = [(to_col(s["x0"]), to_row(s["y0"]), to_col(s["x1"]), to_row(s["y1"])) for s in frame["streets"] or ()]
    r, nir = bands[0], bands[3]
    road = drawn((h, w), streets, c.shadow_corridor_m / gsd) & known & ((nir - r) / (nir + r + 1e-6) < c.ndvi_vegetation)
    shadow = shadow_of(bands, known, road, gsd, c)
    fixed, border = corrected(bands, road, shadow, gsd, c), at_border(known, shadow, gsd, c)
    within = lambda x, y: (q := (int(to_row(y)), int(to_col(x)))) and (0 <= q[0] < h and 0 <= q[1] < w, q)
    todo, out = [], []
    for s in frame["sections"] or ():
        if s["separation"] is None:
            s["skip"] = "far"
        elif not within(s["road_x"], s["road_y"])[0]:
            s["skip"] = "off"
        else:
            ok, q = within(s["px"], s["py"]) if branch == "class" else within(s["road_x"], s["road_y"])
            s["skip"] = "shadow" if ok and border[q] else None
        (out if s["skip"] else todo).append(s)
    for lo in range(0, len(todo), sections.SECTIONS):
        part = todo[lo : lo + sections.SECTIONS]
        ends, samples = sampled(part, frame, fixed, known, {"shadow": shadow, "lane": lane}, c)
        some = np.diff(ends) > 0
        got = sections.records([s for s, ok in zip(part, some) if ok], np.concatenate([[0], ends[1:][some]]), samples, branch, c)
        out += got + [s for s, ok in zip(part, some) if not ok]
    for s in out:
        s["skip"] = s["skip"] or ("unresolved" if s.get("gap_m") is None else None)
        s["osm_separation_m"] = s["separation"]
    return out


def run_whole(pixels: DataFrame, found: DataFrame, streets: DataFrame, tiles: DataFrame, gsd: float, branch: str = "class", c=CONFIG) -> DataFrame:
    """The records of the sections ``found`` (``sections.sections_of``); a tile's pixels meet its frame, streets and sections once."""
    told = ["lane_id", "k", "offset_m", "px", "py", "road_x", "road_y", "separation", "highway", "road_width"]
    ways = streets.groupBy("tile").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("streets"))
    asked = found.groupBy("tile").agg(F.collect_list(F.struct(*told)).alias("sections"))
    frame = tiles.select("tile", *[F.col(x).cast("double").alias(x) for x in ("a", "e", "x0", "y0")], F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"))
    frame = frame.join(ways, "tile", "left").join(asked, "tile", "left")
    record = ["gap_m double", "composition string", "road_edge_m double", "lane_edge_m double", "shadow_fraction double", "reliable boolean", "n_runs int", "edges_m array<double>"]
    kinds = dict(found.dtypes)
    schema = ["tile string", *[f"{x} {kinds[x]}" for x in told[:7]], f"highway {kinds['highway']}", "osm_separation_m double", "skip string", *record]
    names = [x.split()[0] for x in schema]
    arrow = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}
    types = [arrow[x.split()[1]] for x in schema]

    # a group has about as many pixels as a block
    n, largest = tiles.agg(F.count(F.lit(1)), F.max(F.col("height").cast("long") * F.col("width"))).first()
    groups = -(-n // min(64, max(1, WHOLE // max(largest or 1, 1)))) or 1
    group = F.pmod(F.xxhash64("tile"), F.lit(groups)).alias("group")

    def run(pieces: pa.Table, frames: pa.Table) -> pa.Table:
        own = defaultdict(list)
        for k, tile in enumerate(pieces.column("tile").to_pylist()):
            own[tile].append(k)
        rows = [s | {"tile": f["tile"]} for f in frames.to_pylist() for s in one(pieces.take(pa.array(own[f["tile"]], pa.int64())), f, gsd, branch, c)]
        return pa.Table.from_arrays([pa.array([r.get(x) for r in rows], t) for x, t in zip(names, types)], names=names)

    left, right = pack(pixels).select("*", group), frame.select("*", group)
    return left.groupBy("group").cogroup(right.groupBy("group")).applyInArrow(run, ", ".join(schema))
