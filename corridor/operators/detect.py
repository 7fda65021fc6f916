"""Detectors of lanes and road surface: coarse texture hits, traced to edges, turned into centre lines."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corridor.config import CONFIG, pixels_of, pixels_of_area
from corridor.functions import color
from corridor.functions import geometry as G
from corridor.operators import centerline, embed, kernels, measure, raster, scan, spatial, widths
from corridor.sources.store import materialise

KEY = ["tile", "prow", "pcol"]
Embedder = Callable[[DataFrame, int, int], DataFrame]  # (pixels, size, stride) -> tile, win_row, win_col, embedding


def resize(image: np.ndarray, size: int = 256) -> np.ndarray:
    """(height, width, band) of 8 bits, bilinear to a square and scaled to one, as networks take it."""
    h, w = image.shape[:2]
    at = lambda n: np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
    r, c = at(h), at(w)
    r0, c0 = np.floor(r).astype(int), np.floor(c).astype(int)
    r1, c1 = np.minimum(r0 + 1, h - 1), np.minimum(c0 + 1, w - 1)
    fr, fc = (r - r0)[:, None, None], (c - c0)[None, :, None]
    x = image.astype(float)
    top = x[r0][:, c0] * (1 - fc) + x[r0][:, c1] * fc
    low = x[r1][:, c0] * (1 - fc) + x[r1][:, c1] * fc
    return (top * (1 - fr) + low * fr) / 255.0


def model_embedder(load: Callable[[], Callable[[np.ndarray], np.ndarray]], dim: int, batch: int = 64) -> Embedder:
    """An embedder that runs a model on each window's image; ``load`` is called once by a worker.

    The model gets (n, 256, 256, 3) and gives (n, dim).
    """

    def run(pixels: DataFrame, size: int, stride: int) -> DataFrame:
        covered = scan.paint(scan.windows(pixels, size, stride), size).join(pixels.select(*KEY, "r", "g", "b"), KEY)
        px = F.array_sort(F.collect_list(F.struct("prow", "pcol", "r", "g", "b")))
        rows = covered.groupBy("tile", "win_row", "win_col").agg(px.alias("px")).select("tile", "win_row", "win_col", F.transform("px", lambda p: F.array(p["r"], p["g"], p["b"])).alias("px"))

        def apply(batches):
            model = load()
            for pdf in batches:
                for lo in range(0, len(pdf), batch):
                    part = pdf.iloc[lo : lo + batch]
                    images = np.stack([resize(np.array([list(v) for v in p], np.uint8).reshape(size, size, 3)) for p in part.px])
                    out = part[["tile", "win_row", "win_col"]].copy()
                    out["embedding"] = [np.asarray(v, float)[:dim].tolist() for v in model(images)]
                    yield out

        return rows.mapInPandas(apply, "tile string, win_row int, win_col int, embedding array<double>")

    return run


@dataclass(frozen=True)
class TextureDetector:
    """Windows that look more like the positive class than like the negatives."""

    positive: str
    negatives: tuple[str, ...]
    threshold: float
    size: int
    stride: int
    embedder: Embedder = embed.descriptor

    def scores(self, pixels: DataFrame, references: DataFrame) -> DataFrame:
        line = embed.direction(references, self.positive, list(self.negatives))
        return embed.score(self.embedder(pixels, self.size, self.stride), line).select("tile", "win_row", "win_col", "score")

    def predict(self, pixels: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(each tile's label and mean score of hits, the mask of all hits)."""
        hits, mask = scan.detect(self.scores(pixels, references), self.size, self.threshold)
        return hits.withColumn("label", F.lit(self.positive)), mask


def lane_detector(size: int, stride: int, **more) -> TextureDetector:
    return TextureDetector("bikelane", ("negative",), CONFIG.lane_score, size, stride, **more)


def road_detector(size: int, stride: int, **more) -> TextureDetector:
    return TextureDetector("road", ("bikelane", "negative"), CONFIG.road_score, size, stride, **more)


def paint(pixels: DataFrame) -> DataFrame:
    """The pixels with red paint.  Hue and saturation stay columns of their own, so that they are computed once."""
    rows = pixels.select(*KEY, "r", "g", "b").select(*KEY, *[v.alias(k) for k, v in color.hsv().items()])
    return rows.where(color.is_paint(F.col("h"), F.col("s"), F.lit(True))).select(*KEY)


def traced(surface: DataFrame, coarse: DataFrame, gsd: float, least: int, c=CONFIG) -> DataFrame:
    """(tile, prow, pcol, comp): surface pixels in the widened coarse mask, closed, in parts of more than ``least`` pixels."""
    bridge = max(0, round(c.coarse_bridge_m / gsd))
    roi, radius = pixels_of(c.coarse_reach_m, gsd), pixels_of(c.surface_closing_m, gsd)

    def widen(g):
        wide = kernels.dilate(np.pad(kernels.connect(g["known"], bridge, c.bridge_orientations), roi), kernels.diamond(roi))[roi:-roi, roi:-roi]
        return {"fill": wide, "inside": wide}

    # halo: a bridge's length and the widening; pixels beyond the coarse mask's box come by the dilation below
    joined = raster.apply_blocks(coarse.select(*KEY), [], widen, "inside boolean", bridge + roi).select(*KEY)
    wide = raster.dilation(joined, kernels.diamond(roi)) if bridge < 3 else joined
    kept = surface.select(*KEY).join(wide, KEY, "left_semi")

    def closed(g):
        out = kernels.close(g["known"], kernels.disk(radius), outside=True)
        return {"fill": out, "inside": out}

    mask = raster.apply_blocks(kept, [], closed, "inside boolean", 2 * radius).select(*KEY)
    return raster.at_least(raster.components(materialise(mask, "traced")), least, strict=True)


def lane_bands(pixels: DataFrame, coarse: DataFrame, gsd: float, c=CONFIG) -> DataFrame:
    """Lanes as bands of constant width, with bridges between those that face each other: (tile, prow, pcol, comp)."""
    parts = traced(materialise(paint(pixels), "paint"), coarse, gsd, pixels_of_area(c.min_lane_part_m2, gsd), c)
    width = float(pixels_of(c.slice_m, gsd))
    key = F.concat_ws("#", "tile", F.col("comp").cast("string"))
    named = materialise(parts.withColumn("seg", key), "parts")
    bands = materialise(centerline.regularised(named, width, c, "seg"), "bands")
    line = centerline.binned(named, width, c.min_centerline_bins, "seg").groupBy("seg").agg(F.array_sort(F.collect_list(F.struct("bin", "row", "col"))).alias("p"))
    radius = bands.groupBy("seg").agg(F.first("radius").alias("radius"))
    segs = line.join(radius, "seg").select("seg", F.xxhash64("seg").alias("seg_id"), "radius", F.transform("p", lambda x: F.struct(x["row"].alias("row"), x["col"].alias("col"))).alias("points"))
    segs = materialise(segs, "segments")
    tile = segs.select("seg_id", F.split("seg", "#")[0].alias("tile"))
    joints = centerline.bridge_pixels(centerline.bridges(segs, c)).join(tile, F.col("a") == F.col("seg_id")).select(*KEY)
    everything = bands.select(F.split("seg", "#")[0].alias("tile"), "prow", "pcol").unionByName(joints).distinct()
    return raster.components(materialise(everything.where("prow >= 0 AND pcol >= 0"), "bands"))


def road_surface(pixels: DataFrame, coarse: DataFrame, shadow: DataFrame | None, gsd: float, c=CONFIG) -> DataFrame:
    """The road's parts: the coarse mask's widened area less the shadows and their margin, without small parts."""
    if shadow is not None:
        near = raster.dilation(shadow, kernels.diamond(pixels_of(c.shadow_exclusion_m, gsd)))
        coarse = coarse.join(near, KEY, "left_anti")
    return traced(pixels, coarse, gsd, pixels_of_area(c.min_road_part_m2, gsd), c)


def centerlines(mask: DataFrame, affine: tuple[float, float, float, float], gsd: float, least: int, c=CONFIG) -> DataFrame:
    """(tile, lane_id, seq, x, y) of a lane mask's components with enough pixels, at the pixels' corners.

    Component numbers repeat from tile to tile: a lane is one of a tile.
    """
    parts = raster.at_least(raster.components(mask), least).withColumn("part", F.struct("tile", "comp"))
    line = centerline.binned(parts, float(pixels_of(c.slice_m, gsd)), c.min_centerline_bins, "part")
    x, y = G.to_world(F.col("row"), F.col("col"), *affine)
    return line.select("part.tile", F.concat_ws("/", "part.tile", F.col("part.comp").cast("string")).alias("lane_id"), F.col("bin").alias("seq"), x.alias("x"), y.alias("y"))


def as_segments(points: DataFrame) -> DataFrame:
    """Two-point lines between a centre line's neighbouring points: lane_id is ``line:seq``."""
    from pyspark.sql import Window

    w = Window.partitionBy("lane_id").orderBy("seq")
    rows = points.withColumns({"x1": F.lead("x").over(w), "y1": F.lead("y").over(w)}).where("x1 IS NOT NULL")
    return rows.select(F.concat_ws(":", "lane_id", "seq").alias("lane_id"), F.col("x").alias("x0"), F.col("y").alias("y0"), "x1", "y1")


def detect_roads(surface: DataFrame, ways: DataFrame, affine: tuple[float, float, float, float], height: int, width: int, gsd: float, c=CONFIG) -> tuple[DataFrame, DataFrame]:
    """(widths of the ways on a surface, those with most samples first; a row with the surface's area)."""
    rays = materialise(widths.rays(ways, surface, affine, height, width, c), "rays")
    rows = measure.way_widths(widths.samples(rays, gsd), c.min_samples_per_way).orderBy(F.desc("n_samples"), "way_id")
    area = surface.agg((F.count(F.lit(1)) * gsd**2).alias("area_m2"))
    return rows, area


def class_surface(pixels: DataFrame, streets: DataFrame, affine: tuple[float, float, float, float]) -> DataFrame:
    """The surface as wide as each street's class, where no detector is used."""
    from corridor.functions import labels

    a = affine[0]
    to_px = {f"{n}{k}": G.to_pixel(F.col(f"x{k}"), F.col(f"y{k}"), *affine)[1 if n == "x" else 0] for k in (0, 1) for n in ("x", "y")}
    drawn = streets.withColumn("reach", labels.road_width() / 2 / a).withColumns(to_px)
    return spatial.covered(pixels, drawn, "reach", 6.0 / a)


def part_sizes(parts: DataFrame) -> DataFrame:
    """Parts by pixels, the largest first."""
    return raster.sizes(parts).orderBy(F.desc("size"), "comp")


def pandas_detector(predict: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> Callable[[DataFrame], DataFrame]:
    """An own detector: a function from a tile's block of pixels to rows, run on blocks."""

    def run(pixels: DataFrame) -> DataFrame:
        return raster.with_halo(pixels, 0).groupBy("tile", "brow", "bcol").applyInPandas(predict, schema)

    return run
