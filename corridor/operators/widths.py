"""Road widths: rays to both sides of a way until the surface ends."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corridor.config import CONFIG
from corridor.functions import geometry as G
from corridor.operators import spatial

RAY = "way_id long, k int, side int, extent_m double, limited boolean, unbounded boolean"


def walk(inside: np.ndarray, hit: np.ndarray, step_m: float, tolerance_m: float) -> tuple[float, bool, bool]:
    """(distance of the last hit, left the frame, met no end) along samples of a ray, the first at its start.

    Gaps up to the tolerance are passed over.
    """
    last, missed = 0.0, 0
    for k in range(len(hit)):
        if not inside[k]:
            return last, True, False
        if hit[k]:
            last, missed = k * step_m, 0
        else:
            missed += 1
            if missed > int(tolerance_m / step_m):
                return last, False, False
    return last, False, True


def rays(ways: DataFrame, surface: DataFrame, affine: tuple[float, float, float, float], height: int, width: int, c=CONFIG) -> DataFrame:
    """(way_id, k, side, extent_m, limited, unbounded) for both sides of points along two-point ways."""
    a, e, x0, y0 = affine
    step = c.ray_step_px * a
    points = spatial.samples(ways, c.width_interval_m)
    tx, ty = spatial.tangent()
    points = points.select("way_id", "k", "px", "py", (-ty).alias("nx"), tx.alias("ny"))
    rows = points.withColumn("side", F.explode(F.array(F.lit(-1), F.lit(1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(int(c.max_half_width_m / step)))))
    row, col = G.to_pixel(F.col("px") + F.col("side") * F.col("j") * step * F.col("nx"), F.col("py") + F.col("side") * F.col("j") * step * F.col("ny"), *affine)
    rows = rows.select("way_id", "k", "side", "j", G.truncate(row).alias("prow"), G.truncate(col).alias("pcol"))
    rows = rows.withColumn("inside", (F.col("prow") >= 0) & (F.col("prow") < height) & (F.col("pcol") >= 0) & (F.col("pcol") < width))
    rows = rows.join(surface.select("prow", "pcol").distinct().withColumn("hit", F.lit(True)), ["prow", "pcol"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (k, side), ray in pdf.sort_values("j").groupby(["k", "side"]):
            extent, limited, unbounded = walk(ray.inside.to_numpy(bool), ray.hit.to_numpy(bool), step, c.gap_tolerance_m)
            if bool(ray.hit.iloc[0]):  # a point off the surface has no width
                out.append((pdf.way_id.iloc[0], k, side, extent, limited, unbounded))
        return pd.DataFrame(out, columns=["way_id", "k", "side", "extent_m", "limited", "unbounded"])

    return rows.groupBy("way_id", F.floor(F.col("k") / 64).alias("part")).applyInPandas(run, RAY)


def samples(rays_: DataFrame, gsd: float) -> DataFrame:
    """(way_id, k, width_m, buffer_limited, unbounded): both sides put together."""
    rows = rays_.groupBy("way_id", "k").agg(F.sum("extent_m").alias("w"), F.count(F.lit(1)).alias("n"), F.bool_or("limited").alias("buffer_limited"), F.bool_or("unbounded").alias("unbounded"))
    return rows.where("n = 2").select("way_id", "k", (F.col("w") + gsd).alias("width_m"), "buffer_limited", "unbounded")
