"""Hopping windows over a tile, their scores, and the masks they make."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corridor.functions import color
from corridor.sources.store import large, materialise, small


def windows(pixels: DataFrame, size: int, stride: int) -> DataFrame:
    """(tile, win_row, win_col) of the windows wholly inside a tile that hold a non-zero pixel.

    Each bright pixel names the windows it lies in; the tile's bounds, one row
    for each tile, cut off those that reach outside.
    """
    bounds = pixels.groupBy("tile").agg((F.max("prow") + 1).alias("h"), (F.max("pcol") + 1).alias("w"))

    def starts(x: str):
        c = F.col(x)
        first = F.greatest(F.lit(0), F.ceil((c - size + 1) / stride)).cast("int")
        return F.transform(F.sequence(first, F.floor(c / stride).cast("int")), lambda k: k * stride)

    # a pixel lies in ever the same few windows: rows of one grid cell are put together before they are exploded
    lit = pixels.where("greatest(r, g, b) > 0").select("tile", starts("prow").alias("rows"), starts("pcol").alias("cols")).distinct()
    out = lit.select("tile", F.explode("rows").alias("win_row"), "cols").distinct().select("tile", "win_row", F.explode("cols").alias("win_col")).distinct()
    return out.join(small(bounds), "tile").where(f"win_row + {size} <= h and win_col + {size} <= w").select("tile", F.col("win_row").cast("int"), F.col("win_col").cast("int"))


def paint(windows_: DataFrame, size: int) -> DataFrame:
    """The pixels of each window."""
    span = lambda c: F.explode(F.sequence(F.col(c), F.col(c) + (size - 1)))
    return windows_.withColumn("prow", span("win_row")).withColumn("pcol", span("win_col"))


def score_map(scored: DataFrame, size: int) -> DataFrame:
    """Each covered pixel's mean score over the windows that cover it."""
    return paint(scored, size).groupBy("tile", "prow", "pcol").agg(F.avg("score").alias("score"))


def detect(scored: DataFrame, size: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(mean score of a tile's hits, the pixels of all its hits); a hit beats the threshold."""
    hits = scored.where(F.col("score") > threshold)
    return hits.groupBy("tile").agg(F.avg("score").alias("score")), paint(hits, size).select("tile", "prow", "pcol").distinct()


def view(pixels: DataFrame, scored: DataFrame, size: int, threshold: float) -> DataFrame:
    """A scan as its panels show it: per pixel the image, the mean score and its heat (null where nothing was scanned), and the image with hits in green.

    The scores are made once; both panels come from them.
    """
    scores = materialise(scored, "scores")
    heat = score_map(scores, size)
    _, hits = detect(scores, size, threshold)
    key = ["tile", "prow", "pcol"]
    rows = pixels.join(large(heat), key, "left").join(large(hits.withColumn("hit", F.lit(True))), key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    green = [F.when(F.col("hit"), color.blend(F.col(b), v, 0.5)).otherwise(F.col(b)).cast("int").alias(f"{b}_shown") for b, v in (("r", 0.0), ("g", 255.0), ("b", 0.0))]
    return rows.select(*key, "r", "g", "b", "score", color.heat(F.col("score")).alias("heat"), "hit", *green)
