"""Training chips from an annotation export."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corridor.config import CONFIG
from corridor.operators import kernels


def parse(lines: DataFrame) -> DataFrame:
    """(stem, line_no, class_id, xy): blank lines and those with fewer than three points go."""
    rows = lines.where(F.trim("line") != "").withColumn("parts", F.split(F.trim("line"), r"\s+"))
    values = F.transform(F.slice("parts", F.lit(2), F.greatest(F.lit(0), F.size("parts") - 1)), lambda x: x.cast("double"))
    rows = rows.select("stem", "line_no", F.col("parts")[0].cast("int").alias("class_id"), values.alias("v")).where(F.size("v") >= 6)
    xy = F.transform(F.sequence(F.lit(0), F.floor(F.size("v") / 2).cast("int") - 1), lambda k: F.struct(F.get("v", 2 * k).alias("x"), F.get("v", 2 * k + 1).alias("y")))
    return rows.select("stem", "line_no", "class_id", xy.alias("xy"))


def denormalise(rows: DataFrame, width: int, height: int) -> DataFrame:
    return rows.withColumn("xy", F.transform("xy", lambda p: F.struct((p["x"] * width).alias("x"), (p["y"] * height).alias("y"))))


def chips(tiles: DataFrame, size: int = CONFIG.chip_px, overlap: int = CONFIG.chip_overlap_px) -> DataFrame:
    """(stem, chip, x0, y0, w, h) of a (stem, width, height) relation: chips at the edges are smaller."""
    step = size - overlap
    origins = lambda n: F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / step).cast("int")), lambda k: k * step))
    rows = tiles.withColumn("x0", origins("width")).withColumn("y0", origins("height"))
    name = F.format_string("%s_%d_%d", "stem", "x0", "y0")
    return rows.select("stem", name.alias("chip"), "x0", "y0", F.least(F.lit(size), F.col("width") - F.col("x0")).alias("w"), F.least(F.lit(size), F.col("height") - F.col("y0")).alias("h"))


def by_chip(instances: DataFrame, chips_: DataFrame, size: int = CONFIG.chip_px) -> DataFrame:
    """Instances with the chips that their boxes touch: an equi-join on cells of a chip's size within a tile."""
    low = lambda a: F.array_min(F.transform("xy", lambda p: p[a]))
    high = lambda a: F.array_max(F.transform("xy", lambda p: p[a]))
    i = instances.withColumns({"bx0": low("x"), "by0": low("y"), "bx1": high("x"), "by1": high("y")})
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size).cast("int") - 1, F.floor(F.col(b) / size).cast("int")))
    i = i.withColumn("gx", span("bx0", "bx1")).withColumn("gy", span("by0", "by1"))
    # a chip reaches at most one cell beyond the cell of its corner
    c = chips_.withColumns({"gx": F.floor(F.col("x0") / size).cast("int"), "gy": F.floor(F.col("y0") / size).cast("int")})
    rows = i.join(c, ["stem", "gx", "gy"]).drop("gx", "gy")
    return rows.where("bx1 > x0 AND bx0 < x0 + w AND by1 > y0 AND by0 < y0 + h")


def clip(rows: DataFrame) -> DataFrame:
    """(stem, chip, line_no, class_id, area, label): each piece of an instance that lies in a chip, as a line of the chip's label file.

    A piece's ring ends with its first point.
    """

    def run(batches):
        for pdf in batches:
            out = []
            for x in pdf.itertuples(index=False):
                ring = np.array([(p["x"], p["y"]) for p in x.xy])
                for piece in kernels.pieces_in_box(ring, (x.x0, x.y0, x.x0 + x.w, x.y0 + x.h)):
                    area = kernels.ring_area(piece)
                    if area > 0:
                        text = " ".join(f"{v:.6f}" for px, py in [*piece, piece[0]] for v in ((px - x.x0) / x.w, (py - x.y0) / x.h))
                        out.append((x.stem, x.chip, x.line_no, x.class_id, area, f"{x.class_id} {text}"))
            yield pd.DataFrame(out, columns=["stem", "chip", "line_no", "class_id", "area", "label"])

    return rows.select("stem", "chip", "line_no", "class_id", "xy", "x0", "y0", "w", "h").mapInPandas(run, "stem string, chip string, line_no long, class_id int, area double, label string")


def split(chips_: DataFrame, fraction: float = CONFIG.val_fraction) -> DataFrame:
    """(chip, split): by name, the last share (half-even, at least one, never all) is for validation.

    Names are dealt out by ranges and ranked within a range, offset by the ranges before: no task orders all chips.
    """
    from corridor.sources import store

    names = chips_.select("chip").distinct()
    names = store.materialise(names.repartitionByRange("chip").withColumn("range", F.spark_partition_id()), "names")
    sizes = names.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    # one row for each range: the only windows without a partition
    upto = Window.orderBy("range")
    sizes = sizes.select("range", (F.sum("n").over(upto) - F.col("n")).alias("before"), F.sum("n").over(upto.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    rank = F.row_number().over(Window.partitionBy("range").orderBy("chip")) + F.col("before")
    n_val = F.when(F.col("total") > 1, F.least(F.greatest(F.lit(1), F.bround(F.col("total") * fraction)), F.col("total") - 1)).otherwise(0)
    return names.join(store.small(sizes), "range").select("chip", F.when(rank > F.col("total") - n_val, "val").otherwise("train").alias("split"))


def with_tiles(instances: DataFrame, tiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(instances whose tile is there, stems without a tile)."""
    return instances.join(tiles.select("stem"), "stem", "left_semi"), instances.select("stem").distinct().join(tiles.select("stem"), "stem", "left_anti")


def merged_names(exports: DataFrame) -> DataFrame:
    """(class_id, name) of several exports (export, class_id, name): the last export that names a class counts."""
    return exports.groupBy("class_id").agg(F.max_by("name", "export").alias("name"))


def yaml(names: DataFrame) -> str:
    """The description of a dataset; its classes are a handful of rows."""
    rows = names.orderBy("class_id").collect()
    return "\n".join(["path: .", "train: split=train", "val: split=val", "names:", *[f"  {r['class_id']}: {r['name']}" for r in rows], ""])


def image_chips(images: DataFrame, chips_: DataFrame, size: int = CONFIG.chip_px) -> DataFrame:
    """(split, chip, w, h, rgb): the pixels of each chip (stem, chip, x0, y0, w, h, split), as many bytes as three times its area.

    Pixels meet chips by cells of a chip's size.
    """
    c = chips_.withColumn("gx", F.explode(F.sequence(F.floor(F.col("x0") / size).cast("int"), F.floor((F.col("x0") + F.col("w") - 1) / size).cast("int"))))
    c = c.withColumn("gy", F.explode(F.sequence(F.floor(F.col("y0") / size).cast("int"), F.floor((F.col("y0") + F.col("h") - 1) / size).cast("int"))))
    px = images.withColumns({"gx": F.floor(F.col("pcol") / size).cast("int"), "gy": F.floor(F.col("prow") / size).cast("int")})
    rows = px.join(c, ["stem", "gx", "gy"]).where("pcol >= x0 AND pcol < x0 + w AND prow >= y0 AND prow < y0 + h")
    rows = rows.select("split", "chip", "w", "h", ((F.col("prow") - F.col("y0")) * F.col("w") + F.col("pcol") - F.col("x0")).cast("int").alias("at"), "r", "g", "b")

    def run(t: pa.Table) -> pa.Table:
        first = {k: t.column(k)[0].as_py() for k in ("split", "chip", "w", "h")}
        rgb = np.zeros((first["w"] * first["h"], 3), np.uint8)
        at = t.column("at").to_numpy()
        for k, band in enumerate("rgb"):
            rgb[at, k] = t.column(band).to_numpy()
        return pa.table([pa.array([first["split"]]), pa.array([first["chip"]]), pa.array([first["w"]], pa.int32()), pa.array([first["h"]], pa.int32()), pa.array([rgb.tobytes()], pa.binary())], names=["split", "chip", "w", "h", "rgb"])

    return rows.groupBy("chip").applyInArrow(run, "split string, chip string, w int, h int, rgb binary")


def export(lines: DataFrame, names: DataFrame, tiles: DataFrame, path: str, size: int = CONFIG.chip_px, overlap: int = CONFIG.chip_overlap_px, images: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Writes label files by split and chip, image chips by split, and the description; (chips with their split and number of instances, stems without a tile).

    Only chips that hold an instance are written and split.  ``images`` has stem, prow, pcol, r, g, b: a chip is one row
    with its size and its pixels' bytes, row by row, three to a pixel.
    """
    from corridor.operators import report
    from corridor.sources import store

    instances, missing = with_tiles(parse(lines), tiles)
    placed = instances.join(tiles, "stem")
    placed = placed.withColumn("xy", F.transform("xy", lambda p: F.struct((p["x"] * F.col("width")).alias("x"), (p["y"] * F.col("height")).alias("y")))).drop("width", "height")
    grid = chips(tiles, size, overlap)
    labels = store.materialise(clip(by_chip(placed, grid, size)), "labels")
    parts = store.materialise(split(labels.select("stem", "chip")), "split")
    store.save_chips(labels, parts, f"{path}/labels")
    if images is not None:
        image_chips(images, grid.join(parts, "chip"), size).write.mode("overwrite").partitionBy("split").parquet(f"{path}/images")
    report.save(yaml(names), lines.sparkSession, f"{path}/dataset")
    return labels.groupBy("chip").agg(F.count(F.lit(1)).alias("n")).join(parts, "chip"), missing
