"""Neighbourhood operators on a pixel relation (tile, prow, pcol, ...).

A tile is cut into blocks of ``BLOCK`` pixels a side.  Every pixel goes to its
own block and, as halo, to the blocks it is near enough to influence, so a
kernel sees all it needs and no task gets a whole tile.  What a kernel finds is
kept for the block's own pixels alone.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corridor.config import CONFIG, pixels_of
from corridor.operators import kernels
from corridor.sources.store import large, materialise, small

BLOCK = 512


def with_halo(pixels: DataFrame, halo: int, block: int = BLOCK) -> DataFrame:
    """The pixels with (brow, bcol) of every block they belong to or border within ``halo``."""

    def spans(x: str):
        c = F.col(x)
        return F.sequence(F.floor((c - halo) / block).cast("int"), F.floor((c + halo) / block).cast("int"))

    if halo == 0:
        return pixels.withColumns({"brow": F.floor(F.col("prow") / block).cast("int"), "bcol": F.floor(F.col("pcol") / block).cast("int")})
    return pixels.withColumn("brow", F.explode(spans("prow"))).withColumn("bcol", F.explode(spans("pcol")))


def _grid(pdf: pd.DataFrame) -> tuple[int, int, tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    r0, c0 = int(pdf.prow.min()), int(pdf.pcol.min())
    shape = (int(pdf.prow.max()) - r0 + 1, int(pdf.pcol.max()) - c0 + 1)
    return r0, c0, shape, (pdf.prow.to_numpy() - r0, pdf.pcol.to_numpy() - c0)


def apply_blocks(pixels: DataFrame, columns: list[str], kernel: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], schema: str, halo: int, block: int = BLOCK) -> DataFrame:
    """``kernel`` gets arrays of the columns and ``known`` (a pixel is there); its arrays become columns.

    Rows come back for a block's known pixels, or, with ``fill`` in its result, for all of fill's true ones.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        brow, bcol = int(pdf.brow.iloc[0]), int(pdf.bcol.iloc[0])
        r0, c0, shape, at = _grid(pdf)
        grids = {}
        for c in columns:
            v = pdf[c].to_numpy()
            grids[c] = np.zeros(shape, v.dtype if v.dtype != object else bool)
            grids[c][at] = v
        known = np.zeros(shape, bool)
        known[at] = True
        found = kernel(grids | {"known": known})
        r, c = np.nonzero(found.pop("fill", known))
        own = ((r + r0) // block == brow) & ((c + c0) // block == bcol)
        r, c = r[own], c[own]
        out = {"tile": np.full(len(r), pdf.tile.iloc[0], object), "prow": (r + r0).astype(np.int32), "pcol": (c + c0).astype(np.int32)}
        return pd.DataFrame(out | {k: v[r, c] for k, v in found.items()})

    wide = with_halo(pixels.select("tile", "prow", "pcol", *columns), halo, block)
    return wide.groupBy("tile", "brow", "bcol").applyInPandas(run, f"tile string, prow int, pcol int, {schema}")


def closing(mask: DataFrame, radius: int, frame: DataFrame, block: int = BLOCK) -> DataFrame:
    """Closing of a set of pixels by a disc, false outside the frame (tile, height, width).

    What lies nearer to the frame's border than the disc reaches is lost, as the disc
    meets the outside there.
    """

    def kernel(g):
        closed = kernels.close(np.pad(g["known"], 2 * radius), kernels.disk(radius))[2 * radius : -2 * radius, 2 * radius : -2 * radius]
        return {"fill": closed, "inside": closed}

    # a closed pixel lies within the radius of the mask, and what decides on it within twice that
    out = apply_blocks(mask.select("tile", "prow", "pcol"), [], kernel, "inside boolean", 2 * radius, block)
    r = radius
    return out.join(small(frame), "tile").where(f"prow >= {r} AND pcol >= {r} AND prow < height - {r} AND pcol < width - {r}").select("tile", "prow", "pcol")


def frame(pixels: DataFrame) -> DataFrame:
    """(tile, height, width), one row for each tile."""
    return pixels.groupBy("tile").agg((F.max("prow") + 1).alias("height"), (F.max("pcol") + 1).alias("width"))


def dilation(mask: DataFrame, offsets: np.ndarray) -> DataFrame:
    """The set of pixels at any of a few offsets, as a join-free explode: map-side, then one distinct."""
    steps = F.array(*[F.struct(F.lit(int(r)).alias("r"), F.lit(int(c)).alias("c")) for r, c in offsets])
    moved = mask.select("tile", "prow", "pcol", F.explode(steps).alias("o"))
    return moved.select("tile", (F.col("prow") + F.col("o.r")).cast("int").alias("prow"), (F.col("pcol") + F.col("o.c")).cast("int").alias("pcol")).distinct()


def erosion(mask: DataFrame, offsets: np.ndarray) -> DataFrame:
    """The pixels all of whose offsets are in the set: each pixel votes for those that need it."""
    steps = F.array(*[F.struct(F.lit(int(r)).alias("r"), F.lit(int(c)).alias("c")) for r, c in offsets])
    moved = mask.select("tile", "prow", "pcol").distinct().select("tile", "prow", "pcol", F.explode(steps).alias("o"))
    votes = moved.select("tile", (F.col("prow") - F.col("o.r")).cast("int").alias("prow"), (F.col("pcol") - F.col("o.c")).cast("int").alias("pcol"))
    return votes.groupBy("tile", "prow", "pcol").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(offsets)).drop("n")


def distance(mask: DataFrame, pixels: DataFrame, reach: int, block: int = BLOCK) -> DataFrame:
    """(tile, prow, pcol, distance, near_row, near_col) of each pixel's nearest mask pixel within ``reach``, null beyond."""
    both = pixels.select("tile", "prow", "pcol", F.lit(False).alias("m")).unionByName(mask.select("tile", "prow", "pcol", F.lit(True).alias("m")))
    both = both.groupBy("tile", "prow", "pcol").agg(F.max("m").alias("m"), F.max(~F.col("m")).alias("asked"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        brow, bcol = int(pdf.brow.iloc[0]), int(pdf.bcol.iloc[0])
        r0, c0, shape, at = _grid(pdf)
        m = np.zeros(shape, bool)
        m[at] = pdf.m.to_numpy()
        d, r, c = kernels.edt(m)
        own = pdf[pdf.asked & (pdf.prow // block == brow) & (pdf.pcol // block == bcol)]
        i = (own.prow.to_numpy() - r0, own.pcol.to_numpy() - c0)
        ok = d[i] <= reach
        null = lambda v: pd.array(np.where(ok, v, 0), dtype="Int32").copy()
        rows, cols = null(r[i] + r0), null(c[i] + c0)
        rows[~ok], cols[~ok] = pd.NA, pd.NA
        return pd.DataFrame({"tile": own.tile, "prow": own.prow, "pcol": own.pcol, "distance": np.where(ok, d[i], np.nan), "near_row": rows, "near_col": cols})

    out = with_halo(both, reach, block).groupBy("tile", "brow", "bcol").applyInPandas(run, "tile string, prow int, pcol int, distance double, near_row int, near_col int")
    return out.withColumn("distance", F.nanvl("distance", F.lit(None).cast("double")))


def nearest(mask: DataFrame, pixels: DataFrame, strip: int = 64) -> DataFrame:
    """(tile, prow, pcol, distance, near_row, near_col) of each pixel's nearest mask pixel, however far; null in a tile without one.

    Of equally near ones the upper, then the left.  A task gets a strip of columns with
    the mask pixels inside it and, for every row, the last one to its left and the first
    to its right, which is all that can be nearest along that row.
    """
    from pyspark.sql import Window

    part = F.floor(F.col("pcol") / strip).cast("int")
    asked = pixels.select("tile", "prow", "pcol").distinct().withColumn("strip", part)
    own = mask.select("tile", "prow", "pcol").distinct().withColumn("strip", part)
    wanted = asked.groupBy("tile").agg(F.min("strip").alias("lo"), F.max("strip").alias("hi"))
    cells = own.groupBy("tile", "prow", "strip").agg(F.sort_array(F.collect_list("pcol")).alias("cols"))
    every = F.explode(F.sequence("lo", "hi")).alias("strip")
    slots = cells.unionByName(cells.select("tile", "prow").distinct().join(wanted, "tile").select("tile", "prow", every), allowMissingColumns=True)
    slots = slots.groupBy("tile", "prow", "strip").agg(F.max("cols").alias("cols"))
    row = Window.partitionBy("tile", "prow").orderBy("strip")
    before = F.last(F.array_max("cols"), ignorenulls=True).over(row.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(F.array_min("cols"), ignorenulls=True).over(row.rowsBetween(1, Window.unboundedFollowing))
    known = slots.select("tile", "strip", "prow", F.flatten(F.array_compact(F.array("cols", F.array_compact(F.array(before, after))))).alias("cols"))
    rows = asked.select("tile", "strip", "prow", F.array("pcol").alias("cols"), F.lit(True).alias("asked")).unionByName(known.join(wanted, "tile").where("strip BETWEEN lo AND hi").select("tile", "strip", "prow", "cols", F.lit(False).alias("asked")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q, k = pdf[pdf.asked], pdf[~pdf.asked]
        r, c = q.prow.to_numpy(), np.array([x[0] for x in q.cols], int)
        d, nr, nc = kernels.nearest(r, c, {int(a): np.sort(np.asarray(b)) for a, b in zip(k.prow, k.cols)})
        some = np.isfinite(d)
        null = lambda v: pd.array(np.where(some, v, 0), dtype="Int32")
        rows_, cols_ = null(nr), null(nc)
        rows_[~some], cols_[~some] = pd.NA, pd.NA
        return pd.DataFrame({"tile": q.tile.to_numpy(), "prow": r, "pcol": c, "distance": np.where(some, d, np.nan), "near_row": rows_, "near_col": cols_})

    out = rows.groupBy("tile", "strip").applyInPandas(run, "tile string, prow int, pcol int, distance double, near_row int, near_col int")
    return out.withColumn("distance", F.nanvl("distance", F.lit(None).cast("double")))


def components(mask: DataFrame, block: int = BLOCK) -> DataFrame:
    """(tile, prow, pcol, comp): 4-connected; comp is the component's least prow * 2^31 + pcol.

    Blocks are labelled by union-find; labels that touch across a border are
    merged by label propagation over the borders' pairs, a small relation.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0, shape, at = _grid(pdf)
        m = np.zeros(shape, bool)
        m[at] = True
        flat = kernels.label(m)[at] - 1
        root = (flat // shape[1] + r0) * 2**31 + flat % shape[1] + c0
        return pd.DataFrame({"tile": pdf.tile, "prow": pdf.prow, "pcol": pdf.pcol, "local": root.astype(np.int64)})

    local = with_halo(mask.select("tile", "prow", "pcol").distinct(), 0, block).groupBy("tile", "brow", "bcol").applyInPandas(run, "tile string, prow int, pcol int, local long")
    local = materialise(local, "labels")
    edge = local.where(f"prow % {block} = 0 or pcol % {block} = 0 or prow % {block} = {block - 1} or pcol % {block} = {block - 1}")
    pairs = []
    for r, c in ((1, 0), (0, 1)):
        a = edge.select("tile", "prow", "pcol", F.col("local").alias("a"))
        b = edge.select("tile", (F.col("prow") - r).alias("prow"), (F.col("pcol") - c).alias("pcol"), F.col("local").alias("b"))
        pairs.append(a.join(large(b), ["tile", "prow", "pcol"]).where("a <> b").select("tile", "a", "b"))
    edges = materialise(pairs[0].unionByName(pairs[1]).distinct(), "borders")
    if edges.isEmpty():
        return local.select("tile", "prow", "pcol", F.col("local").alias("comp"))
    merged = connect_labels(edges)
    return local.join(merged.withColumnRenamed("node", "local"), ["tile", "local"], "left").select("tile", "prow", "pcol", F.coalesce("comp", "local").alias("comp"))


def connect_labels(edges: DataFrame) -> DataFrame:
    """(tile, node, comp): least label reachable over (tile, a, b), with pointer jumping; logarithmic rounds."""
    both = edges.unionByName(edges.select("tile", F.col("b").alias("a"), F.col("a").alias("b")))
    label = materialise(both.select("tile", F.col("a").alias("node"), F.col("a").alias("comp")).distinct(), "labels")
    while True:
        near = both.join(label.select("tile", F.col("node").alias("b"), "comp"), ["tile", "b"]).groupBy("tile", F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        step = label.join(near, ["tile", "node"]).select("tile", "node", F.least("comp", "m").alias("comp"), F.col("comp").alias("old"))
        jump = step.select("tile", F.col("node").alias("comp"), F.col("comp").alias("root"))
        new = materialise(step.join(jump, ["tile", "comp"]).select("tile", "node", F.col("root").alias("comp"), "old"), "labels")
        done = new.where("comp <> old").isEmpty()
        label = new.select("tile", "node", "comp")
        if done:
            return label


def sizes(components_: DataFrame) -> DataFrame:
    return components_.groupBy("tile", "comp").agg(F.count(F.lit(1)).alias("size"))


def at_least(components_: DataFrame, least: int, strict: bool = False) -> DataFrame:
    """Pixels of components with ``least`` pixels, or more than that if strict."""
    n = F.col("size")
    keep = sizes(components_).where(n > least if strict else n >= least).select("tile", "comp")
    return components_.join(large(keep), ["tile", "comp"], "left_semi")


def box_sums(pixels: DataFrame, sums: dict, half: int) -> DataFrame:
    """(tile, prow, pcol) and, for each named column, its sum over the window around each pixel.

    Separable: running sums along the rows, then along the columns, by RANGE frames.
    """
    from pyspark.sql import Window

    along = Window.partitionBy("tile", "prow").orderBy("pcol").rangeBetween(-half, half)
    across = Window.partitionBy("tile", "pcol").orderBy("prow").rangeBetween(-half, half)
    rows = pixels.select("tile", "prow", "pcol", *[F.sum(v).over(along).alias(k) for k, v in sums.items()])
    return rows.select("tile", "prow", "pcol", *[F.sum(k).over(across).alias(k) for k in sums])


def box_mean(pixels: DataFrame, value: str, mask, half: int) -> DataFrame:
    """Mean over a mask's pixels of the window around each pixel, and the mask's share of the full window."""
    m = F.when(mask, 1).otherwise(0)
    both = box_sums(pixels, {"s": m * F.col(value), "n": m}, half)
    return both.select("tile", "prow", "pcol", F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(0.0).alias("mean"), (F.col("n") / F.lit(float((2 * half + 1) ** 2))).alias("density"))


def histogram(pixels: DataFrame, value: str, bins: int = 256) -> DataFrame:
    """(tile, bin, n, centre): equal bins from a tile's least to its largest value, the last one closed.

    A constant tile has a range of one around its value, so all its pixels fall into one bin.
    """
    ends = pixels.groupBy("tile").agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    ends = ends.select("tile", F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    width = F.col("hi") - F.col("lo")
    place = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / width * bins)).cast("int")
    n = pixels.join(small(ends), "tile").groupBy("tile", place.alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    return n.select("tile", "bin", "n", (F.col("lo") + (F.col("bin") + 0.5) * width / bins).alias("centre"))


def otsu(pixels: DataFrame, value: str, bins: int = 256) -> DataFrame:
    """(tile, threshold): the first bin whose cut parts the values best, by its centre."""
    from pyspark.sql import Window

    h = histogram(pixels, value, bins)
    upto = Window.partitionBy("tile").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy("tile")
    h = h.select("tile", "bin", "centre", F.sum("n").over(upto).alias("w"), F.sum(F.col("n") * F.col("centre")).over(upto).alias("m"), F.sum("n").over(all_).alias("total"), F.sum(F.col("n") * F.col("centre")).over(all_).alias("sum"))
    rest = F.col("total") - F.col("w")
    below, above = F.col("m") / F.col("w"), F.when(rest > 0, (F.col("sum") - F.col("m")) / F.when(rest > 0, rest)).otherwise(0.0)
    variance = F.col("w") * rest * (below - above) * (below - above)
    return h.select("tile", "bin", "centre", variance.alias("v")).groupBy("tile").agg(F.min_by("centre", F.struct(-F.col("v"), "bin")).alias("threshold"))


def shadow_mask(pixels: DataFrame, road) -> DataFrame:
    """Road pixels whose blue excess reaches Otsu's threshold over the tile's road."""
    from corridor.functions import color

    values = pixels.where(road).withColumn("excess", color.blue_excess("r", "b"))
    cut = otsu(values, "excess")
    return values.join(small(cut), "tile").where(F.col("excess") >= F.col("threshold")).select("tile", "prow", "pcol")


def clean_mask(mask: DataFrame, frame_: DataFrame, gsd: float, closing_m: float, area_m2: float) -> DataFrame:
    """Closed by a disc, without components under an area."""
    closed = closing(mask, max(1, round(closing_m / gsd)), frame_)
    return at_least(components(closed), int(np.ceil(area_m2 / gsd**2))).select("tile", "prow", "pcol")


BANDS = ("r", "g", "b", "nir")


def shadow_lift(pixels: DataFrame, gsd: float, c) -> DataFrame:
    """(tile, prow, pcol, r, g, b, nir): what each shaded road pixel is raised by, none where its tile has no sunlit road.

    A pixel is raised from the mean of the shade around it to the light of the sunlit road:
    that of its nearest pixel at the border, the mean of the window deeper in, and the
    nearest pixel again where the window holds too little sunlit road.
    """
    sunny, shady = F.col("road") & ~F.col("shadow"), F.col("road") & F.col("shadow")
    half = pixels_of(c.shadow_window_m, gsd)
    count = {"n_sun": F.when(sunny, 1).otherwise(0), "n_shade": F.when(shady, 1).otherwise(0)}
    sums = {f"{kind}_{b}": F.when(own, F.col(b)).otherwise(0) for kind, own in (("sun", sunny), ("shade", shady)) for b in BANDS}
    around = box_sums(pixels, count | sums, half).join(large(pixels.where(shady).select("tile", "prow", "pcol")), ["tile", "prow", "pcol"])
    sun = pixels.where(sunny).select("tile", F.col("prow").alias("near_row"), F.col("pcol").alias("near_col"), *[F.col(b).alias(f"near_{b}") for b in BANDS])
    place = nearest(pixels.where(sunny), pixels.where(shady)).where("near_row IS NOT NULL")
    rows = around.join(large(place), ["tile", "prow", "pcol"]).join(large(sun), ["tile", "near_row", "near_col"])
    depth = F.least(F.lit(1.0), F.col("distance") * gsd / c.feather_m)
    depth = F.when(F.col("n_sun") >= c.min_reference_density * (2 * half + 1) ** 2, depth).otherwise(0.0)

    def raised(b: str):
        mean = F.coalesce(F.try_divide(f"sun_{b}", "n_sun"), F.lit(0.0))
        shade = F.greatest(F.lit(1.0), F.col(f"shade_{b}") / F.col("n_shade"))
        light = F.col(f"near_{b}") * (1 - depth) + mean * depth
        return F.greatest(F.lit(0.0), F.least(light - shade, shade * (c.shadow_max_gain - 1)))

    return rows.select("tile", "prow", "pcol", *[raised(b).alias(b) for b in BANDS])


def correct_shadows(pixels: DataFrame, gsd: float, c) -> DataFrame:
    """(tile, prow, pcol, r, g, b, nir) with shaded road lifted, however far it lies from the light; needs booleans ``road`` and ``shadow``.

    Sunlit road near a shadow takes a fading share of the nearest shaded pixel's lift, so that no seam shows.
    """
    key = ["tile", "prow", "pcol"]
    px = materialise(pixels.select(*key, *BANDS, "road", "shadow"), "lit")
    lift = materialise(shadow_lift(px, gsd, c), "lift")
    reach = c.bleed_m / gsd
    seam = distance(px.where("road AND shadow"), px.where("road AND NOT shadow"), int(reach)).where("near_row IS NOT NULL")
    seam = seam.withColumn("share", 1 - F.col("distance") / reach).where("share > 0").select("tile", "prow", "pcol", "near_row", "near_col", "share")
    from_shade = lift.select("tile", F.col("prow").alias("near_row"), F.col("pcol").alias("near_col"), *BANDS)
    spill = seam.join(large(from_shade), ["tile", "near_row", "near_col"]).select(*key, *[(F.col(b) * F.col("share")).alias(b) for b in BANDS])
    more = lift.unionByName(spill).select(*key, *[F.col(b).alias(f"more_{b}") for b in BANDS])
    out = px.join(large(more), key, "left")
    level = lambda b: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.col(b) + F.coalesce(f"more_{b}", F.lit(0.0)))).cast("int")
    return out.select(*key, *[level(b).alias(b) for b in BANDS])


def filter_tile(pixels: DataFrame, gsd: float, shadows: str = "none", boost: bool = True, c=CONFIG) -> DataFrame:
    """(tile, prow, pcol, r, g, b, nir, class, shadow): the image where a lane or street is, its class, its shadow.

    ``pixels`` has the flags bikelane and street.  Shadow is found in both, closed and sifted.
    Shaded pixels are left as they are (none), lifted (correct; those of the closing outside
    lane and street are not), or go with a margin around them (cut).  With ``boost`` red paint is made redder.
    """
    from corridor.functions import color

    key = ["tile", "prow", "pcol"]
    px = materialise(pixels.select(*key, *BANDS, "bikelane", "street"), "image")
    px = px.withColumn("road", F.col("bikelane") | F.col("street"))
    dark = materialise(clean_mask(shadow_mask(px, F.col("road")), frame(px), gsd, c.shadow_closing_m, c.min_shadow_m2), "dark")
    px = px.join(large(dark.withColumn("shadow", F.lit(True))), key, "left").withColumn("shadow", F.coalesce("shadow", F.lit(False)))
    if shadows == "cut":
        near = dilation(dark, kernels.disk(pixels_of(c.shadow_cut_margin_m, gsd))).withColumn("gone", F.lit(True))
        px = px.join(large(near), key, "left")
        px = px.withColumns({f: F.col(f) & F.col("gone").isNull() for f in ("bikelane", "street", "road")}).drop("gone")
    elif shadows == "correct":
        px = materialise(px, "flags")
        px = px.drop(*BANDS).join(large(correct_shadows(px, gsd, c)), key)
    elif shadows != "none":
        raise ValueError(f"shadows are none, correct or cut, not {shadows}")
    if boost:
        px = px.withColumns(color.hsv()).withColumn("s", color.boosted_saturation(F.col("h"), F.col("s"), F.col("road"), c))
        fits = F.col("road") & (color.red_distance(F.col("h")) <= c.red_hue_tolerance)
        px = px.withColumns({b: F.when(fits, v).otherwise(F.col(b)).cast("int") for b, v in color.rgb(F.col("h"), F.col("s"), F.col("v")).items()}).drop("h", "s", "v")
    bands = [color.nodata(F.col(b), F.col("road")).cast("int").alias(b) for b in BANDS]
    return px.select(*key, *bands, color.classify(F.col("bikelane"), F.col("street")).alias("class"), F.col("shadow").cast("int").alias("shadow"))
