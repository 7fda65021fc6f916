"""Ordered samples of a section: smoothing, gradients, islands, blocks, peaks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corridor.config import CONFIG
from corridor.functions import labels
from corridor.operators import kernels


def along(key: str = "section_id", order: str = "i"):
    return Window.partitionBy(key).orderBy(order)


def smooth(profile: DataFrame, value: str, sigma: float, key: str = "section_id", order: str = "i") -> DataFrame:
    """Gaussian smoothing, mirrored at the ends: a section's samples are an array, of which each place takes a weighted sum."""
    radius = int(4.0 * sigma + 0.5)
    weights = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-radius, radius + 1)]
    kernel = F.array(*[F.lit(w / sum(weights)) for w in weights])
    rows = profile.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("a"))
    rows = rows.select(key, F.transform("a", lambda x: x[value].cast("double")).alias("v"), F.transform("a", lambda x: x[order]).alias("at")).withColumn("n", F.size("v"))

    def mirrored(j: Column) -> Column:
        m = F.pmod(j, 2 * F.col("n"))
        return F.when(m < F.col("n"), m).otherwise(2 * F.col("n") - 1 - m)

    def place(j: Column) -> Column:
        return F.aggregate(F.transform(kernel, lambda w, d: w * F.get("v", mirrored(j + d - radius))), F.lit(0.0), lambda s, x: s + x)

    out = rows.withColumn("s", F.transform(F.sequence(F.lit(0), F.col("n") - 1), place))
    return out.select(key, F.explode(F.arrays_zip("at", "s")).alias("z")).select(key, F.col("z.at").alias(order), F.col("z.s").alias("smooth"))


def gradient(value: str, step: float, key: str = "section_id", order: str = "i") -> Column:
    """Central differences, one-sided at the ends; null for a lone sample."""
    w = along(key, order)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    wide = F.when(before.isNotNull() & after.isNotNull(), 2 * step).otherwise(step)
    return (F.coalesce(after, F.col(value)) - F.coalesce(before, F.col(value))) / F.when(before.isNotNull() | after.isNotNull(), wide)


def local_max(value: str, reach: int = 4) -> Column:
    return F.max(value).over(along().rowsBetween(-reach, reach))


def moving_average(profile: DataFrame, value: str, size: int, key: str = "section_id", order: str = "i") -> DataFrame:
    """Centred mean of ``size`` samples with the ends repeated; unchanged where a section has no more samples than that."""
    every = Window.partitionBy(key)
    back, ahead = size // 2, size - size // 2 - 1
    w = along(key, order)
    rows = profile.withColumns({"n": F.count(F.lit(1)).over(every), "rank": F.row_number().over(w), "first": F.first(value).over(w), "last": F.last(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    short_left, short_right = F.greatest(F.lit(0), back - (F.col("rank") - 1)), F.greatest(F.lit(0), ahead - (F.col("n") - F.col("rank")))
    total = F.sum(value).over(w.rowsBetween(-back, ahead)) + short_left * F.col("first") + short_right * F.col("last")
    return rows.select(key, order, F.when(F.col("n") > size, total / size).otherwise(F.col(value)).alias("mean"))


def islands(profile: DataFrame, label: str = "label", key: str = "section_id", order: str = "i") -> DataFrame:
    """Runs of one label: run_id, its ends, means of brightness, ndvi, redness and shadow."""
    w = along(key, order)
    cut = F.when(F.lag(label).over(w).eqNullSafe(F.col(label)), 0).otherwise(1)
    rows = profile.withColumn("cut", cut).withColumn("run_id", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    means = [(F.round(F.avg(c), 6) + 0.0).alias(c) for c in ("brightness", "ndvi", "redness")]
    return rows.groupBy(key, "run_id", label).agg(F.min("dist_m").alias("start_m"), F.max("dist_m").alias("end_m"), F.count(F.lit(1)).alias("n"), *means, F.round(F.avg(F.col("shadow").cast("double")), 6).alias("shadow_fraction"))


def run_at(runs: DataFrame, points: DataFrame, key: str = "section_id") -> DataFrame:
    """For each point (at_m) of a section the first run that holds it, ends included."""
    both = points.join(runs, key).where(labels.within(F.col("at_m"), F.col("start_m"), F.col("end_m")))
    return both.groupBy(key, "at_m").agg(F.min_by(F.struct("run_id", "label", "start_m", "end_m"), F.struct("start_m", "run_id")).alias("r")).select(key, "at_m", "r.*")


def block_start(profile: DataFrame, flag: str, key: str = "section_id", order: str = "i") -> DataFrame:
    """Where the block of true flags begins that holds the middle sample; null if that sample's flag is false.

    The middle sample is the first of those nearest to half the section's length.
    """
    w = along(key, order)
    rows = profile.withColumn("block", F.sum(F.when(F.col(flag), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    half = F.max("dist_m").over(Window.partitionBy(key)) / 2
    rows = rows.withColumn("off", F.abs(F.col("dist_m") - half))
    middle = rows.groupBy(key).agg(F.min_by(F.struct(F.col(flag).alias("ok"), "block", "dist_m"), F.struct("off", order)).alias("m"))
    true = rows.where(F.col(flag)).groupBy(key, "block").agg(F.min("dist_m").alias("start_m"))
    return middle.select(key, "m.ok", "m.block", F.col("m.dist_m").alias("middle_m")).join(true, [key, "block"], "left").select(key, "middle_m", F.when(F.col("ok"), F.col("start_m")).alias("start_m"))


def subsample_offset(value: str, key: str = "section_id", order: str = "i") -> Column:
    """How far a parabola through a sample and its neighbours peaks from it, at most one sample; 0 where it is flat."""
    w = along(key, order)
    before, after, mid = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    bend = before - 2 * mid + after
    shift = 0.5 * (before - after) / F.when(F.abs(bend) <= 1e-9, 1.0).otherwise(bend)
    return F.when(bend.isNull() | (F.abs(bend) <= 1e-9), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), shift)))


def peaks(profile: DataFrame, value: str, least: float, key: str = "section_id", order: str = "i") -> DataFrame:
    """Maxima with at least a prominence, and their half-height crossings in samples."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x = pdf["value"].to_numpy(float)
        rows = [(p, q, *kernels.half_width(x, p, q)) for p, q in kernels.peaks(x, least)]
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(rows), "peak": [int(r[0]) for r in rows], "prominence": [r[1] for r in rows], "left_at": [r[2] for r in rows], "right_at": [r[3] for r in rows]})

    kind = dict(profile.dtypes)[key]
    return profile.select(key, order, F.col(value).cast("double").alias("value")).groupBy(key).applyInPandas(run, f"{key} {kind}, peak int, prominence double, left_at double, right_at double")


def markings(profile: DataFrame, value: str = "brightness", key: str = "section_id", order: str = "i", c=CONFIG) -> DataFrame:
    """Spans brighter than their surroundings: a fine smoothing less a coarse one, narrow and prominent."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        spans = marking_spans(pdf["value"].to_numpy(float), c)
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(spans), "left_at": [s[0] for s in spans], "right_at": [s[1] for s in spans]})

    kind = dict(profile.dtypes)[key]
    return profile.select(key, order, F.col(value).cast("double").alias("value")).groupBy(key).applyInPandas(run, f"{key} {kind}, left_at double, right_at double")


def marking_spans(brightness: np.ndarray, c=CONFIG) -> list[tuple[float, float]]:
    excess = kernels.gaussian(brightness, c.marking_smooth) - kernels.gaussian(brightness, c.marking_baseline)
    spans = [kernels.half_width(excess, p, q) for p, q in kernels.peaks(excess, c.marking_min_excess)]
    return [s for s in spans if s[1] - s[0] <= c.marking_max_width]


def edge_precision(edges: DataFrame, gsd: float = 0.2, reach: float = 0.5) -> DataFrame:
    """How far a section's material edges lie from the nearest edge of the section before it, over all sections in order.

    ``edges`` has section (a running number), edge_m and material (false for edges of light).
    """
    now = edges.where("material").select("section", "edge_m")
    before = edges.where("material").select((F.col("section") + 1).alias("section"), F.col("edge_m").alias("other_m"))
    near = now.join(before, "section").groupBy("section", "edge_m").agg(F.min(F.abs(F.col("edge_m") - F.col("other_m"))).alias("d")).where(F.col("d") < reach)
    return near.agg(F.count("d").alias("n_pairs"), F.round(F.median("d"), 6).alias("median_m"), F.round(F.percentile("d", F.lit(0.9)), 6).alias("p90_m"), F.round(F.median("d") / gsd, 6).alias("gsd_ratio"))
