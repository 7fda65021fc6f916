"""Queries on profiles across a road: smoothing, edges, runs."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from corridor.config import CONFIG
from corridor.functions import labels
from corridor.operators import measure, series
from corridor.sources.relations import load, with_

P = with_("profiles")
KEY = ("section_id", "i")
LABELS = "CASE WHEN label = 'click' THEN 'asphalt' ELSE label END"


def profile(spark, sf_dir):
    return load(spark, sf_dir, "profiles")


def profile_smooth(spark, sf_dir):
    out = series.smooth(profile(spark, sf_dir), "brightness", 1.0)
    return out.select(*KEY, F.round("smooth", 6).alias("smooth"))


def profile_gradient(spark, sf_dir):
    return profile(spark, sf_dir).select(*KEY, F.round(series.gradient("brightness", CONFIG.sample_step_m), 6).alias("gradient"))


def profile_local_max(spark, sf_dir):
    return profile(spark, sf_dir).select(*KEY, series.local_max("brightness").alias("local_max"))


def moving_average(spark, sf_dir):
    out = series.moving_average(profile(spark, sf_dir), "brightness", 5)
    return out.select(*KEY, F.round("mean", 6).alias("mean"))


def subsample_peak(spark, sf_dir):
    return profile(spark, sf_dir).select(*KEY, (F.round(series.subsample_offset("brightness"), 6) + 0.0).alias("offset"))


def runs(spark, sf_dir):
    return series.islands(profile(spark, sf_dir))


def runs_gaps_islands(spark, sf_dir):
    return runs(spark, sf_dir).select("section_id", "run_id", "label", F.round("start_m", 6).alias("start_m"), F.round("end_m", 6).alias("end_m"), "n", "brightness", "ndvi", "redness", "shadow_fraction")


def run_label(spark, sf_dir):
    rows = runs(spark, sf_dir).withColumn("material", labels.material(F.col("shadow_fraction"), F.col("label") == "purchase", F.col("ndvi"), F.col("redness"), F.col("brightness")))
    return rows.groupBy("material").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("end_m") - F.col("start_m")), 6).alias("mean_width"))


def run_containing(spark, sf_dir):
    points = profile(spark, sf_dir).select("section_id", (F.col("i") * F.lit(0.05) * 2).alias("at_m"))
    out = series.run_at(runs(spark, sf_dir), points)
    return out.select("section_id", F.round("at_m", 6).alias("at_m"), "run_id", "label")


def _strips(spark, sf_dir):
    r = F.struct("start_m", "end_m", "label")
    rows = runs(spark, sf_dir).withColumn("label", F.when(F.col("shadow_fraction") >= 0.75, "unknown (shadow)").otherwise(F.col("label")))
    return rows.groupBy("section_id").agg(F.array_sort(F.collect_list(r)).alias("runs"), F.min("start_m").alias("lo"), F.max("end_m").alias("hi"))


def widest_run_between(spark, sf_dir):
    """The label of the widest run that overlaps the middle of a section."""
    a, b = F.col("lo") + (F.col("hi") - F.col("lo")) * 0.25, F.col("lo") + (F.col("hi") - F.col("lo")) * 0.75
    out = _strips(spark, sf_dir)
    return out.select("section_id", measure.composition_osm(F.col("runs"), a, b, F.lit(-1.0)).alias("composition"))


def composition_case_pixel(spark, sf_dir):
    a, b = F.col("lo") + (F.col("hi") - F.col("lo")) * 0.25, F.col("lo") + (F.col("hi") - F.col("lo")) * 0.75
    return _strips(spark, sf_dir).select("section_id", measure.composition_pixel(F.col("runs"), b, a).alias("composition"))


def composition_case_osm(spark, sf_dir):
    """Composition by section for a road edge at 0.4 m and a lane edge that grows with the section's number."""
    rows = _strips(spark, sf_dir)
    out = measure.composition_osm(F.col("runs"), F.lit(0.4), F.expr("section_id % 10 / 10.0D"), F.col("lo"))
    return rows.select(out.alias("composition")).groupBy("composition").agg(F.count(F.lit(1)).alias("n"))


def lane_block_start(spark, sf_dir):
    out = series.block_start(profile(spark, sf_dir), "lane")
    return out.select("section_id", F.round("middle_m", 6).alias("middle_m"), F.round("start_m", 6).alias("start_m"))


def shadow_between(spark, sf_dir):
    """The share of shadow in a closed span, of the whole section where the span is empty."""
    span = F.when(F.col("dist_m").between(0.5, 1.5), F.col("shadow").cast("double"))
    return profile(spark, sf_dir).groupBy("section_id").agg(F.round(F.coalesce(F.avg(span), F.avg(F.col("shadow").cast("double")), F.lit(0.0)), 6).alias("fraction"))


def corridor_prominence(spark, sf_dir):
    """The least prominence of an edge in a section: median and 2.5 interquartile ranges, 0.02 at least."""
    p = lambda q: F.percentile("brightness", F.lit(q))
    return profile(spark, sf_dir).groupBy("section_id").agg(F.round(F.greatest(p(0.5) + CONFIG.edge_prominence_sigma * (p(0.75) - p(0.25)), F.lit(0.02)), 6).alias("prominence"))


def illumination_edges(spark, sf_dir):
    rows = profile(spark, sf_dir).withColumn("light", labels.is_illumination(F.abs("redness"), F.col("brightness") / 100))
    return rows.groupBy("section_id").agg(F.count_if("light").alias("n_light"), F.count_if(~F.col("light")).alias("n_material"))


def edge_precision(spark, sf_dir):
    edges = runs(spark, sf_dir).select(F.col("section_id").alias("section"), F.col("end_m").alias("edge_m"), (F.col("label") != "view").alias("material"))
    return series.edge_precision(edges)


def peaks_prominence(spark, sf_dir):
    out = series.peaks(profile(spark, sf_dir), "brightness", 60.0)
    return out.select("section_id", "peak", *[F.round(c, 6).alias(c) for c in ("prominence", "left_at", "right_at")])


def marking_spans(spark, sf_dir):
    out = series.markings(profile(spark, sf_dir))
    return out.select("section_id", *[F.round(c, 6).alias(c) for c in ("left_at", "right_at")])


_W = "WINDOW o AS (PARTITION BY section_id ORDER BY i)"
_RUNS = f"""{P}, c AS (SELECT *, CASE WHEN lag(label) OVER o IS NOT DISTINCT FROM label THEN 0 ELSE 1 END AS cut FROM profiles {_W}),
    n AS (SELECT *, sum(cut) OVER (PARTITION BY section_id ORDER BY i) AS run_id FROM c),
    runs AS (SELECT section_id, run_id, label, min(dist_m)::DOUBLE AS start_m, max(dist_m)::DOUBLE AS end_m, count(*) AS n, round(avg(brightness), 6) AS brightness, CASE WHEN round(avg(ndvi), 6) = 0 THEN 0.0 ELSE round(avg(ndvi), 6) END AS ndvi, CASE WHEN round(avg(redness), 6) = 0 THEN 0.0 ELSE round(avg(redness), 6) END AS redness, round(avg(shadow::INT), 6) AS shadow_fraction FROM n GROUP BY 1, 2, 3)"""
_STRIPS = f"""{_RUNS}, l AS (SELECT section_id, run_id, start_m, end_m, CASE WHEN shadow_fraction >= 0.75 THEN 'unknown (shadow)' ELSE label END AS label FROM runs),
    e AS (SELECT section_id, min(start_m) AS lo, max(end_m) AS hi FROM l GROUP BY 1), m AS (SELECT section_id, lo, lo + (hi - lo) * 0.25 AS a, lo + (hi - lo) * 0.75 AS b FROM e)"""


def _compose(gap: str, cond: str) -> str:
    """Widest of the runs that fulfil ``cond``; of equal widths the first."""
    return f"""w AS (SELECT m.section_id, {gap} AS gap, list(l.label ORDER BY l.start_m - l.end_m, l.start_m) FILTER ({cond}) AS names FROM m JOIN l USING (section_id) GROUP BY ALL),
        k AS (SELECT section_id, CASE WHEN gap <= 0 THEN 'contiguous' WHEN names IS NULL OR len(names) = 0 THEN 'abutting' WHEN list_contains(names, 'unknown (shadow)') THEN 'unknown (shadow)' ELSE names[1] END AS composition FROM w)"""


_G = [math.exp(-0.5 * d * d) for d in range(-4, 5)]
_MIRROR = "CASE WHEN ({0}) < 0 THEN -({0}) - 1 WHEN ({0}) >= n THEN 2 * n - 1 - ({0}) ELSE ({0}) END"
_SMOOTH = " + ".join(f"{w / sum(_G)!r}::DOUBLE * v[1 + ((i + {d} + 8 * n) % (2 * n)) + CASE WHEN (i + {d} + 8 * n) % (2 * n) < n THEN 0 ELSE 2 * n - 1 - 2 * ((i + {d} + 8 * n) % (2 * n)) END]" for d, w in zip(range(-4, 5), _G))
QUERIES = {
    f.__name__: f
    for f in (
        profile_smooth, profile_gradient, profile_local_max, moving_average, subsample_peak, runs_gaps_islands, run_label, run_containing, widest_run_between, composition_case_pixel, composition_case_osm, lane_block_start,
        shadow_between, corridor_prominence, illumination_edges, edge_precision, peaks_prominence, marking_spans,
    )
}
ORACLES = {
    "profile_smooth": f"{P}, a AS (SELECT section_id, list(brightness ORDER BY i) AS v, count(*) AS n FROM profiles GROUP BY 1), j AS (SELECT section_id, v, n, unnest(range(0, n))::INT AS i FROM a) SELECT section_id, i, round({_SMOOTH}, 6) AS smooth FROM j",
    "profile_gradient": f"{P} SELECT section_id, i, round((coalesce(lead(brightness) OVER o, brightness) - coalesce(lag(brightness) OVER o, brightness)) / CASE WHEN lead(brightness) OVER o IS NOT NULL AND lag(brightness) OVER o IS NOT NULL THEN 0.1 WHEN lead(brightness) OVER o IS NOT NULL OR lag(brightness) OVER o IS NOT NULL THEN 0.05 END::DOUBLE, 6) AS gradient FROM profiles {_W}",
    "profile_local_max": f"{P} SELECT section_id, i, max(brightness) OVER (PARTITION BY section_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS local_max FROM profiles",
    "moving_average": f"{P}, a AS (SELECT section_id, list(brightness ORDER BY i) AS v, count(*) AS n FROM profiles GROUP BY 1), j AS (SELECT section_id, v, n, unnest(range(0, n))::INT AS i FROM a) SELECT section_id, i, round(CASE WHEN n > 5 THEN (" + " + ".join(f"v[greatest(1, least(n, i + 1 + {d}))]" for d in range(-2, 3)) + ") / 5 ELSE v[i + 1] END, 6) AS mean FROM j",
    "subsample_peak": f"{P}, b AS (SELECT section_id, i, lag(brightness) OVER o AS p, brightness AS m, lead(brightness) OVER o AS q FROM profiles {_W}), o AS (SELECT section_id, i, round(CASE WHEN p IS NULL OR q IS NULL OR abs(p - 2 * m + q) <= 1e-9 THEN 0.0 ELSE greatest(-1, least(1, 0.5 * (p - q) / (p - 2 * m + q))) END, 6) AS f FROM b) SELECT section_id, i, CASE WHEN f = 0 THEN 0.0 ELSE f END AS offset FROM o",
    "runs_gaps_islands": f"{_RUNS} SELECT section_id, run_id, label, round(start_m, 6) AS start_m, round(end_m, 6) AS end_m, n, brightness, ndvi, redness, shadow_fraction FROM runs",
    "run_label": f"{_RUNS}, k AS (SELECT *, CASE WHEN shadow_fraction >= 0.2 THEN 'unknown (shadow)' WHEN label = 'purchase' THEN 'bright/marking' WHEN ndvi > 0.15 THEN 'vegetation' WHEN redness > 0.05 THEN 'red paint' WHEN brightness > 165 THEN 'bright/marking' ELSE 'asphalt' END AS material FROM runs) SELECT material, count(*) AS n, round(avg(end_m - start_m), 6) AS mean_width FROM k GROUP BY 1",
    "run_containing": f"{_RUNS}, q AS (SELECT DISTINCT section_id, i * 0.05::DOUBLE * 2 AS at_m FROM profiles) SELECT section_id, round(at_m, 6) AS at_m, run_id, label FROM q JOIN runs USING (section_id) WHERE at_m BETWEEN start_m AND end_m QUALIFY row_number() OVER (PARTITION BY section_id, at_m ORDER BY start_m, run_id) = 1",
    "widest_run_between": f"{_STRIPS}, {_compose('greatest(b - a, 0)', 'l.end_m > a AND l.start_m < b')} SELECT section_id, composition FROM k",
    "composition_case_pixel": f"{_STRIPS}, {_compose('greatest(b - a, 0)', 'l.start_m >= a AND l.end_m <= b')} SELECT section_id, composition FROM k",
    "composition_case_osm": f"{_STRIPS}, {_compose('greatest(m.section_id % 10 / 10::DOUBLE - 0.4, 0)', 'l.end_m > 0.4 AND l.start_m < m.section_id % 10 / 10::DOUBLE AND l.start_m <> lo')} SELECT composition, count(*) AS n FROM k GROUP BY 1",
    "lane_block_start": f"""{P}, b AS (SELECT *, sum(CASE WHEN lane THEN 0 ELSE 1 END) OVER (PARTITION BY section_id ORDER BY i) AS block, max(dist_m) OVER (PARTITION BY section_id) / 2 AS half FROM profiles),
        m AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY abs(dist_m::DOUBLE - half::DOUBLE), i) = 1),
        s AS (SELECT section_id, block, min(dist_m) AS start_m FROM b WHERE lane GROUP BY 1, 2)
        SELECT m.section_id, round(m.dist_m, 6)::DOUBLE AS middle_m, CASE WHEN m.lane THEN round(s.start_m, 6)::DOUBLE END AS start_m FROM m LEFT JOIN s ON s.section_id = m.section_id AND s.block = m.block""",
    "shadow_between": f"{P} SELECT section_id, round(coalesce(avg(shadow::INT) FILTER (dist_m BETWEEN 0.5 AND 1.5), avg(shadow::INT)), 6) AS fraction FROM profiles GROUP BY 1",
    "corridor_prominence": f"{P} SELECT section_id, round(greatest(quantile_cont(brightness, 0.5) + 2.5 * (quantile_cont(brightness, 0.75) - quantile_cont(brightness, 0.25)), 0.02), 6) AS prominence FROM profiles GROUP BY 1",
    "illumination_edges": f"{P} SELECT section_id, count(*) FILTER (brightness / 100 > 25 * greatest(abs(redness), 1e-9)) AS n_light, count(*) FILTER (brightness / 100 <= 25 * greatest(abs(redness), 1e-9)) AS n_material FROM profiles GROUP BY 1",
    "edge_precision": f"{_RUNS}, e AS (SELECT section_id, end_m AS edge_m FROM runs WHERE label <> 'view'), d AS (SELECT a.section_id, a.edge_m, min(abs(a.edge_m - b.edge_m)) AS d FROM e a JOIN e b ON b.section_id = a.section_id - 1 GROUP BY 1, 2) SELECT count(*) AS n_pairs, round(median(d), 6) AS median_m, round(quantile_cont(d, 0.9), 6) AS p90_m, round(median(d) / 0.2, 6) AS gsd_ratio FROM d WHERE d < 0.5",
}
