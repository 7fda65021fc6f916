"""Queries on streams, reports and tables' descriptions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corridor.operators import measure, raster, report
from corridor.sources import store
from corridor.sources.relations import load, table, with_
from corridor.streaming import tiles


def stream_event_totals(spark, sf_dir):
    """Totals of a stream of files, put together from its batches."""
    stream = tiles.read(spark, f"{sf_dir}/events*.parquet", table(spark, sf_dir, "events").schema)
    parts = tiles.summarise(stream, lambda b: b.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")), "totals")
    return parts.groupBy("event_type").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def stream_hourly(spark, sf_dir):
    """Windows of an hour by event time, each event once."""
    stream = tiles.read(spark, f"{sf_dir}/events*.parquet", table(spark, sf_dir, "events").schema)
    path = f"{store.shared_dir(spark)}/hourly_{uuid.uuid4().hex}"
    # in complete mode a batch has all windows: the last one written is the result
    write = lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/table")
    query = tiles.arrivals(stream, "ts").writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.parquet(f"{path}/table")
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


def report_lines(spark, sf_dir):
    parts = raster.sizes(raster.components(load(spark, sf_dir, "pixels").where("r % 3 = 0")))
    text = report.markdown(load(spark, sf_dir, "gaps"), parts, "Measurement")
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "line int, text string")


def table_description(spark, sf_dir):
    return store.schema_report(load(spark, sf_dir, "roads")).select("column", "n", "nulls")


def window_round_trip(spark, sf_dir):
    """Pixels written as a partitioned raster, a window of two bands read again."""
    path = store.result_path(store.shared_dir(spark), "raster", (2, 10, 4, 50)) + f"_{uuid.uuid4().hex}"
    store.save_pixels(load(spark, sf_dir, "pixels"), path)
    return store.load_window(spark, path, "orders", (2, 6), (10, 60), ["r", "nir"])


def cached_features(spark, sf_dir):
    """Features fetched once: the second call finds the table."""
    path = f"{store.shared_dir(spark)}/features_{uuid.uuid4().hex}"
    make = lambda: load(spark, sf_dir, "roads").select("feature_id", "highway", "kind")
    store.cached(spark, path, ["feature_id", "highway"], make)
    return store.cached(spark, path, ["feature_id", "highway"], make).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def tile_concat(spark, sf_dir):
    """Records of two tiles put together, their lanes counted."""
    g = load(spark, sf_dir, "gaps")
    both = g.where("tile = 'tile_a'").unionByName(g.where("tile = 'tile_b'"))
    return measure.counts(both, "tile")


P, G, R = with_("pixels"), with_("gaps"), with_("roads")
QUERIES = {f.__name__: f for f in (stream_event_totals, stream_hourly, report_lines, table_description, window_round_trip, cached_features, tile_concat)}
_COLS = ("feature_id", "x0", "y0", "x1", "y1", "highway", "bicycle", "cycleway", "cycleway_left", "cycleway_right", "cycleway_both", "kind")
ORACLES = {
    "stream_event_totals": "SELECT event_type, count(*) AS n, min(value) AS low, max(value) AS high FROM events GROUP BY 1",
    "stream_hourly": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "table_description": f"{R} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, count(*) - count({c}) AS nulls FROM roads" for c in _COLS),
    "window_round_trip": f"{P} SELECT tile, prow, pcol, r, nir FROM pixels WHERE prow BETWEEN 2 AND 5 AND pcol BETWEEN 10 AND 59",
    "cached_features": f"{R} SELECT kind, count(*) AS n FROM roads GROUP BY 1",
    "tile_concat": f"{G} SELECT tile, count(*) AS n FROM gaps GROUP BY 1",
}
