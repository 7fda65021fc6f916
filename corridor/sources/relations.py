"""Relations read from the driver's tables, as SQL that Spark and DuckDB both run.

``{name}`` stands for a table of the driver or another relation of this module.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")

RELATIONS = {
    # a raster of 125 columns: one pixel per order
    "pixels": """
        SELECT 'orders' AS tile, CAST(floor(o_orderkey / 125) AS INT) AS prow, CAST(o_orderkey % 125 AS INT) AS pcol,
               CAST(floor(o_totalprice) % 256 AS INT) AS r, CAST(floor(7 * o_totalprice) % 256 AS INT) AS g,
               CAST(floor(o_totalprice / 11) % 256 AS INT) AS b, CAST(floor(3 * o_totalprice) % 256 AS INT) AS nir
        FROM {orders}""",
    # streets and cycleways: one straight segment per supplier
    "roads": """
        SELECT feature_id, x0, y0, x0 + ((feature_id % 7) - 3) * 10.0 AS x1, y0 + ((feature_id % 5) - 2) * 10.0 AS y1,
               CASE CAST(feature_id % 12 AS INT) WHEN 0 THEN 'primary' WHEN 1 THEN 'primary_link' WHEN 2 THEN 'secondary' WHEN 3 THEN 'secondary_link'
                    WHEN 4 THEN 'tertiary' WHEN 5 THEN 'tertiary_link' WHEN 6 THEN 'residential' WHEN 7 THEN 'unclassified'
                    WHEN 8 THEN 'living_street' WHEN 9 THEN 'service' WHEN 10 THEN 'cycleway' END AS highway,
               CASE WHEN feature_id % 9 = 0 THEN 'designated' END AS bicycle, CASE WHEN feature_id % 8 = 0 THEN 'lane' WHEN feature_id % 8 = 1 THEN 'no' END AS cycleway,
               CASE WHEN feature_id % 11 = 0 THEN 'track' END AS cycleway_left, CAST(NULL AS STRING) AS cycleway_right, CAST(NULL AS STRING) AS cycleway_both,
               CASE WHEN feature_id % 5 = 0 THEN 'MultiLineString' WHEN feature_id % 13 = 0 THEN 'Point' ELSE 'LineString' END AS kind
        FROM (SELECT s_suppkey AS feature_id, CAST((37 * s_suppkey) % 200 AS DOUBLE) AS x0, CAST((91 * s_suppkey) % 200 AS DOUBLE) AS y0 FROM {supplier}) s""",
    # lanes of two points: one per customer
    "lanes": """
        SELECT concat(CAST(k AS STRING), ':0') AS lane_id, CAST((53 * k) % 200 AS DOUBLE) AS x0, CAST((17 * k) % 200 AS DOUBLE) AS y0,
               CAST((53 * (k + 1)) % 200 AS DOUBLE) AS x1, CAST((17 * (k + 1)) % 200 AS DOUBLE) AS y1
        FROM (SELECT c_custkey AS k FROM {customer}) c""",
    # polylines of five points: one per supplier
    "path_points": """
        SELECT path_id, j, CAST((37 * path_id) % 200 + 6 * j + (path_id * j) % 5 AS DOUBLE) AS x, CAST((91 * path_id) % 200 + 3 * ((j * j) % 7) - (path_id % 3) * j AS DOUBLE) AS y
        FROM (SELECT s_suppkey AS path_id FROM {supplier}) s CROSS JOIN (SELECT 0 AS j UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) q""",
    # profiles across a road: the events of a user in the order of time
    "profiles": """
        SELECT user_id AS section_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS i,
               (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * CAST(0.05 AS DOUBLE) AS dist_m, value AS brightness,
               (event_id * 7 % 100) / CAST(100 AS DOUBLE) - 0.5 AS ndvi, (event_id * 13 % 100) / CAST(500 AS DOUBLE) - 0.1 AS redness,
               event_type AS label, event_id % 5 = 0 AS shadow, event_id % 3 <> 0 AS lane
        FROM {events}""",
    # gap records: the orders of a customer, two metres apart
    "gaps": """
        SELECT CAST(o_custkey AS STRING) AS lane_id,
               2.0 * (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1) AS offset_m,
               CASE WHEN floor(o_totalprice) % 500 / 100 - 1 > 0 THEN floor(o_totalprice) % 500 / 100 - 1 ELSE 0.0 END AS gap_m,
               2.75 AS road_edge_m, 2.75 + floor(o_totalprice) % 500 / 100 AS lane_edge_m,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'contiguous' WHEN '2-HIGH' THEN 'abutting' WHEN '3-MEDIUM' THEN 'asphalt' WHEN '4-NOT SPECIFIED' THEN 'vegetation' ELSE 'red paint' END AS composition,
               o_orderstatus <> 'P' AS reliable, floor(o_totalprice) % 7 / 10 AS shadow_fraction,
               CAST(o_orderkey % 997 AS DOUBLE) AS x, CAST(o_orderkey % 787 AS DOUBLE) AS y,
               CASE WHEN o_orderkey % 2 = 0 THEN 'tile_a' ELSE 'tile_b' END AS tile
        FROM {orders}""",
    # reference crops with their embeddings
    "crops": """
        SELECT CASE WHEN label = 0 THEN 'bikelane' WHEN label = 1 THEN 'road' ELSE 'negative' END AS label, vec_id AS stem, embedding
        FROM {embeddings}""",
    # lines of an annotation export: a class and normalised coordinates
    "annotations": """
        SELECT concat('tile_', CAST(p_partkey % 40 AS STRING)) AS stem, p_partkey AS line_no,
               CASE WHEN p_partkey % 17 = 0 THEN '' WHEN p_partkey % 13 = 0 THEN concat(CAST(p_partkey % 2 AS STRING), ' 0.1 0.2 0.3 0.4')
                    ELSE concat(CAST(p_partkey % 2 AS STRING), ' ', CAST(u AS STRING), ' ', CAST(v AS STRING), ' ', CAST(u + 0.0625 AS STRING), ' ', CAST(v AS STRING), ' ', CAST(u + 0.0625 AS STRING), ' ', CAST(v + 0.09375 AS STRING)) END AS line
        FROM (SELECT p_partkey, (p_partkey * 7 % 90) / CAST(128 AS DOUBLE) AS u, (p_partkey * 11 % 90) / CAST(128 AS DOUBLE) AS v FROM {part}) p""",
    # an image with a red lane beside a road, a verge between them; see tests
    "phantom": """
        SELECT 'phantom' AS tile, prow, pcol,
               CASE WHEN prow BETWEEN 126 AND 139 THEN 80 WHEN prow BETWEEN 140 AND 159 THEN 130 ELSE 100 END AS r,
               CASE WHEN prow BETWEEN 126 AND 139 THEN 120 WHEN prow BETWEEN 140 AND 159 THEN 90 ELSE 100 END AS g,
               CASE WHEN prow BETWEEN 126 AND 139 THEN 100 WHEN prow BETWEEN 140 AND 159 THEN 80 ELSE 100 END AS b,
               CASE WHEN prow BETWEEN 126 AND 139 THEN 220 WHEN prow BETWEEN 140 AND 159 THEN 110 ELSE 90 END AS nir,
               prow BETWEEN 140 AND 159 AS lane
        FROM (SELECT CAST(n_nationkey * 8 + k AS INT) AS prow FROM {nation} CROSS JOIN (SELECT r_regionkey AS k FROM {region} UNION ALL SELECT r_regionkey + 5 FROM {region} WHERE r_regionkey < 3) s) a
             CROSS JOIN (SELECT CAST(n_nationkey * 16 + k AS INT) AS pcol FROM {nation} CROSS JOIN (SELECT r_regionkey * 4 + j AS k FROM {region} CROSS JOIN (SELECT 0 AS j UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) q WHERE r_regionkey < 4) s) b""",
}


def sql(name: str) -> str:
    """The relation for DuckDB, where the driver's tables are views."""
    return re.sub(r"\{(\w+)\}", lambda m: m[1], RELATIONS[name])


def with_(*names: str) -> str:
    """A WITH clause for DuckDB that defines relations."""
    return "WITH " + ", ".join(f"{n} AS ({sql(n)})" for n in names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # workers on this machine find the package by this path
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A relation as a DataFrame; Catalyst prunes and pushes through it."""
    text = RELATIONS[name]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", text))})
