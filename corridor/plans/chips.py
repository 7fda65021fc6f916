"""Queries on an annotation export and the training chips made of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from corridor.operators import dataset
from corridor.sources.relations import load, with_

A = with_("annotations")
# tiles of different sizes; one stem has none
TILES = "SELECT stem, CAST(1000 + n * 13 AS INT) AS width, CAST(900 + n * 7 AS INT) AS height FROM (SELECT stem, CAST(substr(stem, 6) AS INT) AS n FROM {annotations}) t WHERE n <> 7 GROUP BY stem, n"


def tiles(spark, sf_dir):
    return spark.sql(TILES, annotations=load(spark, sf_dir, "annotations"))


def instances(spark, sf_dir):
    return dataset.parse(load(spark, sf_dir, "annotations"))


def placed(spark, sf_dir):
    rows, _ = dataset.with_tiles(instances(spark, sf_dir), tiles(spark, sf_dir))
    return dataset.denormalise(rows, 1000, 900)


def label_parse(spark, sf_dir):
    rows = instances(spark, sf_dir)
    return rows.select("stem", "line_no", "class_id", F.size("xy").alias("n"), *[F.round(F.col("xy")[k][a], 6).alias(f"{a}{k}") for k in range(3) for a in ("x", "y")])


def missing_tiles(spark, sf_dir):
    return dataset.with_tiles(instances(spark, sf_dir), tiles(spark, sf_dir))[1]


def class_counts(spark, sf_dir):
    return instances(spark, sf_dir).groupBy("class_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("stem").alias("stems"))


def chip_grid(spark, sf_dir):
    return dataset.chips(tiles(spark, sf_dir))


def chip_instances_bbox(spark, sf_dir):
    return dataset.by_chip(placed(spark, sf_dir), chip_grid(spark, sf_dir)).select("chip", "line_no", "class_id")


def chip_labels(spark, sf_dir):
    out = dataset.clip(dataset.by_chip(placed(spark, sf_dir), chip_grid(spark, sf_dir)))
    return out.withColumn("area", F.round("area", 4))


def chip_areas(spark, sf_dir):
    """Areas of the instances' parts in chips, by tile."""
    out = dataset.clip(dataset.by_chip(placed(spark, sf_dir), chip_grid(spark, sf_dir)))
    return out.groupBy("stem").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("area"), 3).alias("area"))


def train_val_split(spark, sf_dir):
    return dataset.split(chip_grid(spark, sf_dir))


def dataset_export(spark, sf_dir):
    """Label files written and read again: lines by split."""
    import uuid

    from corridor.sources import store

    path = f"{store.shared_dir(spark)}/dataset-{uuid.uuid4().hex}"
    names = spark.createDataFrame([(0, "Bikelane"), (1, "bikeoverroad")], "class_id int, name string")
    dataset.export(load(spark, sf_dir, "annotations"), names, tiles(spark, sf_dir), path)
    back = spark.read.text(f"{path}/labels")
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("chip").alias("chips"))


_T = f"{A}, tiles AS ({TILES.replace('{annotations}', 'annotations')})"
_I = f"""{_T}, p AS (SELECT stem, line_no, string_split(trim(line), ' ') AS v FROM annotations WHERE trim(line) <> ''),
    i AS (SELECT stem, line_no, v[1]::INT AS class_id, list_transform(v[2:], lambda x: x::DOUBLE) AS v FROM p WHERE len(v) >= 7)"""
_C = """chips AS (SELECT stem, printf('%s_%d_%d', stem, x0::INT, y0::INT) AS chip, x0::INT AS x0, y0::INT AS y0, least(640, width - x0)::INT AS w, least(640, height - y0)::INT AS h
    FROM (SELECT *, unnest(range(0, height, 576)) AS y0 FROM (SELECT *, unnest(range(0, width, 576)) AS x0 FROM tiles)))"""
QUERIES = {f.__name__: f for f in (label_parse, missing_tiles, class_counts, chip_grid, chip_instances_bbox, chip_labels, chip_areas, train_val_split, dataset_export)}
ORACLES = {
    "label_parse": f"{_I} SELECT stem, line_no, class_id, len(v)::INT // 2 AS n, " + ", ".join(f"round(v[{2 * k + j + 1}], 6) AS {a}{k}" for k in range(3) for j, a in enumerate("xy")) + " FROM i",
    "missing_tiles": f"{_I} SELECT DISTINCT stem FROM i WHERE stem NOT IN (SELECT stem FROM tiles)",
    "class_counts": f"{_I} SELECT class_id, count(*) AS n, count(DISTINCT stem) AS stems FROM i GROUP BY 1",
    "chip_grid": f"{_T}, {_C} SELECT * FROM chips",
    "chip_instances_bbox": f"{_I}, {_C}, b AS (SELECT stem, line_no, class_id, least(v[1], v[3], v[5]) * 1000 AS bx0, greatest(v[1], v[3], v[5]) * 1000 AS bx1, least(v[2], v[4], v[6]) * 900 AS by0, greatest(v[2], v[4], v[6]) * 900 AS by1 FROM i) SELECT chip, line_no, class_id FROM b JOIN chips USING (stem) WHERE bx1 > x0 AND bx0 < x0 + w AND by1 > y0 AND by0 < y0 + h",
    # under a right triangle's slope, cut at the chip's sides: a part below the chip's top and a part that reaches it
    "chip_areas": f"""{_I}, {_C}, b AS (SELECT stem, line_no, v[1] * 1000 AS ux, v[2] * 900 AS vy FROM i),
        j AS (SELECT b.stem, ux, vy, greatest(x0, ux) AS l, least(x0 + w, ux + 62.5) AS r, greatest(y0, vy) AS lo, (y0 + h)::DOUBLE AS hi FROM b JOIN chips USING (stem) WHERE ux < x0 + w AND ux + 62.5 > x0 AND vy < y0 + h AND vy + 84.375 > y0),
        k AS (SELECT *, ux + (lo - vy) / 1.35::DOUBLE AS xa, ux + (hi - vy) / 1.35::DOUBLE AS xb FROM j),
        a AS (SELECT stem, CASE WHEN least(r, xb) > greatest(l, xa) THEN 0.675::DOUBLE * (pow(least(r, xb) - xa, 2) - pow(greatest(l, xa) - xa, 2)) ELSE 0 END + CASE WHEN r > greatest(l, xb) THEN (r - greatest(l, xb)) * (hi - lo) ELSE 0 END AS area FROM k)
        SELECT stem, count(*) AS n, round(sum(area), 3) AS area FROM a WHERE area > 0 GROUP BY 1""",
    "train_val_split": f"{_T}, {_C}, r AS (SELECT chip, row_number() OVER (ORDER BY chip) AS r, count(*) OVER () AS n FROM chips) SELECT chip, CASE WHEN r > n - CASE WHEN n > 1 THEN least(greatest(1, round_even(n * 0.2, 0)), n - 1) ELSE 0 END THEN 'val' ELSE 'train' END AS split FROM r",
}
