"""Intermediate tables and written results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, the folder that driver and executors share; one of this machine only in a local session without it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="corridor-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """A table in the shared folder in place of the plan that made it; it goes with the session."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


BROADCAST_ROWS = 200_000


def small(df: DataFrame, tag: str = "small") -> DataFrame:
    """A relation with a row for each tile, as a table: broadcast if it has few rows, else joined as any other."""
    table = materialise(df, tag)
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def large(df: DataFrame) -> DataFrame:
    """A relation that grows with the pixels, to be joined by merging.

    What is exploded or compresses well is many times its files' size, by which alone Spark would broadcast it.
    """
    return df.hint("merge")


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def cached(spark: SparkSession, path: str, columns: list[str], make) -> DataFrame:
    """The table at ``path`` if it is there with all the columns, else ``make()``, written there first."""
    if exists(spark, path) and set(columns) <= set((table := spark.read.parquet(path)).columns):
        return table
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save_pixels(df: DataFrame, path: str) -> None:
    """A raster as partitioned Parquet, sorted so that windows of rows and columns prune row groups."""
    df.repartitionByRange("tile", "prow").sortWithinPartitions("tile", "prow", "pcol").write.mode("overwrite").partitionBy("tile").parquet(path)


def load_window(spark: SparkSession, path: str, tile: str, rows: tuple[int, int], cols: tuple[int, int], bands: list[str]) -> DataFrame:
    """Some bands of a window; bounds reach the scan."""
    return spark.read.parquet(path).where(f"tile = '{tile}' AND prow BETWEEN {rows[0]} AND {rows[1] - 1} AND pcol BETWEEN {cols[0]} AND {cols[1] - 1}").select("tile", "prow", "pcol", *bands)


def save_records(df: DataFrame, path: str) -> None:
    """Gap records for a map, without the lane point."""
    df.drop("px", "py").write.mode("overwrite").parquet(path)


VECTOR_COLUMNS = {"features": ("feature_id", "category"), "lanes": ("lane_id",), "roads": ("way_id", "n_samples"), "gaps": ("lane_id", "gap_m")}


def save_vectors(df: DataFrame, kind: str, path: str) -> None:
    """Features, lanes, measured roads or gap records as a table; the columns of its kind must be there."""
    missing = [c for c in VECTOR_COLUMNS[kind] if c not in df.columns]
    if missing:
        raise ValueError(f"{kind} without {', '.join(missing)}")
    save_records(df, path)


def save_surface(mask: DataFrame, path: str) -> None:
    """A surface's pixels by tile, in runs of columns: a run is one row."""
    from pyspark.sql import Window

    order = Window.partitionBy("tile", "prow").orderBy("pcol")
    rows = mask.select("tile", "prow", "pcol").distinct().withColumn("run", F.col("pcol") - F.row_number().over(order))
    rows.groupBy("tile", "prow", "run").agg(F.min("pcol").alias("lo"), F.max("pcol").alias("hi")).drop("run").write.mode("overwrite").partitionBy("tile").parquet(path)


def load_surface(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.select(F.col("tile").cast("string").alias("tile"), "prow", F.explode(F.sequence("lo", "hi")).alias("pcol"))


def lane_mask(spark: SparkSession, path: str) -> DataFrame:
    """The pixels of a mask raster (tile, prow, pcol, value) whose value is above a half."""
    return spark.read.parquet(path).where("value > 0.5").select("tile", "prow", "pcol")


def mask_paths(tiles: DataFrame, masks: DataFrame) -> DataFrame:
    """Tiles (stem) with the path of their cached mask, null where (stem, mask_path) has none."""
    return tiles.join(masks.select("stem", "mask_path"), "stem", "left")


def raw_path(stems: DataFrame, configured: str, archive: str) -> DataFrame:
    """Stems with the path of the raw tile: the configured one for its own stem, else the archive's."""
    own = configured.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return stems.withColumn("path", F.when(F.col("stem") == own, configured).otherwise(F.concat(F.lit(f"{archive}/"), F.col("stem"), F.lit(".jp2"))))


def describe_tiles(pixels: DataFrame, crs: str = "EPSG:25832", nodata: int = 0) -> DataFrame:
    """A row for each tile and band: size, type, reference system, no-data value and how many pixels have it."""
    bands = [c for c in pixels.columns if c not in ("tile", "prow", "pcol")]
    kinds = dict(pixels.dtypes)
    one = F.array(*[F.struct(F.lit(k + 1).alias("band"), F.lit(b).alias("name"), F.lit(kinds[b]).alias("type"), (F.col(b) == nodata).alias("empty")) for k, b in enumerate(bands)])
    rows = pixels.select("tile", "prow", "pcol", F.explode(one).alias("b"))
    out = rows.groupBy("tile", "b.band", "b.name", "b.type").agg((F.max("prow") + 1).alias("height"), (F.max("pcol") + 1).alias("width"), F.count_if("b.empty").alias("n_nodata"))
    return out.withColumns({"crs": F.lit(crs), "nodata": F.lit(nodata)})


def save_chips(labels: DataFrame, split: DataFrame, path: str) -> None:
    """Label lines as text files, one folder for each split and chip."""
    rows = labels.join(split, "chip").select("split", "chip", "label")
    rows.repartition("split", "chip").write.mode("overwrite").partitionBy("split", "chip").text(path)


def result_path(root: str, name: str, window: tuple[int, int, int, int] | None = None) -> str:
    """Results of a window never take the place of the whole tile's."""
    return f"{root}/{name}" + ("" if window is None else "_" + "_".join(map(str, window)))


def schema_report(df: DataFrame) -> DataFrame:
    """Columns with their types and numbers of values and nulls."""
    stats = df.agg(*[F.count(c).alias(c) for c in df.columns], F.count(F.lit(1)).alias("_rows"))
    return stats.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(c).alias("n"), (F.col("_rows") - F.col(c)).alias("nulls")) for c, t in df.dtypes])).alias("s")).select("s.*")
