"""Files beside the tables: tile listings, statistics sidecars, annotation exports, reference crops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tile_paths(spark: SparkSession, folder: str, pattern: str = "*.jp2") -> DataFrame:
    """(path, stem) of the tiles in a folder, in order; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")
    return files.select("path", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("stem")).orderBy("path")


SIDECAR = "_band INT, Metadata STRUCT<MDI: ARRAY<STRUCT<_VALUE: STRING, _key: STRING>>>"


def sidecar(spark: SparkSession, path: str) -> DataFrame:
    """(path, band, key, value) of statistics sidecars in XML, such as minimum, mean and valid share."""
    rows = spark.read.format("xml").option("rowTag", "PAMRasterBand").schema(SIDECAR).load(path)
    long = rows.select(F.input_file_name().alias("path"), F.col("_band").alias("band"), F.explode("Metadata.MDI").alias("m"))
    return long.select("path", "band", F.regexp_replace("m._key", "^STATISTICS_", "").alias("key"), F.expr("try_cast(m._VALUE AS double)").alias("value"))


def annotations(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, line_no, line) of an export's label files; line_no counts within a file."""
    rows = spark.read.text(folder, wholetext=True).withColumn("path", F.input_file_name())
    return rows.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("stem"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


def class_names(spark: SparkSession, path: str) -> DataFrame:
    """(class_id, name) of the exports' data files; of two files that name a class the later path counts."""
    rows = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    # lines "  0: Name" under "names:"
    block = F.regexp_extract("value", r"(?m)^names:\s*\n((?:[ \t]+\d+:.*\n?)+)", 1)
    lines = rows.select("path", F.explode(F.split(block, r"\n")).alias("line")).where("trim(line) <> ''")
    named = lines.select("path", F.regexp_extract("line", r"(\d+):", 1).cast("int").alias("class_id"), F.trim(F.regexp_replace("line", r"^\s*\d+:\s*", "")).alias("name"))
    return named.groupBy("class_id").agg(F.max_by("name", "path").alias("name"))


def references(spark: SparkSession, folder: str) -> DataFrame:
    """(label, stem, embedding) of crops kept in one folder for each label: label=<name>/*.parquet with stem and embedding."""
    return spark.read.parquet(folder).select("label", "stem", "embedding")


def resolution(df: DataFrame, column: str = "res", default: float = 0.2) -> DataFrame:
    """A tile's pixel size, or the default where it is unknown."""
    return df.withColumn(column, F.coalesce(F.col(column).cast("double"), F.lit(default)))
