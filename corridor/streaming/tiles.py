"""Tiles as they arrive: a stream of Parquet files, each tile handled once."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corridor.sources.store import shared_dir


def read(spark: SparkSession, path: str, schema: StructType, files: int = 16) -> DataFrame:
    """A stream of the files under ``path`` (a glob is fine), a few at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def run(stream: DataFrame, per_batch: Callable[[DataFrame, int], None], name: str) -> None:
    """Handles all that is there and ends; progress is kept in the shared folder, so a restarted driver goes on."""
    spark = stream.sparkSession
    query = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", f"{shared_dir(spark)}/{name}").trigger(availableNow=True).start()
    query.awaitTermination()


def upsert(path: str, batch: DataFrame, number: int) -> None:
    """A batch's rows under its own number: written again after a failure they take their own place."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def arrivals(stream: DataFrame, time: str, late: str = "10 minutes") -> DataFrame:
    """Events in windows of an hour that may come late, each id once."""
    seen = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(["event_id"])
    return seen.groupBy(F.window(time, "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def summarise(stream: DataFrame, aggregate: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Partial aggregates of each batch, written as they come; the table of them is returned."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    run(stream, lambda batch, number: upsert(path, aggregate(batch), number), f"{name}-progress-{uuid.uuid4().hex}")
    return spark.read.parquet(path)
