"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the setting is absent (local tests) a folder of this machine is
    taken and set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="corridor-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_making: ContextVar[list[str] | None] = ContextVar("_making", default=None)  # tables made within the settle that runs


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


ROW_GROUP = 8 << 20  # bytes of a written table's row group


def materialise(df: DataFrame, tag: str, codec: str = "zstd", row_group: int = ROW_GROUP) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    Cuts the lineage; the table outlives a lost executor and goes with the JVM.
    Snappy is not used: its codec takes buffers as large as a page outside the heap,
    which stay until the heap is collected, and pages of large binaries are large.
    Rows may be large binaries, and a reader holds a row group's rows as one batch: row
    groups are small, and sizes are looked at from the first row on, not after 100.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    small = {"parquet.block.size": row_group, "parquet.page.size": 256 << 10, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
    df.write.option("compression", codec).options(**small).parquet(path)
    own = _making.get()
    if own is not None:
        own.append(path)
    p, fs = _hadoop(spark, path)
    fs.deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def settle(spark: SparkSession, make: Callable[[], DataFrame], tag: str) -> DataFrame:
    """A table of what ``make`` gives; the tables that it made on the way, and its shuffles, go."""
    outer, own = _making.get(), []
    token = _making.set(own)
    try:
        out = materialise(make(), tag)
    finally:
        _making.reset(token)
    for path in own[:-1]:
        p, fs = _hadoop(spark, path)
        fs.delete(p, True)
    if outer is not None:
        outer.append(own[-1])
    release()
    return out


def lean(run: Callable) -> Callable:
    """A function on batches after which the worker gives freed memory back: idle workers stay alive between stages."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes

            import pyarrow as pa

            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library keeps its own counsel
                pass

    return wrapped


def release() -> None:
    """Drop Python's dead handles so that Spark may clean the shuffle files behind them."""
    import gc

    from pyspark import SparkContext

    gc.collect()
    sc = SparkContext._active_spark_context
    if sc is not None:
        sc._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 1000, megabytes: int = 4) -> None:
    """Bound the Arrow batches that workers get, by rows and by bytes: texts may be very long.

    Workers on this machine also get the package's folder on their path.
    """
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).parents[2]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{megabytes}m")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
