"""What the operators share: the shared scratch folder, written tables and a few expressions."""

from __future__ import annotations

import atexit
import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no ``spark.checkpoint.dir`` (single-machine tests).
LOCAL_SCRATCH = "file:///tmp/checkpoints/spindrift"

#: The longest Arrow batch, in rows, that the Python stages ask for is Spark's own
#: setting; tables whose rows are large keep few rows a partition instead.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


#: Scratch folders that are still there; what is left goes with the process.
_held: set[str] = set()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the cluster's shared folder; it goes when the process ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = LOCAL_SCRATCH
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _held:
        atexit.register(_clear)
    _held.add(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: its lineage ends there."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # lets Spark's cleaner drop shuffle files that only this step needed
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(*tables: DataFrame) -> None:
    """Removes tables of ``written`` that nothing lazy reads any more."""
    for df in tables:
        if path := getattr(df, "_scratch", None):
            remove(df.sparkSession, path)


def _clear() -> None:
    spark = SparkSession.getActiveSession()
    for path in list(_held) if spark is not None else ():
        try:
            remove(spark, path)
        except Exception:  # the session has gone already: nothing more can be done here
            return


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder through Hadoop's file system, wherever it is."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _held.discard(path)


def trim() -> None:
    """Gives memory that earlier tasks of this Python worker have freed back to the system; workers outlive their tasks."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if release := getattr(ctypes.CDLL(None), "malloc_trim", None):
        release(0)


def fold(column: str | Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id counts as the empty text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(of)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
