"""Folders for tables that jobs write on the way; they go when the process ends."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")

#: Used only on a single machine, where the session names no ``spark.checkpoint.dir``.
LOCAL = "file:///tmp/checkpoints/spindrift"
_held: set[str] = set()


def folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the folder that the cluster shares."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = LOCAL
    if not _held:
        atexit.register(_clear)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _held.add(path)
    return path


def _clear() -> None:
    spark = SparkSession.getActiveSession()
    for path in list(_held) if spark is not None else ():
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has gone already
            return


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to a new folder and read back: computed once, and its lineage ends there."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def state(df: DataFrame) -> tuple:
    """What tells the files that ``df`` reads from any others: their names, lengths and times."""
    spark = df.sparkSession
    out = []
    for name in sorted(df.inputFiles()):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        f = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p)
        out.append((name, f.getLen(), f.getModificationTime()))
    return tuple(out)


_once: dict = {}


def once(key: tuple, build: Callable[[], T]) -> T:
    """``build()``, kept for the session under a key that holds the ``state`` of what it reads."""
    if key not in _once:
        _once[key] = build()
    return _once[key]
