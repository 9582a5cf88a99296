"""Running counters of a stream: by kind over all its rows, and by kind and window of event time."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import snapshots

SCHEMA = "kind string, generated_by string, n long, total double, last_at timestamp, last_id long"


def _counted(kinds: Column, generators: Column, at: Column, name: Column, value: Column) -> tuple[list[Column], list[Column]]:
    """The keys and the mergeable sums of one row each: how many, their values' sum, and the last by time and then id."""
    last = F.max(F.when(at.isNotNull(), F.struct(at.cast("timestamp").alias("at"), name.cast("long").alias("id"))))
    return [kinds.cast("string").alias("kind"), generators.cast("string").alias("generated_by")], [
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(value.cast("double")), F.lit(0.0)).alias("total"), last.alias("last"),
    ]


def _flat(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(*more, "kind", "generated_by", "n", "total", F.col("last.at").alias("last_at"), F.col("last.id").alias("last_id"))


def windows(events: DataFrame, kind: str, at: str, name: str, value: str, width: str, lateness: str, generated_by: str | None = None) -> DataFrame:
    """(start, kind, generated_by, n, total, last_at, last_id) by windows of event time, for a stream or a table.

    On a stream a window is given once, when the watermark has passed its end,
    and its state goes then; rows that come more than ``lateness`` after the
    latest row seen, and whose window was given already, are not counted.  Rows
    without a time belong to no window.  Null kinds are a kind of their own.
    """
    keys, sums = _counted(F.col(kind), F.col(generated_by) if generated_by else F.lit(None), F.col(at), F.col(name), F.col(value))
    rows = events.withWatermark(at, lateness).filter(F.col(at).isNotNull())
    return _flat(rows.groupBy(F.window(at, width).alias("w"), *keys).agg(*sums).withColumn("start", F.col("w.start")), "start")


class Counters:
    """Counters (kind, generated_by, n, total, last_at, last_id) in a folder, a version of it a batch.

    A batch that is run again changes nothing, and readers see whole batches
    only.  The rows are as many as kinds and generators; older ones are kept
    beside them until ``path`` is removed.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def totals(self) -> DataFrame:
        """The counters after the last batch; no rows before the first."""
        manifest = snapshots.read(self.spark, self.path)
        if manifest is None:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{manifest['part']}")

    def last_batch(self) -> int:
        manifest = snapshots.read(self.spark, self.path)
        return -1 if manifest is None else manifest["batch"]

    def _put(self, rows: DataFrame, batch: int) -> None:
        part = f"parts/{uuid.uuid4().hex}"
        rows.coalesce(1).write.parquet(f"{self.path}/{part}")  # as many rows as kinds
        snapshots.advance(self.spark, self.path, lambda last: last if last and last["batch"] >= batch else {"batch": batch, "part": part})

    def add(self, told: DataFrame, batch: int) -> None:
        """Adds one batch's counters (of the same columns) to those that are there; a batch that was added isn't added again."""
        if batch <= self.last_batch():
            return
        both = self.totals().unionByName(told.select([F.col(f.name) for f in self.totals().schema]))
        last = F.max(F.when(F.col("last_at").isNotNull(), F.struct(F.col("last_at").alias("at"), F.col("last_id").alias("id"))))
        self._put(_flat(both.groupBy("kind", "generated_by").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), last.alias("last"))), batch)

    def follow(self, events: DataFrame, checkpoint: str, kind: str, at: str, name: str, value: str, generated_by: str | None = None) -> StreamingQuery:
        """Counts all rows that the stream has now: the state is a row a kind and generator, so nothing is ever too late.  Started again with the same checkpoint it goes on where it was."""
        keys, sums = _counted(F.col(kind), F.col(generated_by) if generated_by else F.lit(None), F.col(at), F.col(name), F.col(value))
        state = _flat(events.groupBy(*keys).agg(*sums))
        return state.writeStream.outputMode("complete").foreachBatch(self._put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counters(rows: DataFrame, kind: str, at: str, name: str, value: str, generated_by: str | None = None) -> DataFrame:
    """(kind, generated_by, n, total, last_at, last_id) of a table or one batch."""
    keys, sums = _counted(F.col(kind), F.col(generated_by) if generated_by else F.lit(None), F.col(at), F.col(name), F.col(value))
    return _flat(rows.groupBy(*keys).agg(*sums))
