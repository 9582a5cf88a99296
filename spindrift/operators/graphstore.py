"""A stored graph that grows by batches and is looked up by either end.

A part is what one batch gave: its triples with their counts, by the bucket of
their subject and again by that of their object, and its nodes with the latest
document that names each.  These add up over parts, so a batch costs what its own
documents cost; ``compact`` writes the sum of all parts as one, with the number
of triples that end at each node.  Versions are ``snapshots``: a batch that
failed is not there, and one that was published is not added again.

A lookup names a bucket, so only that bucket's files are read, and merges the few
rows of one node.  Buckets of hubs are several files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import scratch
from . import graph, snapshots

BUCKETS = 32
_TRIPLE = ["s", "p", "o", "count", "confidence", "n_sources", "first_source"]


def _bucket(c):
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")


def merged(rows: DataFrame) -> DataFrame:
    """Triples of several parts as one: documents of different batches differ, so their numbers add up."""
    return rows.groupBy("s", "p", "o").agg(F.sum("count").alias("count"), F.max("confidence").alias("confidence"), F.sum("n_sources").alias("n_sources"), F.min("first_source").alias("first_source"))


class Graph:
    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.path = spark, path
        self.manifest = snapshots.read(spark, path, version) or {"version": 0, "parts": [], "batches": []}

    @property
    def parts(self) -> list[str]:
        return self.manifest["parts"]

    def _table(self, name: str) -> DataFrame:
        at = f"{self.path}/{name}"
        if not self.parts:
            raise ValueError(f"no graph at {self.path}")
        return self.spark.read.option("basePath", at).parquet(*[f"{at}/part={p}" for p in self.parts]).drop("part")

    # --- growing
    def _put(self, triples: DataFrame, nodes: DataFrame) -> str:
        name = uuid.uuid4().hex
        at = lambda table: f"{self.path}/{table}/part=p{name}"
        by = lambda df, end: df.withColumn("bucket", _bucket(F.col(end))).hint("rebalance", "bucket").sortWithinPartitions("bucket", end).write.partitionBy("bucket")
        by(triples.select(_TRIPLE), "s").parquet(at("triples"))
        written = self.spark.read.parquet(at("triples")).select(_TRIPLE)
        by(written, "o").parquet(at("inverse"))
        nodes.write.parquet(at("nodes"))
        return f"p{name}"

    def append(self, docs: DataFrame, batch: str, **columns: str) -> "Graph":
        """The next version, with what ``docs`` say; a batch of that name that is in it already is left as it is."""
        if batch in (snapshots.read(self.spark, self.path) or self.manifest)["batches"]:
            return Graph(self.spark, self.path)
        own, found = graph.extracted(docs, **columns)
        part = self._put(graph.triples(found), own.groupBy("id").agg(F.max("doc_id").alias("at"), F.max_by(F.struct("label", "type"), "doc_id").alias("e")).select("id", "at", "e.label", "e.type"))

        def change(last: dict | None) -> dict:
            last = last or {"parts": [], "batches": []}
            if batch in last["batches"]:
                return last
            return {"parts": [*last["parts"], part], "batches": [*last["batches"], batch], "degrees": None}

        snapshots.advance(self.spark, self.path, change)
        return Graph(self.spark, self.path)

    def compact(self) -> "Graph":
        """The next version, of the same content in one part, with degrees.  A single part stays as it is."""
        if len(self.parts) == 1:
            return self._degrees(self.parts[0], self.parts)
        nodes = self._table("nodes").groupBy("id").agg(F.max("at").alias("at"), F.max_by(F.struct("label", "type"), "at").alias("e")).select("id", "at", "e.label", "e.type")
        return self._degrees(self._put(self.triples(), nodes), self.parts)

    def _degrees(self, part: str, parts: list[str]) -> "Graph":
        """Counts the ends of a part's triples and publishes it instead of ``parts``."""
        ends = self.spark.read.parquet(f"{self.path}/triples/part={part}")
        ends = ends.select(F.col("s").alias("id")).union(ends.select("o")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
        ends.write.mode("overwrite").parquet(f"{self.path}/degrees/part={part}")

        def change(last: dict) -> dict:
            late = [p for p in last["parts"] if p not in parts]  # of writers meanwhile
            return last | {"parts": [part, *late], "degrees": None if late else part}

        snapshots.advance(self.spark, self.path, change)
        return Graph(self.spark, self.path)

    # --- reading
    def triples(self) -> DataFrame:
        rows = self._table("triples").select(_TRIPLE)
        return rows if len(self.parts) == 1 else merged(rows)

    def nodes(self) -> DataFrame:
        """(id, label, type): the latest document's, and placeholders for ends without one."""
        rows = self._table("nodes")
        own = rows if len(self.parts) == 1 else rows.groupBy("id").agg(F.max_by(F.struct("label", "type"), "at").alias("e")).select("id", "e.label", "e.type")
        return graph.with_placeholders(own, self._table("triples"))

    def out_of(self, *nodes: str) -> DataFrame:
        """Triples that begin at one of a few nodes."""
        return self._at("triples", "s", nodes)

    def into(self, *nodes: str) -> DataFrame:
        return self._at("inverse", "o", nodes)

    def _at(self, table: str, end: str, nodes: tuple[str, ...]) -> DataFrame:
        rows = self._table(table)
        rows = rows.filter(F.col("bucket").isin(*[_bucket_of(self.spark, n) for n in nodes]) & F.col(end).isin(*nodes)).select(_TRIPLE)
        return rows if len(self.parts) == 1 else merged(rows)

    def known(self, asked: DataFrame, id_col: str = "id") -> DataFrame:
        """Adds ``known`` to a few rows of ids: a node's own row or an end of a triple, of which only the asked are looked for where they lie."""
        few = F.broadcast(asked.select(F.col(id_col).alias("id")).distinct())  # as many rows as are asked
        found = self._table("nodes").select("id").join(few, "id", "left_semi")
        buckets = [r.b for r in asked.select(_bucket(F.col(id_col)).alias("b")).distinct().collect()]  # BUCKETS at most
        for table, end in (("triples", "s"), ("inverse", "o")):
            found = found.union(self._table(table).filter(F.col("bucket").isin(*buckets)).select(F.col(end).alias("id")).join(few, "id", "left_semi"))
        return graph.known(asked, found.distinct(), id_col)

    def facts(self, node: str) -> DataFrame:
        """Triples that begin or end at the node; a loop comes twice."""
        return self.out_of(node).union(self.into(node))

    def degrees(self, k: int = 10) -> DataFrame:
        if not self.manifest.get("degrees"):
            return graph.degrees(self.triples(), k)
        return self.spark.read.parquet(f"{self.path}/degrees/part={self.manifest['degrees']}").orderBy(F.desc("degree"), "id").limit(k)


_buckets: dict[str, int] = {}


def _bucket_of(spark: SparkSession, node: str) -> int:
    if node not in _buckets:
        _buckets[node] = spark.range(1).select(_bucket(F.lit(node)).alias("b")).first().b
    return _buckets[node]


def stream(documents: DataFrame, path: str, checkpoint: str, **columns: str) -> StreamingQuery:
    """Appends every micro-batch of a stream of documents under its number."""

    def add(rows: DataFrame, batch: int) -> None:
        own = scratch.written(rows, "batch")
        if own.limit(1).count():
            Graph(rows.sparkSession, path).append(own, f"stream-{batch}", **columns)

    return documents.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
