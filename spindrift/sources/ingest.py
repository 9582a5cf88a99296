"""Ingest jobs: sources to annotated chunks to stores, in batch or as a checkpointed stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import annotate, chunks, hybrid
from ..operators.store import Store, open_store
from . import scratch

Encoder = Callable[[Column], Column]


def prose_chunks(files: DataFrame) -> DataFrame:
    """(path, name, size, section, chunk_index, text, domain, type, confidence, version) of files (path, name, text): sections, then packed sentences."""
    told = files.select("path", "name", "text", F.length("text").alias("size"), annotate.confidence(F.col("text")).alias("confidence"))
    out = chunks.exploded(told, chunks.prose(F.col("text")), "path", "name", "size", "confidence")
    return out.select("path", "name", "size", "section", "chunk_index", F.col("chunk").alias("text"), annotate.domain(F.col("name"), F.col("chunk")).alias("domain"), annotate.chunk_type(F.col("chunk")).alias("type"), "confidence", F.lit("2.0").alias("version"))


def code_chunks(rows: DataFrame) -> DataFrame:
    """(origin, source, language, section, chunk_index, text, domain, type, confidence) of source rows: whole blocks, constant annotations."""
    keyed = rows.withColumn("key", F.xxhash64("source", "origin"))
    parts = chunks.chunked(keyed, chunks.code_chunks, id_col="key")
    told = keyed.select("key", "origin", "source", "language").dropDuplicates(["key"])
    out = parts.join(told, parts["doc_id"] == told["key"])
    return out.select("origin", "source", "language", "section", "chunk_index", F.col("chunk").alias("text"), F.lit("code").alias("domain"), F.lit("documentation").alias("type"), F.lit(0.9).alias("confidence"))


def with_ids(rows: DataFrame, *by: str) -> DataFrame:
    """A stable ``id`` from what names a chunk: the same chunk gets the same id in every run."""
    return rows.withColumn("id", F.xxhash64(*by))


def encoded(rows: DataFrame, encoder: Encoder = hybrid.encoded) -> DataFrame:
    return rows.withColumn("embedding", encoder(F.col("text")))


def ingest_prose(files: DataFrame, path: str, *, encoder: Encoder = hybrid.encoded, **how) -> tuple[Store, DataFrame]:
    """The prose job; the store, and (name, domain, type, n) of its chunks."""
    rows = with_ids(prose_chunks(files), "path", "section", "chunk_index")
    store = Store.save(encoded(rows, encoder), path, **how)
    return store, file_counts(store.chunks) if store.count() else None


def file_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("name", "domain", "type").agg(F.count(F.lit(1)).alias("n"))


def ingest_code(rows: DataFrame, path: str, *, most_docs: int | None = None, encoder: Encoder = hybrid.encoded, **how) -> tuple[Store, DataFrame]:
    """The code job over source rows; ``most_docs`` caps the documents of each source, by name.  The store, and (language, n) of its chunks."""
    if most_docs is not None:
        order = Window.partitionBy("source").orderBy("origin")
        rows = rows.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most_docs).drop("_r")
    own = with_ids(code_chunks(rows), "source", "origin", "chunk_index")
    store = Store.save(encoded(own, encoder), path, **how)
    return store, store.chunks.groupBy("language").agg(F.count(F.lit(1)).alias("n")) if store.count() else None


def ingest_stream(articles: DataFrame, path: str, checkpoint: str, *, encoder: Encoder = hybrid.encoded, compression: str = "int8") -> StreamingQuery:
    """The encyclopedia job: a stream of source rows, each micro-batch chunked, encoded and appended.

    A batch is a part of the store that its next version lists, so a failure keeps
    the batches before it and shows nothing of its own, and a batch that is run
    again after it was published is not appended again.
    """

    def add(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        parts = chunks.exploded(rows, chunks.packed_sentences(F.col("text")), "origin", "source")
        own = parts.select("origin", "source", "chunk_index", F.col("chunk").alias("text"), F.lit("encyclopedia").alias("domain"))
        own = encoded(with_ids(own, "source", "origin", "chunk_index"), encoder)
        own = scratch.written(own, "batch")
        if not own.limit(1).count():
            return
        store = open_store(spark, path)
        if store is None:
            Store.save(own, path, compression=compression, batch=str(batch))
        else:
            store.append(own, batch=str(batch))

    return articles.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def open_or_ingest(spark: SparkSession, path: str, directory: str | None = None) -> Store | None:
    """The saved store, else one of the directory's files, else None."""
    from .readers import text_files

    return open_store(spark, path, (lambda: ingest_prose(text_files(spark, directory), path)[0]) if directory else None)


def checked(store: Store | None) -> Store:
    """The store of a job that must have ingested something."""
    if store is None or not store.count():
        raise RuntimeError("nothing was ingested")
    return store
