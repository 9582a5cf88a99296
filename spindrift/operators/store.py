"""Chunk stores: vectors with their texts, kept whole or as codes, in immutable versions, and hybrid search over them.

A store is a folder of parts and versions (``snapshots``).  A part is what one
save or append wrote: its ``chunks`` (id, text, its ``tokens``, other columns, and
either ``embedding`` or ``codes`` and ``scale``, with ``words`` of sign bits in
binary mode), their ``postings`` by token with the number of rows that hold each
one (``terms``), and for each shard key the sum of the vectors of every value
(``sums``).  A version lists its parts, so readers keep theirs while others
append; what is derived of all rows adds up over parts.  The IVF index of a store
is a folder of versions too, and takes in the parts that it lacks when searched.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import vectors as V
from ..functions.text import tokens
from ..sources import scratch
from . import hybrid, search, shards, snapshots

MODES = ("none", "int8", "binary")
DEFAULT_K = 5


@dataclass(frozen=True)
class Options:
    """How a store is searched."""

    reranker: bool = True
    ann: str = "flat"
    probes: int | None = None
    shard_key: str | None = "language"
    margin: float = shards.MARGIN

    @classmethod
    def resolve(cls, raw: Mapping[str, str | None]) -> "Options":
        """From strings; what is missing or makes no sense falls back to the defaults."""
        get = lambda name: (raw.get(name) or "").strip().lower()
        probes = get("probes")
        key = (raw.get("shard_key") or "").strip()
        return cls(
            reranker=get("reranker") != "off", ann=get("ann") if get("ann") in ("flat", "ivf") else "flat",
            probes=int(probes) if probes.isdigit() and int(probes) >= 1 else None,
            shard_key=None if key.lower() in ("off", "none") else key or "language",
        )


def coded(chunks: DataFrame, compression: str, dim: int) -> DataFrame:
    """The columns that a store of this mode keeps; compressed modes keep no floats."""
    if compression not in MODES:
        raise ValueError(f"compression is one of {MODES}")
    rows = chunks.withColumn("embedding", search.of_dimension(F.col("embedding"), dim))
    if compression == "none":
        return rows
    rows = rows.withColumn("scale", V.scale(F.col("embedding"))).withColumn("codes", V.codes(F.col("embedding"), F.col("scale")).cast("array<tinyint>"))
    if compression == "binary":
        rows = rows.withColumn("words", V.sign_words(F.col("embedding"), dim))
    return rows.drop("embedding")


class NoStore(ValueError):
    """There is no store, or not that version of it."""


def _with_tokens(rows: DataFrame) -> DataFrame:
    if "tokens" in rows.columns:  # the caller has them already
        return rows
    return rows.withColumn("tokens", tokens(F.col("text"))) if "text" in rows.columns else rows.withColumn("tokens", F.array().cast("array<string>"))


def _vectors(rows: DataFrame, compression: str) -> DataFrame:
    return rows if compression == "none" else rows.withColumn("embedding", V.dequantised(F.col("codes"), F.col("scale")))


def _put_postings(spark: SparkSession, chunks: DataFrame, at: Callable[[str], str]) -> None:
    found = hybrid.postings(chunks)
    found.hint("rebalance", "bucket").sortWithinPartitions("bucket", "token", "id").write.partitionBy("bucket").parquet(at("postings"))
    spark.read.schema(found.schema).parquet(at("postings")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).write.parquet(at("terms"))


def _put(rows: DataFrame, path: str, told: Mapping) -> dict:
    """Writes one part, its chunks first and what is derived of these then; the part's name and number of rows."""
    spark, name = rows.sparkSession, uuid.uuid4().hex
    rows, at = _with_tokens(rows), lambda table: f"{path}/{table}/part={name}"
    writer = rows.write
    (writer.partitionBy(told["partition_by"]) if told.get("partition_by") else writer).parquet(at("chunks"))
    back = spark.read.schema(rows.schema).parquet(at("chunks"))
    if told["compression"] == "none":  # only whole vectors are searched through postings
        _put_postings(spark, back, at)
    for key in told["keys"]:
        shards.sums(_vectors(back, told["compression"]), key).write.parquet(at(f"sums/{key}"))
    return {"name": name, "n": back.count()}


class Store:
    def __init__(self, spark: SparkSession, path: str, manifest: Mapping, options: Options = Options()):
        self.spark, self.path, self.manifest, self.options = spark, path, dict(manifest), options
        self.chunks = self._read("chunks", StructType.fromJson(manifest["schema"])) if manifest["n"] else None
        self._ivf: shards.Ivf | None = None

    def _read(self, name: str, schema: StructType | str, parts: list[dict] | None = None) -> DataFrame:
        schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        at = f"{self.path}/{name}"
        own = [f"{at}/part={p['name']}" for p in (self.manifest["parts"] if parts is None else parts)]
        return self.spark.read.schema(StructType([*schema, StructField("part", StringType())])).option("basePath", at).parquet(*own).select(*[f"`{c}`" for c in schema.names])

    # --- saving and loading
    @classmethod
    def save(cls, chunks: DataFrame, path: str, *, compression: str = "int8", model: str = "hash", scale: str = "vector", options: Options = Options(), partition_by: str | None = None, keys: tuple[str, ...] = (), batch: str | None = None) -> "Store":
        """Writes a store, as the next version where there is one; ``partition_by`` names a key to store by, which routed searches prune by.

        Sums are kept of ``keys``, of ``partition_by`` and of the options' shard key, where the chunks have them.
        """
        spark = chunks.sparkSession
        first = chunks.select(F.size("embedding").alias("d")).first()
        dim = first.d if first else 0
        if scale == "global" and compression == "int8" and first:
            top = chunks.agg(F.max(F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))).alias("m")).first().m or 1.0
            rows = chunks.withColumn("embedding", search.of_dimension(F.col("embedding"), dim)).withColumn("scale", F.lit(top / 127.0)).withColumn("codes", V.codes(F.col("embedding"), F.col("scale")).cast("array<tinyint>")).drop("embedding")
        else:
            rows = coded(chunks, compression, dim)
        told = {"compression": compression, "model": model, "dim": dim, "scale": scale, "partition_by": partition_by, "keys": sorted({k for k in (*keys, partition_by, options.shard_key) if k in chunks.columns})}
        part = _put(rows, path, told) | ({"batch": batch} if batch is not None else {}) if first else None
        schema = _with_tokens(rows).schema.jsonValue()
        manifest = snapshots.advance(spark, path, lambda _: told | {"schema": schema, "parts": [part] if part else [], "n": part["n"] if part else 0})
        return cls(spark, path, manifest, options)

    @classmethod
    def load(cls, spark: SparkSession, path: str, options: Options = Options(), model: str | None = None, version: int | None = None) -> "Store":
        """The latest version, or one that was published before.  Nothing is encoded anew; another model than the store's is an error."""
        manifest = snapshots.read(spark, path, version)
        if manifest is None:
            raise NoStore(f"no store at {path}" + (f" of version {version}" if version else ""))
        if manifest["compression"] not in MODES:
            raise ValueError(f"a store of unknown compression at {path}")
        if model and manifest["model"] != model:
            raise ValueError(f"the store holds vectors of {manifest['model']}, not of {model}")
        return cls(spark, path, manifest, options)

    def append(self, chunks: DataFrame, batch: str | None = None) -> "Store":
        """The next version, with more rows of the same dimension; a store with one scale for all can't grow.

        Readers of other versions see nothing of it, nor does anyone if it fails
        before it is published.  A ``batch`` that was appended under its name
        before isn't appended again.
        """
        if self.manifest["scale"] == "global":
            raise ValueError("codes of one global scale can't be appended to")
        if batch is not None and any(p.get("batch") == batch for p in (snapshots.read(self.spark, self.path) or self.manifest)["parts"]):
            return Store.load(self.spark, self.path, self.options)
        first = chunks.select(F.size("embedding").alias("d")).first()
        dim = self.manifest["dim"] or (first.d if first else 0)
        rows = coded(chunks, self.manifest["compression"], dim)
        if self.manifest["n"]:
            known = StructType.fromJson(self.manifest["schema"])
            if extra := set(rows.columns) - set(known.names):
                raise ValueError(f"the store has no column {', '.join(sorted(extra))}")
            rows = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in known if f.name != "tokens"])
        told = self.manifest | {"dim": dim}
        if not told["n"]:
            told |= {"schema": _with_tokens(rows).schema.jsonValue(), "keys": sorted({k for k in (*told["keys"], self.options.shard_key) if k in rows.columns})}
        part = _put(rows, self.path, told) | ({"batch": batch} if batch is not None else {})

        def change(last: dict | None) -> dict:
            if last["model"] != told["model"] or last["n"] and last["dim"] != dim:
                raise ValueError("the store was replaced by one of another kind")
            kept = last if last["n"] else told
            return kept | {"parts": [*last["parts"], part], "n": last["n"] + part["n"]}

        return Store(self.spark, self.path, snapshots.advance(self.spark, self.path, change), self.options)

    # --- what is there
    def count(self) -> int:
        return self.manifest["n"]

    def footprint(self) -> DataFrame:
        """(n, float_bytes, int8_bytes, binary_bytes): what vectors, codes with scales and sign bits take."""
        n, d = self.manifest["n"], self.manifest["dim"]
        return self.spark.createDataFrame([(n, 4 * n * d, n * d + 4 * n, n * -(-d // 8))], "n long, float_bytes long, int8_bytes long, binary_bytes long")

    def describe(self) -> dict:
        return {"stage": "retrieve", "healthy": True, "chunks": self.count(), **{k: self.manifest[k] for k in ("compression", "model", "version")}, "capabilities": ["exact", "int8", "binary", "ivf", "shards", "hybrid", "rerank"]}

    def vectors(self, parts: list[dict] | None = None) -> DataFrame:
        """Chunks with ``vec_id`` and ``embedding``: floats, or those that the codes stand for."""
        rows = self.chunks if parts is None else self._read("chunks", StructType.fromJson(self.manifest["schema"]), parts)
        return _vectors(rows, self.manifest["compression"]).withColumn("vec_id", F.col("id"))

    def centers(self, key: str) -> DataFrame:
        """(key, n, centroid) of a shard key: from the sums kept with each part, else from the vectors."""
        if key not in self.manifest["keys"]:
            return shards.centroids(self.vectors(), key)
        kind = StructType.fromJson(self.manifest["schema"])[key].dataType.simpleString()
        return shards.centers_of(self._read(f"sums/{key}", f"key {kind}, n long, total array<double>"))

    def postings(self) -> DataFrame:
        """(bucket, token, id): as stored with whole vectors, else made of the chunks' tokens."""
        if self.manifest["compression"] != "none":
            return hybrid.postings(self.chunks).select("token", "id", "bucket")
        return self._read("postings", f"token string, id {self.chunks.schema['id'].dataType.simpleString()}, bucket int")

    def terms(self) -> DataFrame:
        """(token, n), a row a part; as ``postings``."""
        if self.manifest["compression"] != "none":
            return self.postings().groupBy("token").agg(F.count(F.lit(1)).alias("n"))
        return self._read("terms", "token string, n long")

    def ivf(self, most: int | None = None) -> shards.Ivf:
        """The index over this version's rows.  Parts that it lacks are assigned to its cells; cells of more than ``most`` rows (eight times the mean, if not told) are split."""
        if self._ivf is None:
            parts = {p["name"]: p for p in self.manifest["parts"]}
            rows = lambda names: self._union([self.vectors([parts[n]]).select("vec_id", "embedding").withColumn("part", F.lit(n)) for n in names])
            index = shards.Ivf.load(self.spark, f"{self.path}/ivf")
            if index is None or not set(index.manifest["parts"]) & set(parts):
                index = shards.Ivf.build(rows(parts)).save(f"{self.path}/ivf", parts=list(parts))
            elif new := [n for n in parts if n not in index.manifest["parts"]]:
                index = index.extend(rows(new), parts=[*index.manifest["parts"], *new])
                index = index.split(most or max(64, 8 * sum(index.manifest["sizes"].values()) // max(1, index.open_cells)))
            if set(index.manifest["parts"]) - set(parts):  # rows of other versions
                index.assigned = index.assigned.filter(F.col("part").isin(*parts))
            self._ivf = index
        return self._ivf

    @staticmethod
    def _union(tables: list[DataFrame]) -> DataFrame:
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return out

    # --- search
    def coarse(self, asked: DataFrame, k: int) -> DataFrame:
        """(query_id, vec_id, score) without shards or cells."""
        mode = self.manifest["compression"]
        rows = self.chunks.withColumn("vec_id", F.col("id"))
        return search.topk(rows, asked, k) if mode == "none" else search.coarse(rows, asked, k, mode)

    def window(self, asked: DataFrame, queries: DataFrame, k: int) -> tuple[DataFrame, bool]:
        """The best k by cosine, or in whole vectors without shards or cells by boosted score; and whether it is the latter."""
        o = self.options
        key = o.shard_key if o.shard_key in (self.chunks.columns if self.chunks is not None else ()) else None
        if key and self.manifest["compression"] != "none":
            centers = self.centers(key)
            if centers.limit(2).count() == 2:
                routed = scratch.written(shards.route(asked, centers, o.margin), "routed")
                found = shards.routed_topk(self.vectors(), asked, routed, k, key, margin=o.margin)
                found = None if found is None else found.drop("rank")
                rest = asked.join(routed.filter("routed IS NULL"), asked["vec_id"] == F.col("query_id")).select("vec_id", "embedding")
                if found is None or rest.limit(1).count():
                    others = (self.ivf().search(rest, k, o.probes) if o.ann == "ivf" else self.coarse(rest, k)).drop("rank")
                    found = others if found is None else found.union(others)
                return found, False
        if o.ann == "ivf":
            return self.ivf().search(asked, k, o.probes).drop("rank"), False
        if self.manifest["compression"] == "none":
            q = queries.join(asked.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id")
            best = hybrid.boosted_topk(self.chunks, self.postings(), self.terms(), q, k)
            return best.drop("rank"), True
        return self.coarse(asked, k).drop("rank"), False

    def search(self, queries: DataFrame, k: int | None = None, *, domain: str | None = None, chunk_type: str | None = None, encoder: Callable[[Column], Column] = hybrid.encoded, scorer: Callable[[Column, Column], Column] | None = hybrid.overlap) -> DataFrame:
        """(query_id, id, text columns, score_cosine, score[, score_reranker], rank) of queries (query_id, text).

        Filters act on the window, each only where it leaves a query something.
        """
        k = k or DEFAULT_K
        rerank = self.options.reranker and scorer is not None
        n = max(3 * k if domain or chunk_type else k, hybrid.RERANK_WINDOW if rerank else 0)
        if not self.count():
            return self.spark.createDataFrame([], "query_id long, id long, score_cosine double, score double, rank int")
        asked = queries.select(F.col("query_id").alias("vec_id"), encoder(F.col("text")).alias("embedding"))
        found, _ = self.window(asked, queries, n)
        found = scratch.written(found.select("query_id", F.col("vec_id").alias("id"), "score"), "window")
        window = hybrid.boosted(found, queries, self.chunks, found.count())
        for column, value in (("domain", domain), ("type", chunk_type)):
            if value and column in window.columns:
                window = hybrid.best_effort(window, F.coalesce(F.col(column) == value, F.lit(False)))
        return hybrid.rerank(window, queries, self.chunks, k, scorer) if rerank else hybrid.ranked(window, k)

    def with_options(self, **changes) -> "Store":
        return Store(self.spark, self.path, self.manifest, replace(self.options, **changes))


def retrieval_confidence(found: DataFrame, queries: DataFrame, by: str = "score") -> DataFrame:
    """(query_id, n_chunks, confidence): the top score of every query, 0 where nothing was found."""
    top = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.max(by).alias("confidence"))
    return queries.select("query_id").join(top, "query_id", "left").select("query_id", F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def open_store(spark: SparkSession, path: str, fallback: Callable[[], Store] | None = None, options: Options = Options()) -> Store | None:
    """The store at ``path``; where there is none, what ``fallback`` ingests, else None.  A store that is there but can't be read is an error, so nothing takes its place."""
    try:
        return Store.load(spark, path, options)
    except NoStore:
        return fallback() if fallback else None


def build_compressed(chunks: DataFrame, path: str, *, least: int = 1, **how) -> Store:
    """The index build job: fails, with nothing written, for fewer than ``least`` chunks."""
    if (n := chunks.limit(least).count()) < least:
        raise RuntimeError(f"only {n} chunks, {least} wanted")
    return Store.save(chunks, path, **how)
