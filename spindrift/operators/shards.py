"""Shard centroids, routing with abstention, and clustered (IVF) search over vectors stored by key or cell."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources import scratch
from . import snapshots
from .hybrid import let
from .search import BLOCK, FOUND, ROWS, dot, matrix, recall, topk, topk_where

MARGIN = 0.003
#: Rows that k-means is fitted on at most, chosen by a hash of their id; every row is indexed.
FIT_ROWS = 200_000


def _normal(vector):
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return let(vector, lambda v: let(norm(v), lambda n: F.transform(v, lambda x: x / F.when(n > 0, n).otherwise(1.0))))


def centroids(corpus: DataFrame, key: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(key, n, centroid): normalised means; rows without a key have none."""
    return centers_of(sums(corpus, key, vector_col))


def route(queries: DataFrame, centers: DataFrame, margin: float = MARGIN, id_col: str = "vec_id", vector_col: str = "embedding", top: int = 1) -> DataFrame:
    """(query_id, best, score, second, routed): null ``routed`` abstains, so the query searches everything; with ``top`` over 1 ``routed`` is the array of the best keys and nothing abstains.  There are as many centers as keys."""
    q = queries.select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("qv"))
    pairs = q.join(centers, how="cross").select("query_id", "key", F.round(dot(F.col("qv"), F.col("centroid")), 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    ranked = pairs.withColumns({"rank": F.row_number().over(order), "second": F.lead("score").over(order)})
    if top > 1:
        best = ranked.filter(F.col("rank") <= top).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "key"))).alias("r"))  # ``top`` at most
        return best.select("query_id", F.transform("r", lambda x: x["key"]).alias("routed"))
    sure = F.col("second").isNotNull() & (F.col("score") - F.col("second") >= margin)
    return ranked.filter("rank = 1").select("query_id", F.col("key").alias("best"), "score", "second", F.when(sure, F.col("key")).alias("routed"))


def sums(corpus: DataFrame, key: str, vector_col: str = "embedding") -> DataFrame:
    """(key, n, total): each key's number of vectors and their sum, from one row a key and partition; what is added later is a row of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        kind = None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                own = batch.slice(at, ROWS)
                kind, coded = own.column(0).type, own.column(0).dictionary_encode()
                x = matrix(own.column(1), np.arange(at, at + own.num_rows))
                codes = coded.indices.to_numpy()
                for c, name in enumerate(coded.dictionary.to_pylist()):
                    n, total = held.get(name, (0, 0.0))
                    held[name] = n + int((codes == c).sum()), total + x[codes == c].sum(axis=0)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), kind), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([t.tolist() for _, t in held.values()], pa.list_(pa.float64()))], names=["key", "n", "total"])

    keyed = corpus.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), vector_col)
    return keyed.mapInArrow(run, f"key {corpus.schema[key].dataType.simpleString()}, n long, total array<double>")


def centers_of(parts: DataFrame) -> DataFrame:
    """(key, n, centroid) of ``sums``, of one table or several together."""
    long = parts.select("key", "n", F.posexplode("total").alias("pos", "x"))
    mean = long.groupBy("key", "pos").agg((F.sum("x") / F.sum("n")).alias("m"), F.sum("n").alias("n"))
    wide = mean.groupBy("key").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("v"))  # one vector's entries
    return wide.select("key", "n", _normal(F.transform("v", lambda s: s["m"])).alias("centroid"))


def keyed(corpus: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows whose key is among ``wanted`` (key), by a join that prunes a corpus stored by key, and rows without a key."""
    return corpus.join(wanted.withColumnRenamed("key", key), key, "left_semi").select(corpus.columns).union(corpus.filter(F.col(key).isNull()))


def routed_topk(corpus: DataFrame, queries: DataFrame, routed: DataFrame, k: int, key: str, kind: str = "exact", margin: float = MARGIN) -> DataFrame | None:
    """(query_id, vec_id, score, rank) of the queries that ``routed`` (of ``route``, written) is sure of, each in its shard and the rows without a key; None where there are none."""
    sure = routed.filter(F.col("second").isNotNull() & (F.col("score") - F.col("second") >= margin))
    wanted = sure.select(F.col("best").alias("key")).distinct()
    rows = queries.join(sure, queries.vec_id == F.col("query_id")).select("vec_id", "embedding", "best")
    out = None
    for block in _blocks(rows.orderBy("vec_id")):
        found = topk_where(corpus, [(r[0], r[1], [r[2]]) for r in block], k, key, kind=kind, within=keyed(corpus, key, wanted))
        out = found if out is None else out.union(found)
    return out


def sharded_topk(corpus: DataFrame, queries: DataFrame, k: int, key: str = "label", kind: str = "int8", top: int = 1, margin: float = MARGIN, centers: DataFrame | None = None) -> DataFrame:
    """Searches the routed shards and the rows without a key, or everything where the router abstains.

    ``centers`` are those that are kept with the corpus; without them they are
    computed.  With fewer than two key values there is nothing to route: everything is searched.
    """
    centers = centroids(corpus, key) if centers is None else centers
    if centers.limit(2).count() < 2:
        return topk(corpus, queries, k, kind=kind)
    if top == 1:
        routed = scratch.written(route(queries, centers, margin), "routed")
        out = routed_topk(corpus, queries, routed, k, key, kind, margin)
        rest = queries.join(routed.filter("routed IS NULL"), queries.vec_id == F.col("query_id")).select("vec_id", "embedding")
        if out is None or rest.limit(1).count():
            found = topk(corpus, rest, k, kind=kind)
            out = found if out is None else out.union(found)
        return out
    routed = scratch.written(route(queries, centers, margin, top=top).select("query_id", "routed"), "routed")
    wanted = routed.select(F.explode("routed").alias("key")).distinct()
    rows = queries.join(routed, queries.vec_id == F.col("query_id")).select("vec_id", "embedding", "routed").orderBy("vec_id")
    out = None
    for block in _blocks(rows):
        found = topk_where(corpus, [(r[0], r[1], list(r[2])) for r in block], k, key, kind=kind, within=keyed(corpus, key, wanted))
        out = found if out is None else out.union(found)
    return out if out is not None else corpus.sparkSession.createDataFrame([], f"{FOUND}, rank int")


def compared(corpus: DataFrame, queries: DataFrame, k: int, tops: tuple[int, ...] = (1, 2, 3), key: str = "label", kind: str = "int8", margin: float = MARGIN) -> DataFrame:
    """(top, recall, first, share): for each number of shards searched, the mean recall and share of equal first results against the search of everything, and the share of rows scanned."""
    whole = scratch.written(topk(corpus, queries, k, kind=kind), "whole")
    centers, sizes = scratch.written(centroids(corpus, key), "centers"), corpus.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    sizes = scratch.written(sizes, "sizes")
    q, out = queries.select(F.col("vec_id").alias("query_id")), None
    all_ = sizes.agg(F.sum("n").alias("all"), F.coalesce(F.sum(F.when(F.col("key").isNull(), F.col("n"))), F.lit(0)).alias("keyless"))  # one row
    for top in tops:
        found = scratch.written(sharded_topk(corpus, queries, k, key, kind, top, margin, centers), "found")
        hits = recall(found, whole)
        firsts = whole.filter("rank = 1").select("query_id", F.col("vec_id").alias("best")).join(found.filter("rank = 1").select("query_id", "vec_id"), "query_id", "left")
        routed = route(queries, centers, margin, top=top)
        routed = routed.select("query_id", F.explode("routed").alias("key")) if top > 1 else routed.filter("routed IS NOT NULL").select("query_id", F.col("routed").alias("key"))
        read = routed.join(sizes, "key").groupBy("query_id").agg(F.sum("n").alias("n"))
        share = q.join(read, "query_id", "left").join(all_, how="left").select("query_id", (F.coalesce(F.col("n") + F.col("keyless"), F.col("all")) / F.col("all")).alias("share"))
        told = q.join(hits, "query_id").join(firsts, "query_id").join(share, "query_id").agg(F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg((F.col("vec_id").eqNullSafe(F.col("best"))).cast("double")), 6).alias("first"), F.round(F.avg("share"), 6).alias("share"))
        told = told.select(F.lit(top).cast("long").alias("top"), "recall", "first", "share")
        out = told if out is None else out.union(told)
    return out


def _blocks(rows: DataFrame):
    """Rows in lists of bounded length."""
    held = []
    for r in rows.toLocalIterator():
        held.append(r)
        if len(held) == BLOCK:
            yield held
            held = []
    if held:
        yield held


def scan_bound(sizes: DataFrame, n: int) -> DataFrame:
    """(bound): rows of the ``n`` largest of (cell_id, n): an upper bound of what a search of n cells scans."""
    largest = sizes.orderBy(F.desc("n"), "cell_id").limit(n)
    return largest.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("bound"))


def _assigned(rows: DataFrame, centers: np.ndarray, vector_col: str, id_col: str, retired: list[int] = []) -> DataFrame:
    """``rows`` with the ``cell_id`` of the nearest center that isn't retired."""
    shared = rows.sparkSession.sparkContext.broadcast(centers)  # the square root of the rows at most
    place, name = rows.columns.index(vector_col), rows.columns.index(id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                own = batch.slice(at, ROWS)
                x = matrix(own.column(place), own.column(name).to_numpy(), shared.value.shape[1])
                s = x @ shared.value.T
                s[:, retired] = -np.inf
                cell = s.argmax(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(cell)], names=[*own.schema.names, "cell_id"])

    return rows.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, cell_id int")


def _blocked(sample: DataFrame, vector_col: str, id_col: str) -> DataFrame:
    """(x): the unit vectors of a sample of bounded size, some thousand a row as little-endian 32-bit floats, written for many readings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                own = batch.slice(at, ROWS)
                x = _unit(matrix(own.column(1), own.column(0).to_numpy())).astype("<f4")
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], names=["x"])

    return scratch.written(sample.select(F.col(id_col).cast("long").alias("id"), vector_col).mapInArrow(run, "x binary"), "fit")


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(1e-12, np.linalg.norm(x, axis=1, keepdims=True))


def _fitted(sample: DataFrame, cells: int, iterations: int, seed: int, vector_col: str, id_col: str) -> np.ndarray:
    """Unit centers by k-means with the cosine: a round sums each partition's rows by cell and adds these sums.  ``sample`` is of bounded size."""
    spark = sample.sparkSession
    first = sample.orderBy(F.xxhash64(id_col, F.lit(seed)), id_col).limit(cells).collect()  # as many as cells
    centers = _unit(np.array([r[vector_col] for r in first], np.float64))
    rows = _blocked(sample, vector_col, id_col)

    def summed(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centers = shared.value.astype(np.float32)
            total, n = np.zeros(centers.shape), np.zeros(len(centers), np.int64)
            for batch in batches:
                for block in batch.column(0):
                    x = np.frombuffer(block.as_buffer(), "<f4").reshape(-1, centers.shape[1])
                    cell = (x @ centers.T).argmax(axis=1)
                    order = np.argsort(cell, kind="stable")
                    heads = np.flatnonzero(np.diff(cell[order], prepend=-1))
                    total[cell[order[heads]]] += np.add.reduceat(x[order], heads, axis=0, dtype=np.float64)
                    n += np.bincount(cell, minlength=len(n))
            met = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(met), pa.array([t.tobytes() for t in total[met]], pa.binary())], names=["cell", "total"])

        return run

    for _ in range(iterations):
        total = np.zeros(centers.shape)
        for r in rows.mapInArrow(summed(spark.sparkContext.broadcast(centers)), "cell long, total binary").collect():  # a row a cell and partition of the sample
            total[r.cell] += np.frombuffer(r.total)
        moved = np.where((total != 0).any(axis=1)[:, None], _unit(total), centers)
        settled = np.abs(moved - centers).max(initial=0) < 1e-6
        centers = moved
        if settled:
            break
    return centers


class Ivf:
    """Cells by k-means with the cosine; every row is indexed, and ``save`` stores it by cell.

    A stored index grows: ``extend`` writes new rows to the cells of the centers
    that are there, beside what is stored, and ``split`` takes cells beyond a
    bound apart, writing these anew only.  Both publish a version of the index.
    """

    def __init__(self, assigned: DataFrame, centers: np.ndarray, path: str | None = None, manifest: dict | None = None, id_col: str = "vec_id", vector_col: str = "embedding"):
        self.assigned, self.centers, self.path, self.manifest, self.id_col, self.vector_col = assigned, centers, path, manifest, id_col, vector_col
        self.cells = len(centers)

    @classmethod
    def build(cls, corpus: DataFrame, cells: int | None = None, iterations: int = 10, seed: int = 42, id_col: str = "vec_id", vector_col: str = "embedding") -> "Ivf":
        n = corpus.count()
        cells = max(1, min(n, cells or int(math.sqrt(n))))
        if cells == 1:
            first = corpus.select(vector_col).first()
            return cls(corpus.withColumn("cell_id", F.lit(0)), np.zeros((1, len(first[0]) if first else 0)), id_col=id_col, vector_col=vector_col)
        sample = corpus.select(id_col, vector_col)
        sample = sample if n <= FIT_ROWS else sample.filter(F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(n)) < FIT_ROWS)
        centers = _fitted(sample, cells, iterations, seed, vector_col, id_col)
        return cls(_assigned(corpus, centers, vector_col, id_col), centers, id_col=id_col, vector_col=vector_col)

    @classmethod
    def by_key(cls, corpus: DataFrame, key: str, id_col: str = "vec_id", vector_col: str = "embedding") -> "Ivf":
        """Cells that are there already: the values of ``key`` in order, with their normalised means as centers.  Rows without a key are in no cell."""
        told = scratch.written(centroids(corpus, key, vector_col), "centers")
        n = told.count()
        if n > FIT_ROWS:
            raise ValueError(f"{n} values of {key} are no cells")
        held = told.orderBy("key").collect()  # as many as keys, FIT_ROWS at most
        cells = corpus.sparkSession.createDataFrame([(r.key, i) for i, r in enumerate(held)], f"_key {told.schema['key'].dataType.simpleString()}, cell_id int")
        rows = corpus.join(F.broadcast(cells), F.col(key) == F.col("_key")).drop("_key")
        return cls(rows, np.array([r.centroid for r in held], np.float64).reshape(n, -1), id_col=id_col, vector_col=vector_col)

    # --- stored indexes
    def _put(self, rows: DataFrame) -> tuple[dict, dict[int, int]]:
        """Writes assigned rows as one folder, and returns it with the number of rows of each cell."""
        name = f"cells/{uuid.uuid4().hex}"
        spark = rows.sparkSession
        rows.hint("rebalance", "cell_id").write.partitionBy("cell_id").parquet(f"{self.path}/{name}")
        back = spark.read.schema(rows.schema).parquet(f"{self.path}/{name}")
        return {"name": name, "schema": rows.schema.jsonValue()}, {r.cell_id: r.n for r in back.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n")).collect()}  # as many as cells

    def save(self, path: str, **told) -> "Ivf":
        """Stores the rows by cell and the centers beside them; returns the stored index."""
        spark = self.assigned.sparkSession
        self.path = path
        folder, sizes = self._put(self.assigned)
        return self._published(spark, self.centers, lambda _: {"folders": [folder], "sizes": {str(c): n for c, n in sizes.items()}, "retired": [], "id": self.id_col, "vector": self.vector_col, **told})

    def _published(self, spark: SparkSession, centers: np.ndarray, change) -> "Ivf":
        name = f"centers/{uuid.uuid4().hex}"
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cell_id int, center array<double>").coalesce(1).write.parquet(f"{self.path}/{name}")
        snapshots.advance(spark, self.path, lambda last: change(last) | {"centers": name})
        return Ivf.load(spark, self.path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Ivf | None":
        """The latest version of the stored index; None where there is none."""
        manifest = snapshots.read(spark, path)
        if manifest is None:
            return None
        centers = spark.read.parquet(f"{path}/{manifest['centers']}").orderBy("cell_id").collect()  # as many as cells
        rows = None
        for f in manifest["folders"]:
            own = spark.read.schema(StructType.fromJson(f["schema"])).parquet(f"{path}/{f['name']}")
            own = own.filter(~F.col("cell_id").isin(f["gone"])) if f.get("gone") else own
            rows = own if rows is None else rows.unionByName(own)
        return cls(rows, np.array([r.center for r in centers], np.float64), path, manifest, manifest["id"], manifest["vector"])

    def extend(self, rows: DataFrame, **told) -> "Ivf":
        """The stored index with more rows: these alone are assigned and written."""
        folder, sizes = self._put(_assigned(rows, self.centers, self.vector_col, self.id_col, self.manifest["retired"]))

        def change(last: dict) -> dict:
            return last | {"folders": [*last["folders"], folder], "sizes": {c: last["sizes"].get(c, 0) + sizes.get(int(c), 0) for c in {*last["sizes"], *map(str, sizes)}}, **told}

        return self._published(rows.sparkSession, self.centers, change)

    def split(self, most: int, iterations: int = 8, seed: int = 7) -> "Ivf":
        """The stored index with no cell of more than ``most`` rows, but cells whose rows can't be told apart.  Other cells aren't read."""
        index, stuck = self, set()
        while large := [int(c) for c, n in sorted(index.manifest["sizes"].items()) if n > most and int(c) not in stuck]:
            for cell in large:
                rows = index.assigned.filter(F.col("cell_id") == cell).drop("cell_id")
                n = index.manifest["sizes"][str(cell)]
                sample = rows.select(index.id_col, index.vector_col)
                sample = sample if n <= FIT_ROWS else sample.filter(F.pmod(F.xxhash64(index.id_col, F.lit(seed)), F.lit(n)) < FIT_ROWS)
                two = _fitted(sample, 2, iterations, seed, index.vector_col, index.id_col)
                at = len(index.centers)
                folder, sizes = index._put(_assigned(rows, two, index.vector_col, index.id_col).withColumn("cell_id", (F.col("cell_id") + at).cast("int")))
                if len(sizes) < 2:
                    stuck.add(cell)
                    continue

                def change(last: dict, cell=cell, folder=folder, sizes=sizes) -> dict:
                    old = [f | {"gone": [*f.get("gone", []), cell]} for f in last["folders"]]
                    left = {c: n for c, n in last["sizes"].items() if c != str(cell)}
                    return last | {"folders": [*old, folder], "sizes": left | {str(c): n for c, n in sizes.items()}, "retired": [*last["retired"], cell]}

                index = index._published(rows.sparkSession, np.concatenate([index.centers, two]), change)
        return index

    # --- search
    @property
    def open_cells(self) -> int:
        return self.cells - len(self.manifest["retired"] if self.manifest else [])

    def probes(self, asked: int | None = None) -> int:
        """0 or None is the default: all of four cells, else an eighth."""
        n = self.open_cells
        default = n if n <= 4 else max(1, n // 8)
        return min(n, asked or default)

    def sizes(self) -> DataFrame:
        """(cell_id, n), from what is stored where the index is."""
        if self.manifest is not None:
            spark = self.assigned.sparkSession
            return spark.createDataFrame([(int(c), n) for c, n in self.manifest["sizes"].items()], "cell_id int, n long")
        return self.assigned.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"))

    def order(self, vectors: np.ndarray) -> np.ndarray:
        """Cells of each vector, the nearest first; cells that were taken apart aren't among them."""
        far = np.zeros(self.cells)
        far[self.manifest["retired"] if self.manifest else []] = np.inf
        return np.argsort(far - np.atleast_2d(vectors) @ self.centers.T, axis=1, kind="stable")[:, : self.open_cells]

    def search(self, queries: DataFrame, k: int, probes: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
        """The best cells of each query, and in these the best rows; cells that no query asks for aren't read."""
        n = self.probes(probes)
        out = None
        for block in _blocks(queries.select(id_col, vector_col).orderBy(id_col)):
            cells = self.order(np.array([r[1] for r in block], np.float64))[:, :n].tolist()
            found = topk_where(self.assigned, [(r[0], r[1], c) for r, c in zip(block, cells)], k, "cell_id", keyless=False, id_col=id_col, vector_col=vector_col)
            out = found if out is None else out.union(found)
        return out if out is not None else self.assigned.sparkSession.createDataFrame([], f"{FOUND}, rank int")

    def curve(self, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
        """(probes, recall, read): for every number of probes the share of the exact ``k`` best that it finds, and the share of rows that it reads, over all ``queries``.

        From one exact search: the place of each neighbour's cell in its query's
        order of cells says from how many probes on it is found.  Queries may be
        many; what is gathered is a row a number of probes.  No queries or an
        empty index give no rows.
        """
        spark = self.assigned.sparkSession
        sizes = np.zeros(self.cells, np.int64)
        for r in self.sizes().collect():  # as many as cells
            sizes[r.cell_id] = r.n
        asked = queries.select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("_q"))
        exact = topk(self.assigned.drop("cell_id"), queries, k, id_col=id_col, vector_col=vector_col).select("query_id", "vec_id")
        near = exact.join(self.assigned.select(F.col(self.id_col).alias("vec_id"), "cell_id"), "vec_id").select("query_id", "cell_id")
        # a query once for what it reads (cell -1), and once for each neighbour
        rows = asked.join(near, "query_id").select("query_id", "cell_id", "_q").union(asked.select("query_id", F.lit(-1).alias("cell_id"), "_q"))
        held = spark.sparkContext.broadcast((self.centers, self.manifest["retired"] if self.manifest else [], sizes))  # the square root of the rows at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centers, retired, sizes = held.value
            n = len(centers)
            found, read, gone = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
            gone[retired] = np.inf
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    own = batch.slice(at, ROWS)
                    x = matrix(own.column(2), own.column(0).to_numpy(), centers.shape[1])
                    order = np.argsort(gone - x @ centers.T, axis=1, kind="stable")
                    cell = own.column(1).to_numpy()
                    found += np.bincount((order[cell >= 0] == cell[cell >= 0, None]).argmax(axis=1), minlength=n)
                    read += sizes[order[cell < 0]].sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, n + 1)), pa.array(found), pa.array(read)], names=["probes", "found", "rows"])

        told = rows.mapInArrow(run, "probes long, found long, rows long").groupBy("probes").agg(F.sum("found").alias("found"), F.sum("rows").alias("rows"))
        so_far, all_ = Window.orderBy("probes"), Window.partitionBy()  # over as many rows as cells
        shares = told.select("probes", *[F.round(F.sum(c).over(so_far) / F.sum(c).over(all_), 6).alias(name) for c, name in (("found", "recall"), ("rows", "read"))])
        return shares.filter((F.col("probes") <= self.open_cells) & F.col("recall").isNotNull())

    def tuned(self, sample: DataFrame, k: int, target: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> int:
        """The fewest probes with which ``sample`` queries (a bounded set) find ``target`` of their exact results."""
        asked = {r[0]: np.array(r[1], np.float64) for r in sample.select(id_col, vector_col).limit(BLOCK).collect()}
        if not asked:
            return self.probes()
        exact = topk(self.assigned, sample, k, id_col=id_col, vector_col=vector_col).select("query_id", "vec_id")
        at = exact.join(self.assigned.select(F.col(id_col).alias("vec_id"), "cell_id"), "vec_id").collect()  # k a query
        place = {i: {c: n for n, c in enumerate(self.order(v)[0].tolist(), 1)} for i, v in asked.items()}
        ranks = np.sort([place[r.query_id][r.cell_id] for r in at])
        return int(ranks[min(len(ranks) - 1, math.ceil(target * len(ranks)) - 1)]) if len(ranks) else self.probes()


