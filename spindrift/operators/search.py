"""Top-k similarity search of a query set against all vectors.

Queries come in blocks of bounded size; a block is broadcast and each partition
keeps a running best k for every query, which it emits once at its end, so what
is shuffled is k rows a query and partition.  The final ranking is by score,
then id.

Vectors are checked where they are scored: a null one, one of another dimension
than the queries, or one with an entry that isn't finite fails the job and names
its id.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries broadcast at once, rows scored at once, and candidate pairs that may be broadcast.
BLOCK, ROWS, BROADCAST_PAIRS = 4096, 4096, 500_000
FACTOR = 16


def matrix(column: pa.Array, ids: np.ndarray, dim: int | None = None) -> np.ndarray:
    """Rows of equal length and finite entries, or a ValueError that names the first other one."""
    if not len(column):
        return np.zeros((0, dim or 0))
    size = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    dim = int(size[0]) if dim is None else dim
    if (bad := np.flatnonzero(size != dim)).size:
        raise ValueError(f"vector {ids[bad[0]]}: {'null' if size[bad[0]] < 0 else f'{size[bad[0]]} entries'} instead of {dim} entries")
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)
    if (bad := np.flatnonzero(~np.isfinite(x).all(axis=1))).size:
        raise ValueError(f"vector {ids[bad[0]]}: an entry is not finite")
    return x


def of_dimension(vector: Column, dim: int) -> Column:
    """The vector itself; the job fails if it is null or has another dimension."""
    return F.when(F.size(F.coalesce(vector, F.array().cast("array<float>"))) == dim, vector).otherwise(F.raise_error(F.lit(f"a vector does not have {dim} entries")).cast("array<float>"))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = np.abs(x).max(axis=1, initial=0)
    by = np.where(top > 0, top / 127.0, 1.0 / 127.0)
    return np.clip(np.rint(x / by[:, None]), -127, 127), by


def packed(x: np.ndarray) -> np.ndarray:
    """Sign bits as 64-bit words; an entry counts as set if it is positive."""
    bits = np.packbits(x > 0, axis=1, bitorder="little")
    return np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view(np.uint64)


def hamming_scores(q: np.ndarray, x: np.ndarray, dim: int) -> np.ndarray:
    """Agreeing bits of packed rows."""
    apart = np.zeros((len(q), len(x)), np.int64)
    for k in range(q.shape[1]):
        apart += np.bitwise_count(q[:, k][:, None] ^ x[:, k][None, :])
    return (dim - apart).astype(np.float64)


def scores(q: np.ndarray, x: np.ndarray, kind: str) -> np.ndarray:
    """Rows of queries, columns of vectors, rounded to six places."""
    if kind == "int8":
        code, by = quantised(x)
        return np.round((q @ code.T) * by[None, :], 6)
    if kind == "binary":
        return hamming_scores(packed(q), packed(x), q.shape[1])
    return np.round(q @ x.T, 6)


class Best:
    """The running best k of each query; ties go to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), -np.inf)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, s: np.ndarray, ids: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Scores of vectors ``ids`` for the queries ``rows`` (all, if not told)."""
        rows = np.arange(len(s)) if rows is None else rows
        if not s.size:
            return
        least, n = self.score[rows, -1], s.shape[1]
        if n > self.k:
            least = np.maximum(least, np.partition(s, n - self.k, axis=1)[:, n - self.k])
        r, c = np.nonzero(s >= least[:, None])  # ties of the k-th best included
        some = np.unique(r)
        own = rows[some]
        of = np.concatenate([np.repeat(some, self.k), r])
        score, ids = np.concatenate([self.score[own].ravel(), s[r, c]]), np.concatenate([self.id[own].ravel(), ids[c]])
        order = np.lexsort((ids, -score, of))
        first = order[np.searchsorted(of[order], some)[:, None] + np.arange(self.k)]
        self.score[own], self.id[own] = score[first], ids[first]

    def batch(self, names: np.ndarray) -> pa.RecordBatch:
        keep = (self.score > -np.inf).ravel()
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(names, self.k)[keep]), pa.array(self.id.ravel()[keep]), pa.array(self.score.ravel()[keep])], names=["query_id", "vec_id", "score"])


FOUND = "query_id long, vec_id long, score double"


def rank(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def topk(corpus: DataFrame, queries: DataFrame, k: int, *, kind: str = "exact", id_col: str = "vec_id", vector_col: str = "embedding", within: str | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank); ``within`` names a column whose value must agree.

    ``kind`` is exact, int8 or binary over vectors, or ``codes`` over the stored
    ``codes`` and ``scale`` of an int8 index, or ``bits`` over stored sign words.
    """
    spark = corpus.sparkSession
    if k <= 0:
        return spark.createDataFrame([], f"{FOUND}, rank int")
    parts = max(1, math.ceil(queries.count() / BLOCK))
    out = None
    for part in range(parts):
        some = queries.filter(F.pmod(F.xxhash64(id_col), F.lit(parts)) == part).orderBy(id_col).select(id_col, vector_col, *([within] if within else []))
        found = _block(corpus, some.collect(), k, kind, id_col, vector_col, within)
        out = found if out is None else out.union(found)
    return rank(out, k)


def _block(corpus: DataFrame, rows: list, k: int, kind: str, id_col: str, vector_col: str, within: str | None) -> DataFrame:
    names = np.array([r[0] for r in rows], np.int64)
    if len({len(r[1]) if r[1] is not None else -1 for r in rows}) > 1:
        raise ValueError("the queries' vectors differ in dimension")
    q = np.array([r[1] for r in rows], np.float64).reshape(len(rows), -1 if rows else 0)
    keys = np.array([r[2] for r in rows]) if within else None
    shared = corpus.sparkSession.sparkContext.broadcast((names, q, keys))
    stored = {"codes": ["codes", "scale"], "bits": ["words"]}.get(kind, [vector_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q, keys = shared.value
        best = Best(len(names), k)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS) if len(names) else ():
                own = batch.slice(at, ROWS)
                ids = own.column(0).to_numpy()
                if kind == "codes":
                    s = np.round((q @ matrix(own.column("codes"), ids, q.shape[1]).T) * own.column("scale").to_numpy()[None, :], 6)
                elif kind == "bits":
                    asked = packed(q)
                    words = own.column("words").flatten().to_numpy().view(np.uint64).reshape(len(ids), -1)
                    s = hamming_scores(asked, words, q.shape[1])
                else:
                    s = scores(q, matrix(own.column(1), ids, q.shape[1]), kind)
                if keys is not None:
                    s = np.where(keys[:, None] == own.column(within).to_numpy(zero_copy_only=False)[None, :], s, -np.inf)
                best.add(s, ids)
        yield best.batch(names)

    return corpus.select(F.col(id_col).cast("long").alias(id_col), *stored, *([within] if within else [])).mapInArrow(run, FOUND)


def topk_where(corpus: DataFrame, asked: list[tuple[int, list, list | None]], k: int, key: str, *, kind: str = "exact", keyless: bool = True, id_col: str = "vec_id", vector_col: str = "embedding", within: DataFrame | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank) of queries (id, vector, key values; null values search everything) among vectors with one of their key values.

    Rows without a key are searched by all, with ``keyless``.  Where no query
    searches everything, the wanted values are a filter on the key, which prunes
    the partitions of a corpus stored by key; ``within`` has the rows that hold
    these values, if the caller has chosen them.  ``asked`` is a bounded block.
    """
    if k <= 0 or not asked:
        return corpus.sparkSession.createDataFrame([], f"{FOUND}, rank int")
    wanted: dict = {}
    for i, (_, _, values) in enumerate(asked):
        for v in values if values is not None else ():
            wanted.setdefault(v, []).append(i)
    everyone = [i for i, a in enumerate(asked) if a[2] is None]
    if within is not None:
        corpus = within
    elif not everyone:
        has = F.col(key).isin(*wanted)
        corpus = corpus.filter(has | F.col(key).isNull() if keyless else has)
    shared = corpus.sparkSession.sparkContext.broadcast((np.array([a[0] for a in asked], np.int64), np.array([a[1] for a in asked], np.float64), wanted, everyone))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q, wanted, everyone = shared.value
        best = Best(len(names), k)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                own = batch.slice(at, ROWS)
                coded = own.column(2).dictionary_encode()
                codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                values = [*coded.dictionary.to_pylist(), None]  # place -1: no key
                ids = own.column(0).to_numpy()
                for c in np.unique(codes).tolist():
                    rows = np.arange(len(names)) if values[c] is None and keyless else np.unique(wanted.get(values[c], []) + everyone).astype(np.int64)
                    if len(rows):
                        here = np.flatnonzero(codes == c)
                        x = matrix(own.column(1).take(pa.array(here)), ids[here], q.shape[1])
                        best.add(scores(q[rows], x, kind), ids[here], rows)
        yield best.batch(names)

    return rank(corpus.select(F.col(id_col).cast("long").alias(id_col), vector_col, key).mapInArrow(run, FOUND), k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def rescored(candidates: DataFrame, corpus: DataFrame, queries: DataFrame, k: int, *, id_col: str = "vec_id", vector_col: str = "embedding", score: Callable[[Column], Column] | None = None, columns: tuple[str, ...] = (), n_pairs: int | None = None) -> DataFrame:
    """The fine stage: scores of candidate pairs only, by joins on ids.

    ``score`` maps the query's vector to a score over the corpus' ``columns``;
    without it, it is the exact product.  Candidates of a known bounded number
    are broadcast, so the corpus is only filtered where it lies.
    """
    q = queries.select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("qv"))
    x = corpus.select(F.col(id_col).alias("vec_id"), *(columns or (F.col(vector_col).alias("xv"),)))
    own = candidates.select("query_id", "vec_id")
    own = F.broadcast(own) if n_pairs is not None and n_pairs <= BROADCAST_PAIRS else own
    value = score(F.col("qv")) if score else dot(F.col("qv"), F.col("xv"))
    return rank(x.join(own, "vec_id").join(q, "query_id").select("query_id", "vec_id", F.round(value, 6).alias("score")), k)


def two_stage(corpus: DataFrame, queries: DataFrame, k: int, factor: int = FACTOR) -> DataFrame:
    """Binary search for ``k * factor`` candidates, then exact scores."""
    return rescored(topk(corpus, queries, k * factor, kind="binary"), corpus, queries, k, n_pairs=queries.count() * k * factor)


def coarse(index: DataFrame, queries: DataFrame, k: int, compression: str, factor: int = FACTOR) -> DataFrame:
    """The coarse stage of a compressed index (codes, scale and, if binary, words): int8 scores, or sign bits for ``k * factor`` and int8 scores of these."""
    if compression == "int8":
        return topk(index, queries, k, kind="codes")
    if compression != "binary":
        raise ValueError(f"no codes are kept in mode {compression}")
    first = topk(index, queries, k * factor, kind="bits")
    return rescored(first, index, queries, k, columns=("codes", "scale"), score=lambda q: dot(q, F.col("codes")) * F.col("scale"), n_pairs=queries.count() * k * factor)


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, recall): the share of exact results found; 1 where there are none."""
    a = approximate.groupBy("query_id").agg(F.collect_set("vec_id").alias("a"))  # k at most
    e = exact.groupBy("query_id").agg(F.collect_set("vec_id").alias("e"))
    share = F.size(F.array_intersect("a", "e")) / F.size("e")
    return e.join(a, "query_id", "left").select("query_id", F.coalesce(share, F.lit(0.0)).alias("recall"))
