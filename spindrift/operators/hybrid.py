"""Lexical boosts, best-effort filters, reranking and the relevance gate over candidate windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOP_GATE, accent_fold, clean_chunk, let, tokens
from ..sources import scratch
from . import search

BOOST, CAP, RERANK_WINDOW, PASSAGE = 0.08, 0.30, 16, 1000
#: Rows that the vector side finds for a query at least, and buckets of tokens by which postings are stored.
NEAR, BUCKETS = 256, 16
GATE, SECOND = 0.84, 0.90
DIM = 64


def encoded(text: Column, dim: int = DIM) -> Column:
    """The offline encoder: token hashes in ``dim`` buckets, of unit length."""
    return encoded_tokens(tokens(text), dim)


def encoded_tokens(own: Column, dim: int = DIM) -> Column:
    """The same of a text's ``tokens``.  A bucket is a character, so counting one is a string operation."""
    if not 0 < dim <= 72:
        raise ValueError("the offline encoder has 1 to 72 buckets")
    at = F.transform(own, lambda t: F.chr(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % dim + 48))
    buckets = F.array(*[F.lit(chr(48 + i)) for i in range(dim)])
    counts = let(F.array_join(at, ""), lambda s: F.transform(buckets, lambda c: (F.length(s) - F.length(F.replace(s, c))).cast("double")))
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    return let(counts, lambda c: let(norm(c), lambda n: F.transform(c, lambda x: x / F.when(n > 0, n).otherwise(1.0))))


#: Columns of a store that are no result.
INTERNAL = ("id", "text", "embedding", "codes", "scale", "words", "tokens")


def gain(hits: Column) -> Column:
    """What shared tokens add to a cosine."""
    return F.least(F.lit(CAP), F.lit(BOOST) * hits)


def boosted(window: DataFrame, queries: DataFrame, corpus: DataFrame, n_pairs: int | None = None) -> DataFrame:
    """``score`` = cosine + min(CAP, BOOST x shared tokens) over (query_id, id, score); the cosine stays as ``score_cosine``.  Only the window's rows are looked into; their tokens are read where the corpus keeps them.  A window of ``n_pairs`` known to be few is broadcast, so the corpus is only filtered where it lies."""
    q = queries.select("query_id", tokens(F.col("text")).alias("qt"))
    own = F.col("tokens") if "tokens" in corpus.columns else tokens(F.col("text"))
    c = corpus.select("id", own.alias("_ct"), *[c for c in corpus.columns if c not in INTERNAL])
    own = window.select("query_id", "id", F.col("score").alias("score_cosine"))
    joined = (F.broadcast(own) if n_pairs is not None and n_pairs <= search.BROADCAST_PAIRS else own).join(c, "id").join(q, "query_id")
    return joined.withColumn("score", F.round(F.col("score_cosine") + gain(F.size(F.array_intersect("qt", "_ct"))), 6)).drop("qt", "_ct")


def postings(chunks: DataFrame, id_col: str = "id") -> DataFrame:
    """(bucket, token, id) of chunks with their ``tokens``: the inverted index."""
    rows = chunks.select(F.explode("tokens").alias("token"), F.col(id_col).alias("id"))
    return rows.select(F.pmod(F.xxhash64("token"), F.lit(BUCKETS)).cast("int").alias("bucket"), "token", "id")


def boosted_topk(corpus: DataFrame, index: DataFrame, terms: DataFrame, queries: DataFrame, k: int, near: int = NEAR) -> DataFrame:
    """(query_id, vec_id, score, rank): the k best of the whole corpus by boosted score, ``score`` being the cosine, for queries (query_id, text, embedding).

    ``corpus`` has (id, embedding, tokens), ``index`` its ``postings``, ``terms``
    (token, n) how many rows hold a token, in one row or several that add up.

    1. The vector side finds the ``near`` best cosines of a query; their tokens
       give a k-th best score t.  No other row has a cosine over the last one's, c.
    2. A row that wasn't found scores c + min(CAP, BOOST x hits) at most.  So it
       needs the least number of hits at which that reaches t; mostly there is
       none, or more than the query has tokens, and the query is done.
    3. For the others the lexical side joins postings.  A row with h of the m
       tokens that occur holds one of the m - h + 1 rarest, so only these are joined.
    """
    near = max(near, 4 * k)
    q = scratch.written(queries.select("query_id", "embedding", tokens(F.col("text")).alias("qt")), "asked")
    rows = corpus.withColumnRenamed("id", "vec_id")
    first = search.topk(rows, q.select(F.col("query_id").alias("vec_id"), "embedding"), near)
    first = scratch.written(first.select("query_id", "vec_id", F.col("score").alias("cosine")), "near")
    pairs = first.count()
    light = F.broadcast(first) if pairs <= search.BROADCAST_PAIRS else first
    known = rows.select("vec_id", "tokens").join(light, "vec_id").join(q.select("query_id", "qt"), "query_id")
    scored = known.select("query_id", "vec_id", "cosine", F.round(F.col("cosine") + gain(F.size(F.array_intersect("qt", "tokens"))), 6).alias("score"))
    scored = scratch.written(scored, "scored")
    found = scored.groupBy("query_id").agg(F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(k - 1)).alias("t"), F.min("cosine").alias("c"), F.count(F.lit(1)).alias("n"))  # ``near`` rows a query
    most = -int(-CAP // BOOST)
    need = F.get(F.filter(F.sequence(F.lit(1), F.lit(most)), lambda h: F.col("c") + gain(h) >= F.col("t") - 2e-6), F.lit(0))
    left = found.filter(F.col("n") == near).join(q, "query_id").withColumn("need", need).filter(F.col("need") <= F.size("qt"))
    sums = terms.groupBy("token").agg(F.sum("n").alias("df"))
    asked = scratch.written(left.select("query_id", "need", F.explode("qt").alias("token")).join(sums, "token"), "lexical")
    if asked.limit(1).count():
        by = Window.partitionBy("query_id")
        rare = asked.withColumns({"at": F.row_number().over(by.orderBy("df", "token")), "m": F.count(F.lit(1)).over(by)}).filter("at <= m - need + 1")
        rare = rare.select("query_id", "token", F.pmod(F.xxhash64("token"), F.lit(BUCKETS)).cast("int").alias("bucket"))
        more = index.join(rare, ["bucket", "token"]).select("query_id", F.col("id").alias("vec_id")).distinct()
        more = more.join(first.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_anti")
        pair = rows.select("vec_id", "tokens", F.col("embedding").alias("xv")).join(more, "vec_id").join(q, "query_id")
        cosine = F.round(search.dot(F.col("embedding"), F.col("xv")), 6)
        late = pair.select("query_id", "vec_id", cosine.alias("cosine"), F.size(F.array_intersect("qt", "tokens")).alias("hits"))
        scored = scored.union(late.select("query_id", "vec_id", "cosine", F.round(F.col("cosine") + gain(F.col("hits")), 6)))
    best = search.rank(scored, k)
    return best.select("query_id", "vec_id", F.col("cosine").alias("score"), "rank")


def best_effort(window: DataFrame, condition: Column) -> DataFrame:
    """Applies the filter to queries of which it leaves a row, and leaves the others alone."""
    n = F.count(F.when(condition, 1)).over(Window.partitionBy("query_id"))
    return window.withColumn("_n", n).filter(condition | (F.col("_n") == 0)).drop("_n")


def ranked(window: DataFrame, k: int, by: str = "score") -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(by), "id")
    return window.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def overlap(q: Column, p: Column) -> Column:
    """The offline scorer: the share of the query's tokens that the passage has."""
    return F.size(F.array_intersect(tokens(q), tokens(p))) / F.greatest(F.lit(1), F.size(tokens(q)))


def load_scorer(load: Callable[[], Callable[[Column, Column], Column]]) -> Callable[[Column, Column], Column] | None:
    """A reranker, or None where it can't be loaded; the caller then keeps the first k, unscored."""
    try:
        return load()
    except (ImportError, OSError, ValueError):
        return None


def rerank(window: DataFrame, queries: DataFrame, corpus: DataFrame, k: int, scorer: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Scores the first RERANK_WINDOW rows of each query anew (passages cut for scoring only) and keeps k."""
    scorer = scorer or overlap
    rows = ranked(window, RERANK_WINDOW).drop("rank").join(queries.select("query_id", F.col("text").alias("_q")), "query_id").join(corpus.select("id", F.substring("text", 1, PASSAGE).alias("_p")), "id")
    return ranked(rows.withColumn("score_reranker", F.round(scorer(F.col("_q"), F.col("_p")), 6)).drop("_q", "_p"), k, "score_reranker")


def gate(window: DataFrame, queries: DataFrame, corpus: DataFrame, least: float = GATE) -> DataFrame:
    """Keeps rows of pure cosine ``least`` or more; drops a query's rows if none of its tokens occurs in the first of them."""
    kept = window.filter(F.col("score_cosine") >= least).join(corpus.select("id", "text"), "id").join(queries.select("query_id", tokens(F.col("text"), STOP_GATE).alias("qt")), "query_id")
    first = F.first("text").over(Window.partitionBy("query_id").orderBy("rank"))
    found = kept.withColumn("_first", accent_fold(first)).filter((F.size("qt") == 0) | F.exists("qt", lambda t: F.contains(F.col("_first"), t)))
    return found.drop("_first", "qt").withColumn("text", clean_chunk(F.col("text")))


def threshold_sweep(best: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, n_pass, n_refused) over (query_id, score_cosine)."""
    rows = best.select("score_cosine", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    passed = F.count(F.when(F.col("score_cosine") >= F.col("threshold"), 1))
    return rows.groupBy("threshold").agg(passed.alias("n_pass"), (F.count(F.lit(1)) - passed).alias("n_refused"))


