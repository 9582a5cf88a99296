"""Hybrid search over saved stores, the gate and their evaluation: all benchmark items ask, documents answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import hybrid, metrics
from ..operators import store as S
from ..sources import scratch
from . import fixtures as fx
from .base import K, example, folded, query, table, token_list

_AT = "list_transform(tk, lambda t: CAST('0x' || substring(md5(t), 1, 8) AS BIGINT) % 64)"
_UNIT = "list_transform(c, lambda v: v / CASE WHEN list_inner_product(c, c) > 0 THEN sqrt(list_inner_product(c, c)) ELSE 1 END)"
_ENCODED = lambda rows: f"SELECT * EXCLUDE (slots, c), {_UNIT} AS v FROM (SELECT *, list_transform(range(0, 64), lambda i: CAST(len(list_filter(slots, lambda b: b = i)) AS DOUBLE)) AS c FROM (SELECT *, {_AT} AS slots FROM ({rows})))"
_BY = lambda score: f"row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, id)"
_CODED = "CASE WHEN list_max(v) > 0 THEN list_max(v) / 127 ELSE 1 / 127::DOUBLE END"
_GAIN = f"least({hybrid.CAP}::DOUBLE, {hybrid.BOOST}::DOUBLE * common)"
_PAIRS = (
    f"WITH d AS ({_ENCODED(f'SELECT doc_id AS id, text, lang AS domain, source AS type, {token_list("text")} AS tk FROM documents')}), "
    f"q AS ({_ENCODED(f'SELECT item_id AS query_id, text AS asked, {token_list("text")} AS tk FROM benchmark')}), "
    f"i AS (SELECT *, list_transform(v, lambda x: round_even(x / sc, 0)) AS code FROM (SELECT *, {_CODED} AS sc FROM d)), "
)
_COSINES = _PAIRS + "p AS (SELECT query_id, id, round(list_inner_product(q.v, d.v), 6) AS score_cosine, domain, type, len(list_intersect(q.tk, d.tk)) AS common FROM q, d), "
_CODES = _PAIRS + "p AS (SELECT query_id, id, round(list_inner_product(q.v, code) * sc, 6) AS score_cosine, domain, type, len(list_intersect(q.tk, i.tk)) AS common FROM q, i), "
_SCORED = f"SELECT query_id, id, score_cosine, domain, type, round(score_cosine + {_GAIN}, 6) AS score"
_WINDOW = lambda n: f"w AS ({_SCORED} FROM (SELECT *, {_BY('score_cosine')} AS r FROM p) WHERE r <= {n}), "
_WHOLE = lambda n: f"w AS (SELECT * EXCLUDE (r) FROM (SELECT *, {_BY('score')} AS r FROM ({_SCORED} FROM p)) WHERE r <= {n}), "
_RANKED = lambda rows, k: f"SELECT * FROM (SELECT *, CAST({_BY('score')} AS INT) AS rank FROM {rows}) WHERE rank <= {k}"
_FILTERED = "f AS (SELECT * EXCLUDE (n) FROM (SELECT *, count(*) FILTER (domain = 'es') OVER (PARTITION BY query_id) AS n FROM w) WHERE domain = 'es' OR n = 0), g AS (SELECT * EXCLUDE (n) FROM (SELECT *, count(*) FILTER (type = 'src1') OVER (PARTITION BY query_id) AS n FROM f) WHERE type = 'src1' OR n = 0) "
_RERANKED = f"t AS (SELECT doc_id AS id, {token_list('text')} AS pt FROM (SELECT doc_id, substring(text, 1, {hybrid.PASSAGE}) AS text FROM documents)), s AS (SELECT w.*, round(len(list_intersect(q.tk, pt)) / CAST(greatest(1, len(q.tk)) AS DOUBLE), 6) AS score_reranker FROM w JOIN t USING (id) JOIN q USING (query_id)) SELECT * FROM (SELECT *, CAST({_BY('score_reranker')} AS INT) AS rank FROM s) WHERE rank <= {K}"
_SWEEP = (0.3, 0.4, 0.5, 0.7, 0.84)
GATE = 0.4


def store(spark, sf, mode="int8", **options):
    """A store of the documents, saved once a session for each state of the table."""
    own = table(spark, sf, "documents")

    def save():
        docs = own.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("domain"), F.col("source").alias("type"))
        if docs.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:  # a few large row groups would be as many tasks
            docs = docs.repartition(spark.sparkContext.defaultParallelism)
        docs = docs.withColumn("tokens", T.tokens(F.col("text")))  # read once for the vector and the store
        return S.Store.save(docs.withColumn("embedding", hybrid.encoded_tokens(F.col("tokens"))), scratch.folder(spark, "chunks"), compression=mode, keys=("domain",), options=S.Options(shard_key=None, reranker=False))

    return scratch.once((spark.sparkContext.applicationId, "documents", mode, scratch.state(own)), save).with_options(**options)


def asked(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(_COSINES + _WHOLE(K) + "z AS (SELECT 1) " + _RANKED("w", K))
def hybrid_topk(spark, sf):
    """Whole vectors: the whole corpus is boosted before the window is cut."""
    return store(spark, sf, "none").search(asked(spark, sf), K).drop("text")


@query(_CODES + _WINDOW(K) + "z AS (SELECT 1) " + _RANKED("w", K))
def hybrid_int8_topk(spark, sf):
    """Codes: the window is cut by cosine, and boosted then."""
    return store(spark, sf).search(asked(spark, sf), K).drop("text")


@query(_CODES + _WINDOW(S.DEFAULT_K) + "z AS (SELECT 1) " + _RANKED("w", S.DEFAULT_K))
def hybrid_default_k(spark, sf):
    return store(spark, sf).search(asked(spark, sf), 0).drop("text")


@query(_CODES + _WINDOW(3 * K) + _FILTERED + _RANKED("g", K))
def filtered_topk_fallback(spark, sf):
    """Both filters act on a window three times as wide, each only where it leaves something."""
    return store(spark, sf).search(asked(spark, sf), K, domain="es", chunk_type="src1").drop("text")


@query(_CODES + _WINDOW(16) + _RERANKED)
def reranked_topk(spark, sf):
    return store(spark, sf, reranker=True).search(asked(spark, sf), K).drop("text")



@query(
    _PAIRS + "e AS (SELECT domain AS key, unnest(range(1, 65)) AS pos, unnest(list_transform(code, lambda x: x * sc)) AS x FROM i WHERE domain IS NOT NULL), m AS (SELECT key, pos, avg(x) AS m FROM e GROUP BY key, pos), "
    "w0 AS (SELECT key, list(m ORDER BY pos) AS v FROM m GROUP BY key), c AS (SELECT key, list_transform(v, lambda a: a / sqrt(list_inner_product(v, v))) AS center FROM w0), "
    "rt AS (SELECT query_id, key, round(list_inner_product(v, center), 6) AS score FROM q, c), r2 AS (SELECT *, row_number() OVER o AS rank, lead(score) OVER o AS second FROM rt WINDOW o AS (PARTITION BY query_id ORDER BY score DESC, key)), "
    "routed AS (SELECT query_id, CASE WHEN score - second >= 0.003 THEN key END AS routed FROM r2 WHERE rank = 1), "
    "p AS (SELECT q.query_id, id, round(CASE WHEN routed IS NULL THEN list_inner_product(q.v, code) * sc ELSE list_inner_product(q.v, list_transform(code, lambda x: x * sc)) END, 6) AS score_cosine, domain, type, len(list_intersect(q.tk, i.tk)) AS common FROM q JOIN routed USING (query_id), i WHERE routed IS NULL OR domain = routed OR domain IS NULL), "
    + _WINDOW(K) + "z AS (SELECT 1) " + _RANKED("w", K)
)
def hybrid_sharded_topk(spark, sf):
    """Confident routes search one shard and the rows without a key, the other queries everything."""
    return store(spark, sf, shard_key="domain").search(asked(spark, sf), K).drop("text")


@query("SELECT CAST(0 AS BIGINT) AS n")
def hybrid_empty_store(spark, sf):
    empty = S.Store.save(table(spark, sf, "documents").limit(0).select(F.col("doc_id").alias("id"), "text", hybrid.encoded(F.col("text")).alias("embedding")), scratch.folder(spark, "chunks"))
    return empty.search(asked(spark, sf), K).agg(F.count(F.lit(1)).alias("n"))


@query(_CODES + _WINDOW(K) + f"b AS ({_RANKED('w', K)}) SELECT item_id AS query_id, count(id) AS n_chunks, coalesce(max(score), 0) AS confidence FROM benchmark LEFT JOIN b ON item_id = query_id GROUP BY item_id")
def retrieval_confidence(spark, sf):
    queries = asked(spark, sf)
    return S.retrieval_confidence(store(spark, sf).search(queries, K), queries)


@query(_CODES + _WINDOW(K) + f"r AS ({_RANKED('w', K)}), g AS (SELECT r.*, first_value(folded) OVER (PARTITION BY query_id ORDER BY rank) AS top FROM r JOIN (SELECT doc_id AS id, {folded('text')} AS folded FROM documents) USING (id) WHERE score_cosine >= {GATE}), t AS (SELECT item_id AS query_id, {token_list('text', T.STOP_GATE)} AS qt FROM benchmark) SELECT g.* EXCLUDE (top) FROM g JOIN t USING (query_id) WHERE len(qt) = 0 OR len(list_filter(qt, lambda x: contains(top, x))) > 0")
def relevance_gate(spark, sf):
    """At a threshold for the offline encoder, whose cosines are lower than a trained one's."""
    s, queries = store(spark, sf), asked(spark, sf)
    return hybrid.gate(s.search(queries, K).drop("text"), queries, s.chunks, GATE).drop("text")


@query(_CODES + _WINDOW(1) + f"b AS ({_RANKED('w', 1)}) SELECT threshold, count(*) FILTER (score_cosine >= threshold) AS n_pass, count(*) FILTER (score_cosine < threshold) AS n_refused FROM b, (SELECT unnest([{', '.join(map(str, _SWEEP))}]::DOUBLE[]) AS threshold) GROUP BY threshold")
def threshold_sweep(spark, sf):
    return hybrid.threshold_sweep(store(spark, sf).search(asked(spark, sf), 1), list(_SWEEP))


def gated(spark):
    """The fixture's rows and questions."""
    rows = fx.frame(spark, fx.GATED, "query_id long, id long, rank int, score double, score_cosine double, text string")
    queries = fx.frame(spark, fx.ASKED, "query_id long, text string")
    return hybrid.gate(rows.drop("text"), queries, rows.select("id", "text")), queries


@example(fx.golden("query_id id text", [(1, 10, "Danube The Danube flows. far . away"), (1, 11, "second"), (4, 15, "the and for"), (5, 16, "DÉBIT du fleuve")]))
def gate_rows(spark, sf):
    """Boosted but far rows go, and so do all of a question whose words the first kept row lacks."""
    return gated(spark)[0].select("query_id", "id", "text")


@example(fx.golden("raw threshold", [("0.9", 0.9), ("x", 0.84), ("2", 0.84), ("", 0.84)]))
def gate_threshold(spark, sf):
    from ..operators.answer import gate_threshold as read

    return fx.frame(spark, [(r, read(r)) for r in ("0.9", "x", "2", "")], "raw string, threshold double")


_OPTIONS = [("plain", {}), ("all", {"reranker": "OFF", "ann": "ivf", "probes": "12", "shard_key": "none"}), ("odd", {"reranker": "maybe", "ann": "tree", "probes": "0", "shard_key": "domain"})]


@example(fx.golden("name reranker ann probes shard_key", [("plain", True, "flat", None, "language"), ("all", False, "ivf", 12, None), ("odd", True, "flat", None, "domain")]))
def store_options(spark, sf):
    found = [(n, S.Options.resolve(o)) for n, o in _OPTIONS]
    return fx.frame(spark, [(n, o.reranker, o.ann, o.probes, o.shard_key) for n, o in found], "name string, reranker boolean, ann string, probes long, shard_key string")


@example(fx.golden("query_id hit", [(1, True), (2, False), (3, False)]))
def hit_at_k(spark, sf):
    return metrics.hit_at_k(fx.frame(spark, fx.FOUND, "query_id long, language string, origin string"), fx.frame(spark, fx.WANTED, "query_id long, language string, keywords array<string>"))
