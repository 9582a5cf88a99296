"""Registered queries over the driver's tables, and the same in SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import annotate, chunks, memory, metrics, search, shards
from ..operators.store import Store
from ..sources import readers, scratch
from . import fixtures as fx
from .base import QUERIES, SQL, K, example, folded, query, slugged, table, token_list

__all__ = ["QUERIES", "SQL", "entry"]


def vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and as queries those whose id is divisible by 100."""
    all_ = table(spark, sf, "embeddings")
    return all_, all_.filter("vec_id % 100 = 0")


# --- vectors and search
_Q = "q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 100 = 0), x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS xv, label FROM embeddings)"
_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank"
_TOP = f"SELECT query_id, vec_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, {_RANK} FROM s) WHERE rank <= {K}"
_CODES = "c AS (SELECT vec_id, label, xv, list_max(list_transform(xv, lambda v: abs(v))) / 127 AS sc FROM x), d AS (SELECT vec_id, label, xv, sc, list_transform(xv, lambda v: round_even(v / sc, 0)) AS code FROM c)"
_EXACT = f"WITH {_Q}, s AS (SELECT query_id, vec_id, round(list_inner_product(qv, xv), 6) AS score FROM q, x) "
_INT8 = f"WITH {_Q}, {_CODES}, s AS (SELECT query_id, vec_id, round(list_inner_product(qv, code) * sc, 6) AS score FROM q, d) "
_BITS = "CAST(len(list_filter(list_zip(qv, xv), lambda p: (p[1] > 0) = (p[2] > 0))) AS DOUBLE)"
_BINARY = f"WITH {_Q}, s AS (SELECT query_id, vec_id, {_BITS} AS score FROM q, x) "
_TWO = f"WITH {_Q}, b AS (SELECT query_id, vec_id, qv, xv, {_BITS} AS score FROM q, x), t AS (SELECT *, {_RANK} FROM b), s AS (SELECT query_id, vec_id, round(list_inner_product(qv, xv), 6) AS score FROM t WHERE rank <= {16 * K}) "


@query(_EXACT + _TOP)
def exact_topk(spark, sf):
    return search.topk(*vectors(spark, sf), K)


@query(_INT8 + _TOP)
def int8_topk(spark, sf):
    return search.topk(*vectors(spark, sf), K, kind="int8")


@query(_BINARY + _TOP)
def binary_topk(spark, sf):
    return search.topk(*vectors(spark, sf), K, kind="binary")


@query(_TWO + _TOP)
def two_stage_topk(spark, sf):
    return search.two_stage(*vectors(spark, sf), K)


def _recall_sql(approx: str) -> str:
    return f"WITH a AS ({approx}{_TOP}), e AS ({_EXACT}{_TOP}) SELECT e.query_id, count(a.vec_id) / CAST(count(*) AS DOUBLE) AS recall FROM e LEFT JOIN a ON a.query_id = e.query_id AND a.vec_id = e.vec_id GROUP BY e.query_id"


@query(_recall_sql(_INT8))
def recall_int8(spark, sf):
    return search.recall(int8_topk(spark, sf), exact_topk(spark, sf))


@query(_recall_sql(_BINARY))
def recall_binary(spark, sf):
    return search.recall(binary_topk(spark, sf), exact_topk(spark, sf))


@query(_recall_sql(_TWO))
def recall_two_stage(spark, sf):
    return search.recall(two_stage_topk(spark, sf), exact_topk(spark, sf))


@query(f"WITH {_Q}, {_CODES} SELECT vec_id, round(sc, 9) AS scale, array_to_string(list_transform(code, lambda v: CAST(v AS INT)), ',') AS codes FROM d")
def int8_codes(spark, sf):
    rows = table(spark, sf, "embeddings").withColumn("by", V.scale(F.col("embedding")))  # not ``scale``: a lambda would take the rounded one below
    return rows.select("vec_id", F.round("by", 9).alias("scale"), F.array_join(V.codes(F.col("embedding"), F.col("by")).cast("array<string>"), ",").alias("codes"))


@query("WITH m AS (SELECT max(list_max(list_transform(CAST(embedding AS DOUBLE[]), lambda v: abs(v)))) / 127 AS sc FROM embeddings) SELECT vec_id, array_to_string(list_transform(CAST(embedding AS DOUBLE[]), lambda v: CAST(round_even(v / sc, 0) AS INT)), ',') AS codes FROM embeddings, m")
def int8_global_codes(spark, sf):
    rows = table(spark, sf, "embeddings")
    by = F.broadcast(rows.agg((F.max(F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))) / 127.0).alias("by")))  # one row
    return rows.join(by).select("vec_id", F.array_join(V.codes(F.col("embedding"), F.col("by")).cast("array<string>"), ",").alias("codes"))


@query(f"WITH {_Q}, {_CODES} SELECT vec_id, round(list_max(list_transform(list_zip(xv, code), lambda p: abs(p[1] - p[2] * sc))) / sc, 6) <= 0.5 AS within FROM d")
def dequantize_error(spark, sf):
    rows = table(spark, sf, "embeddings").withColumn("by", V.scale(F.col("embedding"))).withColumn("code", V.codes(F.col("embedding"), F.col("by")))
    error = F.array_max(F.zip_with("embedding", V.dequantised(F.col("code"), F.col("by")), lambda a, b: F.abs(a.cast("double") - b)))
    return rows.select("vec_id", (F.round(error / F.col("by"), 6) <= 0.5).alias("within"))


@query("SELECT vec_id, CAST(list_sum(list_transform(embedding, lambda v: CASE WHEN v > 0 THEN 1 ELSE 0 END)) AS INT) AS bits FROM embeddings")
def sign_bits(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.bit_count(V.sign_words(F.col("embedding"), 64)[0]).cast("int").alias("bits"))


@query("SELECT count(*) AS n, CAST(sum(len(embedding)) * 4 AS BIGINT) AS float_bytes, CAST(sum(len(embedding)) + 4 * count(*) AS BIGINT) AS int8_bytes, CAST(sum(ceil(len(embedding) / 8)) AS BIGINT) AS binary_bytes FROM embeddings")
def index_footprint(spark, sf):
    d = F.size("embedding")
    return table(spark, sf, "embeddings").agg(F.count(F.lit(1)).alias("n"), (F.sum(d) * 4).alias("float_bytes"), (F.sum(d) + 4 * F.count(F.lit(1))).alias("int8_bytes"), F.sum(F.ceil(d / 8)).alias("binary_bytes"))


_CENTER = "e AS (SELECT label AS key, unnest(range(1, 65)) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings WHERE label IS NOT NULL), m AS (SELECT key, pos, avg(x) AS m, count(*) AS n FROM e GROUP BY key, pos), w AS (SELECT key, max(n) AS n, list(m ORDER BY pos) AS v FROM m GROUP BY key), centers AS (SELECT key, n, list_transform(v, lambda a: a / sqrt(list_inner_product(v, v))) AS centroid FROM w)"


@query(f"WITH {_CENTER} SELECT key, n, round(list_sum(centroid), 6) AS total FROM centers")
def shard_centroids(spark, sf):
    return shards.centroids(table(spark, sf, "embeddings")).select("key", "n", F.round(F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


_ROUTE = f"WITH {_Q}, {_CENTER}, p AS (SELECT query_id, key, round(list_inner_product(qv, centroid), 6) AS score FROM q, centers), r AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS second FROM p WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, key)), routed AS (SELECT query_id, key AS best, score, second, CASE WHEN score - second >= 0.003 THEN key END AS routed FROM r WHERE rank = 1)"


@query(_ROUTE + " SELECT * FROM routed")
def shard_route(spark, sf):
    all_, q = vectors(spark, sf)
    return shards.route(q, shards.centroids(all_))


@query(_ROUTE + f", {_CODES}, s AS (SELECT q.query_id, vec_id, round(list_inner_product(qv, code) * sc, 6) AS score FROM q JOIN routed USING (query_id), d WHERE routed IS NULL OR routed = label OR label IS NULL) {_TOP}")
def sharded_topk(spark, sf):
    return shards.sharded_topk(*vectors(spark, sf), K)


def _ivf(spark, sf):
    """The index, stored by cell; probes are tuned on queries other than those asked."""
    rows = table(spark, sf, "embeddings")
    index = shards.Ivf.build(rows).save(scratch.folder(spark, "ivf"))
    return index, index.tuned(rows.filter("vec_id % 100 = 50"), K)


@query()
def ivf_topk(spark, sf):
    index, probes = _ivf(spark, sf)
    return index.search(vectors(spark, sf)[1], K, probes)


@query(_EXACT + _TOP)
def ivf_all_cells(spark, sf):
    index, _ = _ivf(spark, sf)
    return index.search(vectors(spark, sf)[1], K, index.cells)


@query("SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS bound FROM (SELECT count(*) AS n FROM embeddings GROUP BY label ORDER BY n DESC LIMIT 3)")
def ivf_scan_bound(spark, sf):
    return shards.scan_bound(table(spark, sf, "embeddings").groupBy(F.col("label").alias("cell_id")).agg(F.count(F.lit(1)).alias("n")), 3)


@query(fx.golden("setting recall", [(10, 1.0)]))
def probe_sweep(spark, sf):
    """Ten cells of ten: everything is found."""
    all_, q = vectors(spark, sf)
    index = shards.Ivf.build(all_, cells=10)
    return metrics.sweep(search.topk(all_, q, K), lambda n: index.search(q, K, n), [index.cells])


_CURVE = (
    "p AS (SELECT query_id, key, n, row_number() OVER (PARTITION BY query_id ORDER BY list_inner_product(qv, centroid) DESC, key) AS probes FROM q, centers), "
    f"s AS (SELECT query_id, vec_id, label, round(list_inner_product(qv, xv), 6) AS score FROM q, x), t AS (SELECT *, {_RANK} FROM s WHERE label IS NOT NULL), "
    f"h AS (SELECT probes, count(vec_id) AS found, sum(n) AS n FROM (SELECT p.probes, p.query_id, any_value(p.n) AS n, NULL AS vec_id FROM p GROUP BY ALL UNION ALL SELECT p.probes, t.query_id, 0, t.vec_id FROM t JOIN p ON p.query_id = t.query_id AND p.key = t.label WHERE t.rank <= {K}) GROUP BY probes) "
    "SELECT probes, round(sum(found) OVER w / sum(found) OVER (), 6) AS recall, round(sum(n) OVER w / sum(n) OVER (), 6) AS read FROM h WINDOW w AS (ORDER BY probes)"
)


@query(f"WITH {_Q}, {_CENTER}, {_CURVE}")
def probe_curve(spark, sf):
    """Recall and rows read for every number of probed cells, the labels being the cells."""
    all_, q = vectors(spark, sf)
    return shards.Ivf.by_key(all_, "label").curve(q, K)


# --- stores
def _vector_store(spark, sf, mode, rows=None):
    rows = table(spark, sf, "embeddings") if rows is None else rows
    return Store.save(rows.select(F.col("vec_id").alias("id"), F.concat(F.lit("vector "), F.col("vec_id")).alias("text"), "label", "embedding"), scratch.folder(spark, "store"), compression=mode)


@query(_INT8 + _TOP)
def store_int8_topk(spark, sf):
    """Over the codes of a saved store."""
    store = Store.load(spark, _vector_store(spark, sf, "int8").path)
    return store.coarse(vectors(spark, sf)[1], K)


@query(f"WITH {_Q}, {_CODES}, b AS (SELECT query_id, vec_id, {_BITS} AS score FROM q, x), t AS (SELECT query_id, vec_id FROM (SELECT *, {_RANK} FROM b) WHERE rank <= {16 * K}), s AS (SELECT query_id, vec_id, round(list_inner_product(qv, code) * sc, 6) AS score FROM t JOIN q USING (query_id) JOIN d USING (vec_id)) {_TOP}")
def binary_int8_topk(spark, sf):
    """Over the bits and codes of a saved store."""
    store = Store.load(spark, _vector_store(spark, sf, "binary").path)
    return store.coarse(vectors(spark, sf)[1], K)


@query("SELECT count(*) AS n, CAST(4 * 64 * count(*) AS BIGINT) AS float_bytes, CAST(68 * count(*) AS BIGINT) AS int8_bytes, CAST(8 * count(*) AS BIGINT) AS binary_bytes, CAST(2 AS BIGINT) AS version FROM embeddings")
def store_append(spark, sf):
    rows = table(spark, sf, "embeddings")
    store = _vector_store(spark, sf, "binary", rows.filter("vec_id % 3 = 0")).append(rows.filter("vec_id % 3 <> 0").select(F.col("vec_id").alias("id"), F.lit("more").alias("text"), "label", "embedding"))
    return store.footprint().withColumn("version", F.lit(store.manifest["version"]).cast("long"))


@query(f"WITH {_Q}, s AS (SELECT 0 AS query_id, vec_id, round(list_inner_product(qv, xv) / sqrt(list_inner_product(qv, qv) * list_inner_product(xv, xv)), 6) AS score FROM (SELECT qv FROM q WHERE query_id = 100), x) SELECT vec_id AS id, 'v' || vec_id AS content, score AS similarity FROM (SELECT *, {_RANK} FROM s) WHERE rank <= {K}")
def remote_topk(spark, sf):
    rows = table(spark, sf, "embeddings")
    asked = rows.filter("vec_id = 100").first().embedding
    remote = rows.select(F.col("vec_id").alias("id"), F.concat(F.lit("v"), F.col("vec_id")).alias("content"), "embedding", F.lit("{}").alias("metadata"))
    return readers.remote_topk(remote, asked, K).drop("metadata")


@query("SELECT count(*) AS n FROM embeddings")
def remote_count(spark, sf):
    return table(spark, sf, "embeddings").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_Q}, {_CENTER}, p AS (SELECT query_id, key, round(list_inner_product(qv, centroid), 6) AS score FROM q, centers), r AS (SELECT query_id, key FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM p) WHERE rank <= 2), {_CODES}, s AS (SELECT r.query_id, vec_id, round(list_inner_product(qv, code) * sc, 6) AS score FROM r JOIN q USING (query_id) JOIN d ON d.label = r.key UNION SELECT q.query_id, vec_id, round(list_inner_product(qv, code) * sc, 6) FROM q, d WHERE label IS NULL) {_TOP}")
def sharded_top2(spark, sf):
    return shards.sharded_topk(*vectors(spark, sf), K, top=2)


_KEYS = f"{_CENTER}, p AS (SELECT query_id, key, round(list_inner_product(qv, centroid), 6) AS score FROM q, centers), o AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS second FROM p WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, key))"
_ROUTED = f"t AS (SELECT 1 AS top, query_id, key FROM o WHERE r = 1 AND score - second >= {shards.MARGIN} UNION ALL SELECT top, query_id, key FROM o, (VALUES (2), (3)) AS n(top) WHERE r <= top), b AS (SELECT top, query_id FROM q, (VALUES (1), (2), (3)) AS n(top))"
_SCANS = "al AS (SELECT query_id, vec_id, label, round(list_inner_product(qv, code) * sc, 6) AS score FROM q, d), fs AS (SELECT b.top, al.* FROM b JOIN al USING (query_id) WHERE al.label IS NULL OR NOT EXISTS (SELECT 1 FROM t WHERE t.top = b.top AND t.query_id = b.query_id) OR EXISTS (SELECT 1 FROM t WHERE t.top = b.top AND t.query_id = b.query_id AND t.key = al.label))"
_AGAINST = f"fr AS (SELECT *, row_number() OVER (PARTITION BY top, query_id ORDER BY score DESC, vec_id) AS rank FROM fs), er AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM al), mt AS (SELECT f.top, f.query_id, count(*) FILTER (f.rank <= {K} AND e.rank <= {K}) / CAST(least({K}, max(e.n)) AS DOUBLE) AS recall, CAST(bool_or(f.rank = 1 AND e.rank = 1) AS INT) AS first, count(*) / CAST(max(e.n) AS DOUBLE) AS share FROM fr f JOIN (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM er) e USING (query_id, vec_id) GROUP BY ALL)"


@query(f"WITH {_Q}, {_KEYS}, {_ROUTED}, {_CODES}, {_SCANS}, {_AGAINST} SELECT CAST(top AS BIGINT) AS top, round(avg(recall), 6) AS recall, round(avg(first), 6) AS first, round(avg(share), 6) AS share FROM mt GROUP BY top")
def sharded_compared(spark, sf):
    """Searches of one, two and three shards against that of everything."""
    return shards.compared(*vectors(spark, sf), K)


def _trap(spark):
    return fx.frame(spark, fx.TRAP, "vec_id long, embedding array<double>, label string")


@example(fx.golden("vec_id query_id rank", [(1, 1, 1), (2, 1, 2), (30, 1, 5), (3, 1, 3), (4, 1, 4)]))
def shard_trap(spark, sf):
    """The vector of the other shard that lies on the axis isn't found; the one without a key is."""
    rows = _trap(spark)
    q = fx.frame(spark, [(1, [1.0, 0.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    found = shards.sharded_topk(rows.filter("vec_id <> 5"), q, K, kind="exact")
    return found.select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"))


@example(fx.golden("query_id vec_id rank", [(1, 20, 1)]))
def shard_trap_full(spark, sf):
    """A search of everything finds it first."""
    q = fx.frame(spark, [(1, [1.0, 0.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    rows = _trap(spark).withColumn("embedding", F.transform("embedding", lambda x: x / F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, y: a + y * y))))
    return search.topk(rows, q, 1).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"))


# --- text
@query(f"SELECT doc_id, md5({folded('text')}) AS folded FROM documents")
def accent_fold(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.accent_fold(F.coalesce("text", F.lit("")))).alias("folded"))


@query(f"SELECT page_id, md5({folded('html')}) AS folded FROM pages")
def accent_fold_all(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(T.accent_fold(F.coalesce("html", F.lit("")))).alias("folded"))


@query(f"SELECT doc_id, array_to_string({token_list('text')}, ' ') AS tokens FROM documents")
def token_set(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.tokens(F.col("text")), " ").alias("tokens"))


@query(f"SELECT doc_id, array_to_string({token_list('text', T.STOP_GATE)}, ' ') AS tokens FROM documents")
def gate_token_set(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.tokens(F.col("text"), T.STOP_GATE), " ").alias("tokens"))


@query(f"SELECT doc_id, {slugged('text')} AS slug FROM documents")
def slug(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.slug(F.col("text")).alias("slug"))


_LABELS = [(1, "l'École  Normale"), (2, "  "), (3, "a-b c a-b"), (4, "Øre été")]


@example(fx.golden("id candidates", [(1, "l_ecole_normale|l_ecole|normale"), (2, ""), (3, "a_b_c_a_b|a_b|c"), (4, "re_ete|re|ete")]))
def slug_candidates(spark, sf):
    return fx.frame(spark, _LABELS, "id long, t string").select("id", F.array_join(T.slug_candidates(F.col("t")), "|").alias("candidates"))


_WS = "[ \\t\\n\\x0b\\f\\r]"


@query(f"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}+'), lambda s: s <> '')) AS INT) AS n FROM documents")
def token_estimate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("n"))


_FLAT = f"trim(regexp_replace(text, '{_WS}+', ' ', 'g'))"


def _posed(expression: str, column: str) -> str:
    return f"SELECT doc_id, CAST(unnest(range(len(ss))) AS INT) AS pos, unnest(ss) AS {column} FROM (SELECT doc_id, list_filter({expression}, lambda s: s <> '') AS ss FROM documents WHERE text IS NOT NULL)"


@query(_posed(f"string_split(regexp_replace({_FLAT}, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1))", "sentence"))
def sentences(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


@query(_posed(f"list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?]){_WS}+', '\\1' || chr(1), 'g'), chr(1) || '(\\P{{Lu}}|$)', chr(2) || '\\1', 'g'), chr(1)), lambda s: length(trim(replace(s, chr(2), ' '))))", "n").replace("s <> ''", "s > 0"))
def strict_sentences(spark, sf):
    """The lengths of strict sentences; white space before one that isn't split off counts as one character."""
    one = F.regexp_replace("text", r"([.!?])[ \t\n\x0b\f\r]+", "$1 ")
    return table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", F.posexplode(F.transform(T.strict_sentences(one), lambda s: F.length(s).cast("long"))).alias("pos", "n"))


@query("SELECT doc_id, 'py' AS lang, text || chr(10) AS code FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, '', 'x = 1' || chr(10) FROM documents WHERE text IS NOT NULL")
def code_blocks(spark, sf):
    fenced = F.concat(F.lit("see\n```Py title\n"), F.col("text"), F.lit("\n```\nand\n```\nx = 1\n```"))
    return table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", F.inline(T.code_blocks(fenced)))


_MARKED = [(1, "# Head\n\nText with [a link](http://x) and `code`.\n- item one\n```\nfence\n```\nend"), (2, "##  Two  ## inline ... dots.. x"), (3, None)]


@example(fx.golden("id plain", [(1, "Head\n\nText with a link and code.\nitem one\n \nend"), (2, "Two  ## inline ... dots.. x"), (3, None)]))
def plain_markdown(spark, sf):
    return fx.frame(spark, _MARKED, "id long, t string").select("id", T.plain_markdown(F.col("t")).alias("plain"))


@example(fx.golden("id shown", [(1, "Head Text with [a link](http://x) and `code`. - item one ``` fence ``` end"), (2, "Two. inline . dots. x"), (3, None)]))
def clean_chunk(spark, sf):
    return fx.frame(spark, _MARKED, "id long, t string").select("id", T.clean_chunk(F.col("t")).alias("shown"))


@example(fx.golden("id title body", [("web/css/x", "Grid & flow", "Use `grid` or `div` with care."), ("web/api/y", "", "no head\nbody"), ("learn/z", "", "text")]))
def web_page(spark, sf):
    return fx.frame(spark, fx.WEB, "id string, t string").select("id", T.web_page(F.col("t")).alias("p")).select("id", "p.*")


@example(fx.golden("id title body", [("a", "Run it", "Keep calm.\nend"), ("b", "", "plain {{ kept }}")]))
def container_page(spark, sf):
    return fx.frame(spark, fx.CONTAINER, "id string, t string").select("id", T.container_page(F.col("t")).alias("p")).select("id", "p.*")


@example(fx.golden("id clean", [(1, "NAME bold"), (2, "plain")]))
def overstrike(spark, sf):
    return fx.frame(spark, [(1, "N\bNA\bAM\bME\bE _\bb_\bo_\bl_\bd"), (2, "plain")], "id long, t string").select("id", T.no_overstrike(F.col("t")).alias("clean"))


@example(fx.golden("name area manual", [("git-log", "git-log", "git"), ("web/API", "javascript", "shell"), ("bash", "bash", "bash"), ("bash-x", "bash-x", "shell"), ("web/css", "css", "shell")]))
def source_language(spark, sf):
    rows = fx.frame(spark, [("git-log",), ("web/API",), ("bash",), ("bash-x",), ("web/css",)], "name string")
    return rows.select("name", T.area_language(F.col("name"), readers.AREAS).alias("area"), T.manual_language(F.col("name"), readers.MANUALS).alias("manual"))


@example(fx.golden("model canonical prefix", [("all-MiniLM", "sentence-transformers/all-MiniLM", ""), ("x/multilingual-e5-small", "x/multilingual-e5-small", "query: "), ("e5-base", "sentence-transformers/e5-base", "query: "), ("love5-base", "sentence-transformers/love5-base", "")]))
def model_names(spark, sf):
    names = ["all-MiniLM", "x/multilingual-e5-small", "e5-base", "love5-base"]
    return fx.frame(spark, [(n, T.canonical_model(n), T.prompt_prefix(n, "query")) for n in names], "model string, canonical string, prefix string")


@query("SELECT conv_id, turn, CASE WHEN s = '' THEN 'default' ELSE s END AS session FROM (SELECT conv_id, turn, substring(regexp_replace(coalesce(text, ''), '[^\\p{L}\\p{N}._-]', '', 'g'), 1, 128) AS s FROM conversations)")
def session_ids(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.session_id(F.col("text")).alias("session"))


@query("SELECT doc_id, CAST(len(list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '\\p{L}+'), lambda w: length(w) > 4))) AS INT) AS n FROM documents")
def significant_words(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(T.significant_words(F.col("text"))).alias("n"))


@example(fx.golden("version", [("3.12",)]))
def newest_version(spark, sf):
    return readers.newest_stable(fx.frame(spark, [("3.9",), ("3.12",), ("3.13rc1",), ("2.99",), ("x",)], "version string"))


_DEMO = {"science": ("tion", "ment", "logie"), "language": ("ing", "eur", "keit"), "place": ("land", "ville", "stadt")}
_FOLD = folded("text")


_COUNT = lambda cues: " + ".join(f"CAST(contains({_FOLD}, '{c}') AS INT)" for c in cues)
_DOMAINS = "SELECT doc_id, {} FROM documents".format(", ".join(f"{_COUNT(c)} AS {d}" for d, c in _DEMO.items()))


@query(f"SELECT doc_id, CASE WHEN greatest(science, language, place) < 2 THEN 'general' WHEN science >= language AND science >= place THEN 'science' WHEN language >= place THEN 'language' ELSE 'place' END AS domain FROM ({_DOMAINS})")
def domain_tag(spark, sf):
    return table(spark, sf, "documents").select("doc_id", annotate.domain(F.lit(""), F.col("text"), _DEMO).alias("domain"))


@query(f"SELECT doc_id, CASE WHEN science > language AND science > place THEN 'science' WHEN language > science AND language > place THEN 'language' WHEN place > science AND place > language THEN 'place' END AS hint FROM ({_DOMAINS})")
def domain_hint(spark, sf):
    return table(spark, sf, "documents").select("doc_id", annotate.domain_hint(F.col("text"), _DEMO).alias("hint"))


@query(f"SELECT source AS name, CASE WHEN contains(lower(source), 'science') OR s >= 2 AND s >= l AND s >= p THEN 'science' WHEN contains(lower(source), 'language') OR l >= 2 AND l >= p THEN 'language' WHEN contains(lower(source), 'place') OR p >= 2 THEN 'place' ELSE 'general' END AS domain, count(*) AS n FROM (SELECT source, {_COUNT(_DEMO['science'])} AS s, {_COUNT(_DEMO['language'])} AS l, {_COUNT(_DEMO['place'])} AS p FROM documents) GROUP BY ALL")
def file_domains(spark, sf):
    """Chunks of each file and domain, as the ingest job counts them."""
    from ..sources.ingest import file_counts as counts

    rows = table(spark, sf, "documents").select(F.col("source").alias("name"), annotate.domain(F.col("source"), F.col("text"), _DEMO).alias("domain"), F.lit("").alias("type"))
    return counts(rows).drop("type")


_LOW = lambda cues, by=" + ": by.join(f"CAST(contains(lower(coalesce(text, '')), '{c}') AS INT)" for c in cues)


@query(f"SELECT doc_id, CASE WHEN {_LOW(annotate.COMPARE)} >= 2 THEN 'comparison' WHEN {_LOW(annotate.DEFINE)} > 0 THEN 'definition' WHEN {_LOW(annotate.EXAMPLE)} > 0 THEN 'example' WHEN length(text) > 200 THEN 'explanation' ELSE 'fact' END AS kind FROM documents")
def chunk_type(spark, sf):
    return table(spark, sf, "documents").select("doc_id", annotate.chunk_type(F.col("text")).alias("kind"))


@query("SELECT doc_id, round(least(1.0, 0.5 + CASE WHEN h >= 3 THEN 0.2 WHEN h >= 1 THEN 0.1 ELSE 0 END + CASE WHEN n > 500 AND n < 10000 THEN 0.1 ELSE 0 END + CASE WHEN contains(t, '```') THEN 0 ELSE 0.05 END), 6)::DOUBLE AS confidence FROM (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, len(regexp_extract_all(coalesce(text, ''), '(?m)^#{1,6} ')) AS h FROM documents)")
def source_confidence(spark, sf):
    return table(spark, sf, "documents").select("doc_id", annotate.confidence(F.col("text")).alias("confidence"))


# --- sessions, routing, labels, events
@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3")
def session_last_n(spark, sf):
    return memory.last_turns(table(spark, sf, "conversations"), 3).select("conv_id", "turn", "role")


@query("SELECT conv_id, turn_count, coalesce(summary, '') AS summary FROM (SELECT conv_id, count(*) AS turn_count FROM conversations GROUP BY conv_id) LEFT JOIN (SELECT conv_id, string_agg(substring(text, 1, 100), ' | ' ORDER BY turn) AS summary FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role = 'user') WHERE r <= 5 GROUP BY conv_id) USING (conv_id)")
def session_condense(spark, sf):
    return memory.condensed(table(spark, sf, "conversations"))


@query("SELECT conv_id, substring(trim(arg_max(text, turn)), 1, 4000) AS query FROM conversations WHERE role = 'user' AND trim(text) <> '' GROUP BY conv_id")
def last_user_turn(spark, sf):
    return memory.last_user_query(table(spark, sf, "conversations"))


_ANY = lambda cues: "(" + " OR ".join(f"contains({_FOLD}, '{c}')" for c in cues) + ")"


@query(f"SELECT conv_id, turn, CASE WHEN contains(text, '```') THEN 'code' WHEN {_ANY(annotate.GREET)} THEN 'conversation' WHEN {_ANY(annotate.CREATE)} THEN 'creative' WHEN {_ANY(annotate.REASON)} THEN 'reasoning' WHEN {_ANY(('?', 'what', 'who', 'when', 'where', 'quel', 'qui ', 'wer ', 'wo '))} THEN 'factual' ELSE 'conversation' END AS kind FROM conversations WHERE role = 'user'")
def route_queries(spark, sf):
    return table(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", annotate.query_type(F.col("text")).alias("kind"))


@query("SELECT doc_id, toxic, CASE WHEN r <= greatest(1, round_even(n * 0.2, 0)) THEN 'val' ELSE 'train' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY md5('42:' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY toxic) AS n FROM labels)")
def stratified_split(spark, sf):
    return metrics.stratified_split(table(spark, sf, "labels"), "toxic", "doc_id").select("doc_id", "toxic", "split")


@query("SELECT toxic, count(*) AS n FROM labels GROUP BY toxic")
def class_balance(spark, sf):
    return metrics.class_balance(table(spark, sf, "labels"), "toxic")


@query("SELECT event_type, count(*) AS n, round(median(value), 6) AS median, round(avg(value), 6) AS mean, max(value) AS max, bool_and(value < 1000) AS all_under FROM events GROUP BY event_type")
def latency_summary(spark, sf):
    return metrics.latency_summary(table(spark, sf, "events"), "value", "event_type")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def usage_counters(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


@query("SELECT lang, CAST(grouping(lang) AS INT) AS is_total, round(avg(CAST(coalesce(lang = guess, false) AS INT)), 6) AS accuracy, count(*) AS n FROM (SELECT lang, CASE WHEN contains(lower(text), ' the ') THEN 'en' WHEN contains(lower(text), ' der ') THEN 'de' WHEN contains(lower(text), ' les ') THEN 'fr' ELSE 'es' END AS guess FROM documents) GROUP BY ROLLUP (lang)")
def class_accuracy(spark, sf):
    """Of a rule that guesses languages by one word."""
    low = F.lower("text")
    guess = F.when(low.contains(" the "), "en").when(low.contains(" der "), "de").when(low.contains(" les "), "fr").otherwise("es")
    return metrics.accuracy(table(spark, sf, "documents").withColumn("guess", guess), "lang", "guess")


from . import answers, checks, graphs, hybrids  # noqa: E402, F401 (they register their queries)


def entry(spark: SparkSession, sf: str) -> DataFrame:
    return exact_topk(spark, sf)

