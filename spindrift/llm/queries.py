"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontaminate, divergence, langid, lines, packing, phrases, quality, rans, secrets, simhash, substrings, toxicity, urls

table = common.table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, bits=4).drop("key")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(langid.trained_on(docs))
    return langid.predict(docs, model, with_spans=False).select("doc_id", (common.fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op3_rans_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch(spark, "rans")
    rans.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path, end_id=1)
    return rans.read(spark, path, with_ids=False)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.drop("symbols_failed", "word_chars_failed", "dup_lines_failed")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, seq_len=1024, with_ids=False)
    return packed.drop("ids")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (common.fold("doc_id", 5) == 0).alias("held_out"), "score", F.expr("if(score >= 0.5, 1, 0)").alias("predicted"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.drop("spans", "items", "longest")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(table(spark, sf_dir, "documents")).drop("row")


#: The rules of the url query.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents"), window=50).drop("spans")


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), least=100, longest=5, top=2000)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least=30, top=50)


OP4_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
grams AS (SELECT r, i, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM docs)),
twice AS (SELECT r, g FROM grams GROUP BY r, g HAVING count(*) > 1),
repeated AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM grams JOIN twice USING (r, g)) GROUP BY r),
counts AS (
  SELECT r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols
  FROM docs LEFT JOIN repeated USING (r)),
measures AS (
  SELECT *, n_symbols * 1000 // greatest(n_words, 1) AS symbols, word_chars * 100 // greatest(n_words, 1) AS word_chars_100,
         n_dup_lines * 1000 // greatest(n_lines, 1) AS dup_lines FROM counts),
long AS (
  SELECT lang, source, 'symbols' AS measure, symbols AS v FROM measures UNION ALL
  SELECT lang, source, 'word_chars', word_chars_100 FROM measures UNION ALL
  SELECT lang, source, 'dup_lines', dup_lines FROM measures),
sketch AS (
  SELECT level, CASE WHEN level < 2 THEN lang END AS lang, CASE WHEN level < 1 THEN source END AS source, measure, bucket, count(*) AS n
  FROM (SELECT *, CASE WHEN v <= 0 THEN -1 ELSE CAST(ceil(ln(CAST(v AS DOUBLE)) / ln(CAST(1.02 AS DOUBLE))) AS INT) END AS bucket FROM long), (VALUES (0), (1), (2)) AS t(level)
  GROUP BY ALL),
ranked AS (
  SELECT *, CASE WHEN bucket < 0 THEN 0 ELSE pow(CAST(1.02 AS DOUBLE), bucket) END AS v,
         sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, lang, source, measure) AS total
  FROM sketch),
quartiles AS (
  SELECT level, lang, source, measure, max(total) AS total, min(v) FILTER (2 * upto >= total) AS q50, min(v) FILTER (4 * upto >= 3 * total) AS q75
  FROM ranked GROUP BY ALL),
fences AS (
  SELECT level, lang, source, max(total) AS total,
         max(q50 + 4 * (q75 - q50) + 100) FILTER (measure = 'symbols') AS symbols_max,
         max(q50 + 8 * (q75 - q50) + 100) FILTER (measure = 'word_chars') AS word_chars_max,
         max(q50 + 4 * (q75 - q50) + 500) FILTER (measure = 'dup_lines') AS dup_lines_max
  FROM quartiles GROUP BY ALL),
picked AS (
  SELECT a.lang, a.source, CASE WHEN a.total >= 100 THEN a WHEN b.total >= 100 THEN b ELSE c END AS f
  FROM (SELECT * FROM fences WHERE level = 0) a JOIN (SELECT * FROM fences WHERE level = 1) b ON a.lang = b.lang, (SELECT * FROM fences WHERE level = 2) c),
judged AS (
  SELECT m.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         symbols > f.symbols_max OR (n_words >= 50 AND word_chars_100 > f.word_chars_max) OR dup_lines > f.dup_lines_max AS failed
  FROM measures m JOIN picked p ON m.lang = p.lang AND m.source = p.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR failed) AS kept FROM judged
"""

OP9_SQL = r"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substring(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM cut),
rules(says, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
best AS (
  SELECT page_id, host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(says, length(h || p)) AS says
  FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(says, 'allow') AS verdict FROM best
"""

OP7_SQL = r"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)),
found AS (SELECT r, item_id, n, i FROM grams JOIN windows USING (n, g)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""


OP11_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT r, doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS g
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM docs WHERE len(w) >= 50)),
firsts AS (SELECT g, min(doc_id) AS first FROM windows GROUP BY g HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS p FROM windows JOIN firsts USING (g) WHERE first < doc_id),
kept AS (
  SELECT r, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n
  FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM docs) ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""

OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS t
  FROM documents),
split AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM split GROUP BY lang),
f AS (
  SELECT lang, m, array_to_string(g, ' ') AS phrase, g, count(*) AS f
  FROM (SELECT lang, m, w[i : i + m - 1] AS g FROM (SELECT lang, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM split, (VALUES (1), (2), (3), (4), (5)) AS t(m) WHERE len(w) >= m))
  GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT lang, phrase, g, m, f AS a, unnest(range(1, m)) AS k FROM f WHERE m > 1),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, n, CAST(1000 * CAST(c.a AS HUGEINT) * n // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.g[1 : c.k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.g[c.k + 1 : c.m], ' ')
  JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (
  SELECT lang, array_to_string(g[i : i + s - 1], ' ') AS phrase, max(f) AS around
  FROM (SELECT lang, g, f, s, unnest(range(1, m - s + 2)) AS i FROM (SELECT lang, g, f, m, unnest(range(2, m)) AS s FROM f WHERE m > 2)) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inner_ i USING (lang, phrase) WHERE around IS NULL OR 100 * around < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM kept QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""

OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
terms AS (SELECT d, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM terms GROUP BY ALL HAVING count(DISTINCT d) >= 30),
v AS (SELECT lang, count(*) AS v, sum(n) AS whole FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM terms JOIN (SELECT lang, term FROM kept) USING (lang, term) GROUP BY ALL),
sums AS (SELECT lang, source, sum(n) AS t FROM counts GROUP BY ALL),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + 1000000000 * CAST(coalesce(c.n, 0) + 5 AS HUGEINT) // (coalesce(t, 0) + 5 * v) AS BIGINT) AS p,
         CAST(1 + 1000000000 * CAST(k.n + 5 AS HUGEINT) // (whole + 5 * v) AS BIGINT) AS q
  FROM groups g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
items AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(p.value, 0) AS BIGINT) AS value
  FROM groups x JOIN groups y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN pairs p ON p.lang = x.lang AND p.source = x.source AND p.item = y.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM items QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 50
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash_near_dedup, op2_language_id, op3_rans_token_file, op4_quality_rules, op5_packing, op6_toxicity, op7_decontamination, op8_line_dedup, op9_url_filters, op10_secret_scans, op11_substring_dedup, op12_phrase_mining, op13_source_divergence)}


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_rules": OP4_SQL, "op7_decontamination": OP7_SQL, "op9_url_filters": OP9_SQL, "op11_substring_dedup": OP11_SQL, "op12_phrase_mining": OP12_SQL, "op13_source_divergence": OP13_SQL}
