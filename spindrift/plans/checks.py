"""Pages, code verification, chunkers and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import chunks, memory, metrics, verify
from ..sources import scratch
from ..streaming.counters import Counters
from . import fixtures as fx
from .base import example, query, table


# --- chunkers
_WIDE = r"\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_SPACE, _BLANK = rf"\t-\r{_WIDE}", rf"\t\x0b-\r{_WIDE}"
_STRIPPED = lambda x: f"regexp_replace({x}, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"
_HEADED = rf"#{{1,4}}[{_BLANK}]"


def _sections_sql(texts: str) -> str:
    """CTEs up to ``src`` (id, sec, section, body) of ``texts`` (id, text): cut before each heading."""
    mark = "chr(57344)"
    return (
        f"u AS (SELECT id, text, string_split(regexp_replace(text, '(?m)^({_HEADED})', {mark} || '\\1', 'g'), {mark}) AS p FROM ({texts})), "
        "v AS (SELECT id, unnest(p) AS x, unnest(range(1, len(p) + 1)) AS sec FROM u), "
        f"b AS (SELECT id, sec, CASE WHEN regexp_matches(x, '^{_HEADED}') THEN {_STRIPPED(r"regexp_extract(x, '^#{1,4}([^\n]*)', 1)")} ELSE '' END AS section, "
        f"{_STRIPPED(f"CASE WHEN regexp_matches(x, '^{_HEADED}') THEN regexp_replace(x, '^[^\\n]*\\n?', '') ELSE x END")} AS body FROM v), "
        "src AS (SELECT * FROM b WHERE body <> '' UNION ALL SELECT id, 0, '', text FROM u WHERE id NOT IN (SELECT id FROM b WHERE body <> ''))"
    )


#: From ``src``: sentences numbered, where a chunk that begins at each would end (by running lengths), and the chunks that follow one another from the first.
_PACKED_SQL = (
    f"l AS (SELECT id, sec, section, string_split(regexp_replace(trim(regexp_replace(body, '[{_SPACE}]+', ' ', 'g')), '([.!?]) ', '\\1' || chr(10), 'g'), chr(10)) AS p FROM src), "
    "s AS (SELECT id, sec, section, unnest(p) AS s, unnest(range(1, len(p) + 1)) AS i FROM l), "
    "c AS (SELECT *, length(s) AS n, CAST(sum(length(s) + 1) OVER (PARTITION BY id, sec ORDER BY i) AS BIGINT) AS c FROM s), "
    "j AS (SELECT *, i + count(*) OVER (PARTITION BY id, sec ORDER BY c RANGE BETWEEN CURRENT ROW AND greatest(0, 400 - n) FOLLOWING) AS nxt FROM c), "
    "h AS (SELECT id, sec, i, nxt FROM j WHERE i = 1 UNION ALL SELECT j.id, j.sec, j.i, j.nxt FROM h JOIN j ON j.id = h.id AND j.sec = h.sec AND j.i = h.nxt), "
    "g AS (SELECT h.id, h.sec, h.i, any_value(j.section) AS section, string_agg(j.s, ' ' ORDER BY j.i) AS t FROM h JOIN j ON j.id = h.id AND j.sec = h.sec AND j.i >= h.i AND j.i < h.nxt GROUP BY ALL), "
    "w AS (SELECT id, sec, i, section, unnest(CASE WHEN length(t) > 400 THEN list_transform(range(0, length(t), 350), lambda o: substring(t, o + 1, 400)) ELSE [t] END) AS chunk, unnest(range(0, greatest(1, length(t)), CASE WHEN length(t) > 400 THEN 350 ELSE greatest(1, length(t)) END)) AS k FROM g) "
    "SELECT id AS doc_id, CAST(row_number() OVER (PARTITION BY id ORDER BY sec, i, k) - 1 AS INT) AS chunk_index, section, chunk FROM w WHERE length(trim(chunk)) > 20"
)
_TEXTS = "SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL"


@query(f"WITH RECURSIVE src AS (SELECT id, 0 AS sec, '' AS section, text AS body FROM ({_TEXTS})), {_PACKED_SQL}")
def chunk_sentences(spark, sf):
    return chunks.exploded(table(spark, sf, "documents"), chunks.packed_sentences(F.col("text")), "doc_id")


@query(f"WITH {_sections_sql(_TEXTS)} SELECT id AS doc_id, CAST(row_number() OVER (PARTITION BY id ORDER BY sec) - 1 AS INT) AS chunk_index, section, body AS chunk FROM src")
def chunk_sections(spark, sf):
    return chunks.exploded(table(spark, sf, "documents"), chunks.sections(F.col("text")), "doc_id")


_TURNS = "SELECT conv_id * 1000000 + turn AS id, conv_id || chr(10) || '## ' || coalesce(role, '') || chr(10) || replace(coalesce(text, ''), '. ', '.' || chr(10) || '### then' || chr(10)) AS text FROM conversations"


def _turns(spark, sf):
    """A turn as a small page: its session, a heading by its role, and one before each further sentence."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"\. ", ".\n### then\n")
    page = F.concat(F.col("conv_id").cast("string"), F.lit("\n## "), F.coalesce("role", F.lit("")), F.lit("\n"), text)
    return table(spark, sf, "conversations").select((F.col("conv_id") * 1000000 + F.col("turn")).alias("doc_id"), page.alias("text"))


@query(f"WITH {_sections_sql(_TURNS)} SELECT id AS doc_id, CAST(row_number() OVER (PARTITION BY id ORDER BY sec) - 1 AS INT) AS chunk_index, section, body AS chunk FROM src")
def chunk_headed(spark, sf):
    return chunks.exploded(_turns(spark, sf), chunks.sections(F.col("text")), "doc_id")


@query()
def chunk_code(spark, sf):
    return chunks.chunked(table(spark, sf, "documents"), chunks.code_chunks)


@query(f"WITH RECURSIVE {_sections_sql(_TEXTS)}, {_PACKED_SQL}")
def chunk_prose(spark, sf):
    return chunks.exploded(table(spark, sf, "documents"), chunks.prose(F.col("text")), "doc_id")


@query(f"WITH RECURSIVE {_sections_sql(_TURNS)}, {_PACKED_SQL}")
def chunk_headed_prose(spark, sf):
    return chunks.exploded(_turns(spark, sf), chunks.prose(F.col("text")), "doc_id")


@query("SELECT doc_id, CAST(unnest(range(0, greatest(1, CAST(ceil(length(t) / 500) AS BIGINT)))) AS INT) AS part, CAST(least(500, length(t) - 500 * unnest(range(0, greatest(1, CAST(ceil(length(t) / 500) AS BIGINT))))) AS BIGINT) AS n FROM (SELECT doc_id, regexp_replace(text, '\\s+', 'x', 'g') AS t FROM documents WHERE text IS NOT NULL)")
def message_parts(spark, sf):
    """Of texts without white space, which are cut at the limit."""
    rows = table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", F.regexp_replace("text", "[ \\t\\n\\f\\r]+", "x").alias("t"))
    return rows.lateralJoin(chunks.MessageParts(F.col("t").outer(), F.lit(500))).select("doc_id", "part", F.length("text").cast("long").alias("n"))


_LINES = "SELECT doc_id, replace(text, '. ', '.' || chr(10)) AS t FROM documents WHERE text IS NOT NULL"
_CUT = "SELECT *, CASE WHEN 500 - back > 250 THEN CAST(500 - back AS BIGINT) ELSE 500 END AS cut FROM (SELECT *, instr(reverse(substr(rest, 1, 500)), chr(10)) AS back FROM r WHERE rest IS NOT NULL)"


@query(
    f"WITH RECURSIVE r AS (SELECT doc_id, -1 AS part, '' AS text, t AS rest FROM ({_LINES}) UNION ALL SELECT doc_id, part + 1, CASE WHEN length(rest) <= 500 THEN rest ELSE substr(rest, 1, cut) END, CASE WHEN length(rest) <= 500 THEN NULL ELSE regexp_replace(substr(rest, cut + 1), '^[{_SPACE}]+', '') END FROM ({_CUT})) SELECT doc_id, part, CAST(length(text) AS BIGINT) AS n, md5(text) AS digest FROM r WHERE part >= 0"
)
def message_lines(spark, sf):
    """Texts with a line a sentence, cut at line ends past the half where there are any."""
    rows = table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", F.regexp_replace("text", r"\. ", ".\n").alias("t"))
    return rows.lateralJoin(chunks.MessageParts(F.col("t").outer(), F.lit(500))).select("doc_id", "part", F.length("text").cast("long").alias("n"), F.md5("text").alias("digest"))


_SETEXT = "Intro line one\nTitle here\n==========\n\nFirst block of the section, long enough to stay as a chunk.\n\n    code = 1\n\n    more = 2\n\n## Heading\n\n~~~\na = 1\n\n# not a heading\n~~~\n\nlast block, which is long enough to stay as well, surely."


@example(fx.golden("section chunk_index chunk", [("Title here", 0, "First block of the section, long enough to stay as a chunk.\n\n    code = 1\n\n    more = 2"), ("Heading", 1, "~~~\na = 1\n\n# not a heading\n~~~\n\nlast block, which is long enough to stay as well, surely.")]))
def chunk_code_small(spark, sf):
    return chunks.chunked(fx.frame(spark, [(1, _SETEXT)], "doc_id long, text string"), chunks.code_chunks).select("section", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk")


@example(fx.golden("section chunk_index chunk", [("", 0, "before"), ("A", 1, "one\n##### five"), ("C d", 2, "two")]))
def chunk_sections_small(spark, sf):
    rows = fx.frame(spark, [(1, "before\n# A\none\n##### five\n## B\n\n#### C d\ntwo")], "doc_id long, text string")
    return chunks.exploded(rows, chunks.sections(F.col("text")), "doc_id").select("section", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk")


# --- pages and code
@query()
def html_text(spark, sf):
    return verify.html_texts(table(spark, sf, "pages"), "page_id", "html").withColumnRenamed("id", "page_id")


@example(fx.golden("id text", [(1, "# Body\n\ntext stays"), (2, "## T & U\n\n- one\n- two\n\n```\na  b\n<c>\n```\ntail"), (3, "a  b  \n\nx\ny\nkept"), (4, "")]))
def html_text_small(spark, sf):
    """A skipped element ends with its own end tag, whatever is left open inside."""
    return verify.html_texts(fx.frame(spark, fx.PAGES, "id long, html string"), "id", "html")


@query("SELECT page_id AS id, 'html' AS language FROM pages")
def html_verified(spark, sf):
    return verify.verified(table(spark, sf, "pages").withColumn("language", F.lit("html")), "page_id", "language", "html").select("id", "language")


@query()
def html_verify(spark, sf):
    return verify.verified(table(spark, sf, "pages").withColumn("language", F.lit("html")), "page_id", "language", "html").withColumns({c: F.array_join(c, "|") for c in ("errors", "warnings")})


_CHECKED = [
    (1, "python", True, "", "", '{"classes": ["K"], "functions": ["async f"], "imports": ["os", "a.b"], "lines": 9, "main_guard": true}'), (2, "python", False, "line 1: invalid syntax", "", "{}"),
    (3, "python", True, "", "no function or class", '{"classes": [], "functions": [], "imports": [], "lines": 7, "main_guard": false}'), (4, "sql", True, "", "only statement types are checked", '{"statements": {"INSERT": 1, "SELECT": 1}}'),
    (5, "sql", False, "no statement", "only statement types are checked", '{"statements": {}}'), (6, "html", True, "", "", '{"has_body": true, "has_head": false, "has_html": true, "tags": {"body": 1, "br": 1, "html": 1, "p": 1}}'),
    (7, "html", False, "closes unopened p|closes unopened i|leaves p open|leaves b open", "", '{"has_body": false, "has_head": false, "has_html": false, "tags": {"b": 1, "p": 1}}'), (8, "css", True, "", "", '{"at_rules": ["media", "import"], "rules": 1}'),
    (9, "css", False, "no declaration: b", "", '{"at_rules": [], "rules": 1}'), (10, "css", False, "leaves a block open", "", '{"at_rules": [], "rules": 1}'), (11, None, None, "", "skipped", "{}"), (12, "python", False, "empty", "", "{}"), (13, "bash", None, "", "skipped", "{}"),
]


@example(fx.golden("id language valid errors warnings structure", _CHECKED))
def code_verify(spark, sf):
    done = verify.verified(fx.frame(spark, fx.SNIPPETS, "id long, language string, code string"), "id", "language", "code")
    return done.withColumns({c: F.array_join(c, "|") for c in ("errors", "warnings")})


@example(fx.golden("query_id n_blocks n_checked n_valid n_skipped all_valid confidence", [(i, 0, 0, 0, 0, True, 0.0) if i != 6 else (6, 2, 2, 1, 0, False, 0.5) for i, _ in fx.QUESTIONS]))
def verify_stage(spark, sf):
    return verify.verify_stage(fx.questions(spark)).drop("errors")


# --- sessions
@query("SELECT conv_id, count(*) AS turn_count, string_agg(role || ':' || turn, ' ' ORDER BY turn) AS history FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 20 GROUP BY conv_id")
def session_context(spark, sf):
    found = memory.context(table(spark, sf, "conversations"))
    return found.select("conv_id", "turn_count", F.array_join(F.transform("history", lambda t: F.concat(t["role"], F.lit(":"), t["turn"])), " ").alias("history"))


@query("SELECT conv_id, turn, role, text FROM conversations WHERE conv_id = (SELECT min(conv_id) FROM conversations) QUALIFY row_number() OVER (ORDER BY turn DESC) <= 20")
def session_history(spark, sf):
    turns = table(spark, sf, "conversations")
    return memory.history(turns, turns.agg(F.min("conv_id")).first()[0]).select("conv_id", "turn", "role", "text")


@query("SELECT conv_id, count(*) AS n FROM conversations WHERE conv_id % 2 = 1 GROUP BY conv_id")
def session_reset(spark, sf):
    turns = table(spark, sf, "conversations")
    return memory.reset(turns, turns.filter("conv_id % 2 = 0").select("conv_id").distinct()).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))


# --- metrics
@query("SELECT event_type, share, arg_min(value, r) AS value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL), (VALUES (0.5::DOUBLE), (0.95::DOUBLE)) AS s(share) WHERE r >= round_even(share * (n - 1), 0) GROUP BY event_type, share")
def nearest_rank(spark, sf):
    return metrics.nearest_rank(table(spark, sf, "events"), "value", [0.5, 0.95], "event_type")


@example(fx.golden("n n_refused n_generated refusal_rate grounding_rate median mean max refusals_under_1s p95", [(5, 1, 3, 0.5, 2 / 3, 2.5, 3.1, 8.25, True, 8.25)]))
def benchmark_summary(spark, sf):
    return metrics.summary(_results(spark))


@example(fx.golden("line", [("5 queries; refusal rate 50.0 %; grounding rate 66.7 %; median 2.5 s",)]))
def benchmark_report(spark, sf):
    return metrics.report(metrics.summary(_results(spark)))


def _results(spark):
    return fx.frame(spark, fx.RESULTS, "query string, expect_refusal boolean, refused boolean, generated_by string, latency_s double, response_chars int, grounded boolean")


@query("SELECT item_id, doc_id, len(list_intersect(list_filter(regexp_extract_all(lower(coalesce(b.text, '')), '\\p{L}+'), lambda w: length(w) > 4), list_filter(regexp_extract_all(lower(coalesce(d.text, '')), '\\p{L}+'), lambda w: length(w) > 4))) > 0 AS grounded FROM benchmark b JOIN documents d ON d.doc_id = b.item_id")
def grounding(spark, sf):
    rows = table(spark, sf, "benchmark").withColumnRenamed("text", "asked").join(table(spark, sf, "documents").withColumn("item_id", F.col("doc_id")), "item_id")
    return rows.select("item_id", "doc_id", metrics.grounded(F.col("asked"), F.col("text")).alias("grounded"))


_SIGNIFICANT = lambda x: f"list_filter(regexp_extract_all(lower(coalesce({x}, '')), '\\p{{L}}+'), lambda w: length(w) > 4)"


@query(f"SELECT conv_id, turn, len(list_intersect({_SIGNIFICANT('text')}, {_SIGNIFICANT('asked')})) > 0 AS grounded FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS asked FROM conversations) WHERE role = 'assistant'")
def grounding_turns(spark, sf):
    """Whether an answer of a session is grounded in the turn before it."""
    before = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf, "conversations").withColumn("asked", F.lag("text").over(before)).filter("role = 'assistant'")
    return rows.select("conv_id", "turn", metrics.grounded(F.col("text"), F.col("asked")).alias("grounded"))


_RECORDED = fx.values(fx.RECORDED, "query_id kind generated_by latency_s")


@example(f"SELECT kind, generated_by, CAST(grouping(kind, generated_by) AS INT) AS level, count(*) AS n, round(avg(latency_s), 6) AS mean_latency, max(query_id) AS last_id FROM {_RECORDED} GROUP BY ROLLUP (kind, generated_by)")
def usage_by_kind(spark, sf):
    return metrics.usage(fx.frame(spark, fx.RECORDED, "query_id long, kind string, generated_by string, latency_s double"))


@query(
    "SELECT event_type AS kind, n, mean_value, ts AS last_at, event_id AS last_id FROM (SELECT event_type, ts, event_id, count(*) OVER w AS n, round(avg(value) OVER w, 6) AS mean_value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC NULLS LAST, event_id DESC) AS r FROM events WINDOW w AS (PARTITION BY event_type)) WHERE r = 1"
)
def usage_stream(spark, sf):
    """Counters and the last event of each kind, from a stream of all events."""
    events = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/event[s].parquet")  # a pattern: a stream takes no single file by its name
    kept = Counters(spark, scratch.folder(spark, "counters"))
    kept.follow(events, scratch.folder(spark, "checkpoint"), "event_type", "ts", "event_id", "value").awaitTermination()
    return kept.totals().select("kind", "n", F.round(F.col("total") / F.col("n"), 6).alias("mean_value"), "last_at", "last_id")


@query("SELECT lang AS domain, source AS type, count(*) AS n FROM documents GROUP BY ALL")
def file_counts(spark, sf):
    from ..sources.ingest import file_counts as counts

    rows = table(spark, sf, "documents").select(F.lit("").alias("name"), F.col("lang").alias("domain"), F.col("source").alias("type"))
    return counts(rows).drop("name")


