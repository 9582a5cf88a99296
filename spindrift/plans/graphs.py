"""Knowledge-graph queries over documents and over a small graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import STOP_SEARCH
from ..operators import graph, graphstore
from ..sources import scratch
from . import fixtures as fx
from .base import example, query, slugged, table

_NOT = "(" + ", ".join(f"'{w}'" for w in (*STOP_SEARCH, "unknown")) + ")"
_SENTENCES = f"st AS (SELECT doc_id, unnest(range(len(ss))) AS sentence, unnest(ss) AS s FROM (SELECT doc_id, regexp_split_to_array(text, '{graph.SENTENCE}') AS ss FROM documents WHERE text IS NOT NULL))"
_MENTIONS = f"{_SENTENCES}, tok AS (SELECT doc_id, sentence, unnest(range(len(t))) AS pos, unnest(t) AS label FROM (SELECT doc_id, sentence, regexp_extract_all(s, '{graph.TOKEN}') AS t FROM st)), men AS (SELECT * FROM (SELECT *, {slugged('label')} AS id FROM tok WHERE regexp_matches(label, '{graph.IS_ENTITY}')) WHERE length(id) >= 2 AND id NOT IN {_NOT})"
_ENTITIES = f"{_MENTIONS}, ent AS (SELECT doc_id, id, label, CASE WHEN regexp_matches(label, '{graph.ACRONYM}') THEN 'acronym' ELSE 'concept' END AS type FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, id ORDER BY sentence, pos) AS r FROM men) WHERE r = 1)"
_TYPED = " UNION ALL ".join(f"SELECT doc_id, unnest(regexp_extract_all(s, '{graph.typed_pattern(w)}', 1)) AS a, '{p}' AS p, unnest(regexp_extract_all(s, '{graph.typed_pattern(w)}', 2)) AS b, {c}::DOUBLE AS confidence FROM st" for p, c, w in graph.TYPED)
_RELATIONS = f"rel AS (SELECT DISTINCT doc_id, s, p, o, confidence FROM (SELECT doc_id, {slugged('a')} AS s, p, {slugged('b')} AS o, confidence FROM ({_TYPED})) WHERE s <> o AND s NOT IN {_NOT} AND o NOT IN {_NOT})"
_PAIRS = "f AS (SELECT doc_id, sentence, id, min(pos) AS pos FROM men GROUP BY ALL), pr AS (SELECT x.doc_id, x.sentence, x.pos AS i, y.pos AS j, x.id AS s, y.id AS o FROM f x JOIN f y ON x.doc_id = y.doc_id AND x.sentence = y.sentence AND x.pos < y.pos), co AS (SELECT doc_id, s, 'co_occurs_with' AS p, o, 0.3::DOUBLE AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, least(s, o), greatest(s, o) ORDER BY sentence, i, j) AS r FROM pr) WHERE r = 1)"
_FOUND = f"{_ENTITIES}, {_RELATIONS}, {_PAIRS}, found AS (SELECT * FROM rel UNION ALL SELECT * FROM co)"
_GRAPH = f"WITH {_FOUND}, g AS (SELECT s, p, o, count(*) AS count, max(confidence) AS confidence, count(DISTINCT doc_id) AS n_sources, min(doc_id) AS first_source FROM found GROUP BY s, p, o), latest AS (SELECT id, arg_max(label, doc_id) AS label, arg_max(type, doc_id) AS type FROM ent GROUP BY id), nodes AS (SELECT * FROM latest UNION ALL SELECT id, id, 'concept' FROM (SELECT s AS id FROM g UNION SELECT o FROM g) WHERE id NOT IN (SELECT id FROM latest))"
_A, _B = "en", "er"


def _documents(spark, sf):
    return table(spark, sf, "documents")


def _stored(spark, sf, batches=1):
    """The graph of the documents, extracted and saved once a session for each state of the table, in so many batches."""
    docs = _documents(spark, sf)

    def build():
        own, path = docs.select("doc_id", "text"), scratch.folder(spark, "graph")
        few = own.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism  # a few large row groups would be as many tasks
        g = graphstore.Graph(spark, path)
        for i in range(batches):
            some = own if batches == 1 else own.filter(F.pmod("doc_id", F.lit(batches)) == i)
            g = g.append(some.repartition(spark.sparkContext.defaultParallelism) if few else some, f"batch-{i}")
        return path if batches > 1 else g.compact().path

    return graphstore.Graph(spark, scratch.once((spark.sparkContext.applicationId, "graph", batches, scratch.state(docs)), build))


def built(spark, sf):
    """(nodes, triples) of the documents."""
    g = _stored(spark, sf)
    return g.nodes(), g.triples()


@query(f"WITH {_ENTITIES} SELECT * FROM ent")
def kg_entities(spark, sf):
    return graph.entities(_documents(spark, sf))


@query(f"WITH {_SENTENCES}, {_RELATIONS} SELECT * FROM rel")
def kg_relations(spark, sf):
    return graph.relations(_documents(spark, sf))


@query(f"WITH {_MENTIONS}, {_PAIRS} SELECT * FROM co")
def kg_cooccur(spark, sf):
    return graph.cooccurrences(_documents(spark, sf))


@query(f"WITH {_FOUND} SELECT doc_id, CAST(sum(e) AS BIGINT) AS n_entities, CAST(sum(r) AS BIGINT) AS n_relations FROM (SELECT doc_id, 1 AS e, 0 AS r FROM ent UNION ALL SELECT doc_id, 0, 1 FROM found) GROUP BY doc_id")
def kg_extracted(spark, sf):
    return graph.extracted_counts(_documents(spark, sf))


@query(f"{_GRAPH} SELECT * FROM g")
def kg_triples(spark, sf):
    return built(spark, sf)[1]


#: A turn as a page with a heading, a fenced block, bullets, links and inline code.
_PAGE = "'# ' || coalesce(role, '') || chr(10) || '```' || chr(10) || 'Fenced Name uses Other' || chr(10) || '```' || chr(10) || '- ' || regexp_replace(replace(text, '. ', '.' || chr(10) || '* '), '(\\p{Lu}\\p{Ll}+) (\\p{Ll}+)', '[\\1](https://Host.example/Page) `\\2`', 'g')"
_PAGES = f"SELECT conv_id * 1000000 + turn AS doc_id, {_PAGE} AS page FROM conversations WHERE text IS NOT NULL"
_PLAIN = "page"
for _find, _put in (("(?s)```.*?```", " "), (r"\[([^\]]*)\]\([^)]*\)", r"\1"), ("`([^`]*)`", r"\1"), (r"(?m)^\s{0,3}#{1,6}\s*", ""), (r"(?m)^\s*[-*+]\s+", "")):
    _PLAIN = f"regexp_replace({_PLAIN}, '{_find}', '{_put}', 'g')"


def _pages(spark, sf):
    text = F.regexp_replace(F.regexp_replace("text", r"\. ", ".\n* "), r"(\p{Lu}\p{Ll}+) (\p{Ll}+)", "[$1](https://Host.example/Page) `$2`")
    page = F.concat(F.lit("# "), F.coalesce("role", F.lit("")), F.lit("\n```\nFenced Name uses Other\n```\n- "), text)
    turns = table(spark, sf, "conversations").filter("text IS NOT NULL")
    return turns.select((F.col("conv_id") * 1000000 + F.col("turn")).alias("doc_id"), page.alias("text"))


@query(f"SELECT doc_id, {_PLAIN} AS text FROM ({_PAGES})")
def markdown_plain(spark, sf):
    return graph.cleaned(_pages(spark, sf))


@query(f"WITH documents AS (SELECT doc_id, {_PLAIN} AS text FROM ({_PAGES})), {_GRAPH.removeprefix('WITH ')} SELECT * FROM g")
def kg_build(spark, sf):
    """The triples that the build job saves of markdown pages."""
    path = scratch.folder(spark, "built")
    graph.build(_pages(spark, sf), path, least_entities=0, least_relations=0)
    return graph.load(spark, path)[1]


@query(f"{_GRAPH} SELECT * FROM g")
def kg_triples_batches(spark, sf):
    """Three batches give what one does."""
    return _stored(spark, sf, 3).triples()


@query(f"{_GRAPH} SELECT * FROM g WHERE s = '{_A}' UNION ALL SELECT * FROM g WHERE o = '{_A}'")
def kg_facts_batches(spark, sf):
    return _stored(spark, sf, 3).facts(_A)


@query(f"{_GRAPH} SELECT * FROM nodes")
def kg_nodes(spark, sf):
    return built(spark, sf)[0]


@query(f"WITH {_FOUND} SELECT DISTINCT s, p, o, doc_id AS source FROM found WHERE s = '{_A}'")
def kg_sources(spark, sf):
    found = graph.extracted(_documents(spark, sf))[1]
    return graph.provenance(graph.pattern(found, s=_A))


@query(f"{_GRAPH} SELECT (SELECT count(*) FROM nodes) AS entities, (SELECT count(*) FROM g) AS relations")
def kg_counts(spark, sf):
    return graph.counts(*built(spark, sf))


@query(f"{_GRAPH} SELECT * FROM nodes WHERE type = 'acronym'")
def kg_of_type(spark, sf):
    return graph.of_type(built(spark, sf)[0], "acronym")


@query(f"{_GRAPH} SELECT i.id, i.id IN (SELECT id FROM nodes) AS known FROM (VALUES ('{_A}'), ('{_B}'), ('no_such_node')) AS i(id)")
def kg_known(spark, sf):
    return _stored(spark, sf).known(fx.frame(spark, [(_A,), (_B,), ("no_such_node",)], "id string"))


@query(f"{_GRAPH} SELECT * FROM g WHERE p = 'of' AND s = '{_A}'")
def kg_pattern(spark, sf):
    return graph.pattern(_stored(spark, sf).out_of(_A), p="of")


@query(f"{_GRAPH} SELECT id, label, type, p FROM g JOIN nodes ON o = id WHERE s = '{_A}'")
def kg_neighbors(spark, sf):
    g = _stored(spark, sf)
    return graph.neighbours(g.out_of(_A), g.nodes(), _A)


@query(f"{_GRAPH} SELECT * FROM g WHERE s = '{_A}' UNION ALL SELECT * FROM g WHERE o = '{_A}'")
def kg_facts(spark, sf):
    return _stored(spark, sf).facts(_A)


@query(f"{_GRAPH} SELECT CASE WHEN bool_or(s = '{_A}') AND bool_or(s = '{_B}') THEN 'common' WHEN bool_or(s = '{_A}') THEN 'a_only' ELSE 'b_only' END AS kind, o AS id, string_agg(DISTINCT p, ',' ORDER BY p) AS predicates FROM g WHERE s IN ('{_A}', '{_B}') GROUP BY o UNION ALL SELECT 'a_to_b', o, string_agg(p, ',' ORDER BY p) FROM g WHERE s = '{_A}' AND o = '{_B}' GROUP BY o UNION ALL SELECT 'b_to_a', o, string_agg(p, ',' ORDER BY p) FROM g WHERE s = '{_B}' AND o = '{_A}' GROUP BY o")
def kg_compare(spark, sf):
    return graph.compare(_stored(spark, sf).out_of(_A, _B), _A, _B)


@query(f"{_GRAPH} SELECT id, count(*) AS degree FROM (SELECT s AS id FROM g UNION ALL SELECT o FROM g) GROUP BY id ORDER BY degree DESC, id LIMIT 10")
def kg_top_degree(spark, sf):
    return _stored(spark, sf).degrees()


# --- a small graph
def small(spark):
    entities = fx.frame(spark, fx.ENTITIES, "seq long, id string, label string, type string, attributes map<string,string>")
    relations = fx.frame(spark, fx.RELATIONS, "source string, s string, p string, o string, confidence double")
    triples = graph.triples(relations, "source")
    return graph.with_placeholders(graph.upserted(entities), triples), triples, entities, relations


@example(fx.golden("id label type attributes", [("spark", "Apache Spark", "software", "kind=cluster engine,since=2010"), ("jvm", "JVM", "acronym", ""), ("arrow", "Arrow", "software", "kind=format"), ("python", "Python", "software", ""), ("duckdb", "DuckDB", "software", "kind=database")]))
def kg_upsert(spark, sf):
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return graph.upserted(small(spark)[2]).select("id", "label", "type", pairs.alias("attributes"))


@example(fx.golden("s p o count confidence sources", [("spark", "uses", "jvm", 3, 0.9, "a,b"), ("spark", "uses", "arrow", 1, 0.7, "a"), ("duckdb", "uses", "arrow", 1, 0.7, "b"), ("spark", "has", "optimizer", 1, 0.7, "b"), ("duckdb", "has", "optimizer", 1, 0.7, "c"), ("duckdb", "co_occurs_with", "spark", 1, 0.3, "c"), ("python", "is_a", "language", 2, 0.8, "c"), ("spark", "of", "spark", 1, 0.5, "a")]))
def kg_aggregate(spark, sf):
    _, triples, _, relations = small(spark)
    return graph.sourced(triples, relations, "source").select("s", "p", "o", "count", "confidence", F.array_join("sources", ",").alias("sources"))


@example(fx.golden("id label type", [("spark", "Apache Spark", "software"), ("jvm", "JVM", "acronym"), ("arrow", "Arrow", "software"), ("python", "Python", "software"), ("duckdb", "DuckDB", "software"), ("optimizer", "optimizer", "concept"), ("language", "language", "concept")]))
def kg_placeholders(spark, sf):
    return small(spark)[0]


@example(fx.golden("kind id predicates", [("common", "arrow", "uses"), ("common", "optimizer", "has"), ("common", "spark", "co_occurs_with,of"), ("a_only", "jvm", "uses"), ("b_to_a", "spark", "co_occurs_with")]))
def kg_compare_small(spark, sf):
    return graph.compare(small(spark)[1], "spark", "duckdb")


@example(fx.golden("s p o n", [("spark", "of", "spark", 2), ("spark", "uses", "jvm", 1), ("spark", "uses", "arrow", 1), ("spark", "has", "optimizer", 1), ("duckdb", "co_occurs_with", "spark", 1)]))
def kg_facts_small(spark, sf):
    """A loop comes twice."""
    return graph.facts(small(spark)[1], "spark").groupBy("s", "p", "o").agg(F.count(F.lit(1)).alias("n"))


@example(fx.golden("id facts", [(1, "python is a language."), (2, "duckdb has optimizer.|duckdb uses arrow.|duckdb co occurs with spark.")]))
def kg_fact_sentences(spark, sf):
    asked = fx.frame(spark, [(1, "the Python language"), (2, "DuckDB"), (3, "nobody")], "id long, label string")
    nodes, triples, _, _ = small(spark)
    found = graph.resolved(asked.select(F.col("id").alias("key"), "label"), nodes.filter("id <> 'language'"), "key", "label")
    return graph.sentences_of(graph.all_facts(triples, found, "key"), "key").select(F.col("key").alias("id"), F.array_join("facts", "|").alias("facts"))


@example(fx.golden("s p o count", [("a", "uses", "b", 2), ("a", "has", "c", 3), ("b", "of", "c", 5), ("c", "of", "d", 1)]))
def kg_repaired(spark, sf):
    return graph.repaired(fx.frame(spark, fx.DAMAGED, "s string, p string, o string, count long, confidence double, sources array<string>")).select("s", "p", "o", "count")


@example(fx.golden("kind n", [("node", 7), ("triple", 8)]))
def kg_saved(spark, sf):
    """Saved, loaded and exported."""
    nodes, triples, _, _ = small(spark)
    path = scratch.folder(spark, "graph")
    graph.save(nodes, triples, path)
    return graph.exported(*graph.load(spark, path)).filter("get_json_object(json, '$') IS NOT NULL").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
