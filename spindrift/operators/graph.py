"""Knowledge graph: extraction, aggregation, storage and queries over triples (s, p, o, count, confidence, n_sources, first_source)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import STOP_SEARCH, plain_markdown, slug, slug_candidates
from ..sources import scratch

#: A run of capitalised words, or any other word; what ``IS_ENTITY`` takes of these are capitalised words and acronyms.
TOKEN = r"\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)*|[\p{L}\p{N}_]+"
IS_ENTITY = r"^(?:\p{Lu}\p{Ll}.*|\p{Lu}{2,10})$"
ACRONYM = r"^\p{Lu}+$"
SENTENCE = r"[.!?][ \t\n\x0b\f\r]+"
#: Either end of a typed relation is a word, its object after an article or not.
END, ARTICLE = r"\p{L}[\p{L}\p{N}_-]+", "the|The|an?|le|la|les|un|une|der|die|das|el|los"
TYPED = (("is_a", 0.8, "is an?|est une?|ist ein|es un"), ("has", 0.7, "has|a pour|hat|tiene"), ("uses", 0.7, "uses|utilise|nutzt|usa"), ("of", 0.5, "of|de|von"))
#: Entities of a sentence that are paired at once.
BLOCK = 64
SCHEMA_VERSION = 1


def typed_pattern(words: str) -> str:
    return rf"({END}) (?:{words}) (?:(?:{ARTICLE}) )?({END})"


def _fast(words: str) -> str:
    """The same matches as ``typed_pattern`` for an engine that backtracks: no start within letters, and a first word isn't given back."""
    return rf"(?<!\p{{L}})({END}+) (?:{words}) (?:(?:{ARTICLE}) )?({END})"


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sentence, ents, rels): what each sentence says, read once: entities (pos, label, id) in order of place, without stop words and slugs under two characters, and typed relations (s, p, o, confidence) without loops and stop words."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, SENTENCE)).alias("sentence", "t"))
    met = F.transform(F.regexp_extract_all("t", F.lit(TOKEN), F.lit(0)), lambda x, i: F.struct(i.alias("pos"), x.alias("label")))
    named = F.transform(F.filter(met, lambda e: e["label"].rlike(IS_ENTITY)), lambda e: F.struct(e["pos"].alias("pos"), e["label"].alias("label"), slug(e["label"]).alias("id")))
    ents = F.filter(named, lambda e: (F.length(e["id"]) >= 2) & ~e["id"].isin(*STOP_SEARCH, "unknown"))
    found = []
    for name, sure, words in TYPED:
        found.append(F.transform(F.regexp_extract_all("t", F.lit(_fast(words)), F.lit(0)), _triple(name, sure, typed_pattern(words))))
    rels = F.filter(F.concat(*found), lambda r: (r["s"] != r["o"]) & ~r["s"].isin(*STOP_SEARCH, "unknown") & ~r["o"].isin(*STOP_SEARCH, "unknown"))
    return rows.select("doc_id", "sentence", ents.alias("ents"), rels.alias("rels"))


def _triple(name: str, sure: float, pattern: str):
    return lambda m: F.struct(slug(F.regexp_extract(m, pattern, 1)).alias("s"), F.lit(name).alias("p"), slug(F.regexp_extract(m, pattern, 2)).alias("o"), F.lit(sure).alias("confidence"))


def entities_of(said: DataFrame) -> DataFrame:
    """(doc_id, id, label, type) of ``sentences``: the first mention of each id in a document."""
    first = said.select("doc_id", "sentence", F.inline("ents")).groupBy("doc_id", "id").agg(F.min(F.struct("sentence", "pos", "label")).alias("f"))
    label = F.col("f.label")
    return first.select("doc_id", "id", label.alias("label"), F.when(label.rlike(ACRONYM), "acronym").otherwise("concept").alias("type"))


def relations_of(said: DataFrame) -> DataFrame:
    """(doc_id, s, p, o, confidence) of ``sentences``: each typed triple once a document."""
    return said.select("doc_id", F.inline("rels")).distinct()


def cooccurrences_of(said: DataFrame) -> DataFrame:
    """(doc_id, s, p, o, confidence) of ``sentences``: every ordered pair of distinct entities of a sentence; the direction seen first counts.

    Up to ``BLOCK`` entities are paired where they lie; longer sentences are joined ``BLOCK`` by ``BLOCK``, so no row holds a long sentence's pairs.
    """
    few = said.filter((F.size("ents") > 1) & (F.size("ents") <= BLOCK)).withColumn("ids", F.transform("ents", lambda e: e["id"]))
    few = few.select("doc_id", "sentence", F.filter("ents", lambda e, i: F.array_position("ids", e["id"]) == i + 1).alias("own"))
    pair = lambda x, y: F.struct(x["pos"].alias("i"), y["pos"].alias("j"), x["id"].alias("s"), y["id"].alias("o"))
    near = F.flatten(F.transform("own", lambda x, i: F.transform(F.slice("own", i + 2, F.size("own")), lambda y: pair(x, y))))
    first = said.filter(F.size("ents") > BLOCK).select("doc_id", "sentence", F.inline("ents")).groupBy("doc_id", "sentence", "id").agg(F.min("pos").alias("pos"))
    ranked = first.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "sentence").orderBy("pos")))
    blocks = ranked.groupBy("doc_id", "sentence", F.floor(F.col("r") / BLOCK).alias("block")).agg(F.collect_list(F.struct("r", "id")).alias("own"))
    later = blocks.select(F.col("doc_id").alias("d"), F.col("sentence").alias("n"), F.col("block").alias("b"), F.col("own").alias("others"))
    both = blocks.join(later, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("sentence") == F.col("n")) & (F.col("block") <= F.col("b")))
    pairs = both.select("doc_id", "sentence", F.explode("own").alias("x"), "others").select("doc_id", "sentence", "x", F.explode("others").alias("y")).filter("x.r < y.r")
    pairs = pairs.select("doc_id", "sentence", F.col("x.r").alias("i"), F.col("y.r").alias("j"), F.col("x.id").alias("s"), F.col("y.id").alias("o"))
    pairs = few.select("doc_id", "sentence", F.inline(near)).union(pairs)
    seen = pairs.groupBy("doc_id", F.least("s", "o").alias("x"), F.greatest("s", "o").alias("y")).agg(F.min(F.struct("sentence", "i", "j", "s", "o")).alias("f"))
    return seen.select("doc_id", F.col("f.s").alias("s"), F.lit("co_occurs_with").alias("p"), F.col("f.o").alias("o"), F.lit(0.3).alias("confidence"))


def entities(docs: DataFrame, **columns: str) -> DataFrame:
    return entities_of(sentences(docs, **columns))


def relations(docs: DataFrame, **columns: str) -> DataFrame:
    return relations_of(sentences(docs, **columns))


def cooccurrences(docs: DataFrame, **columns: str) -> DataFrame:
    return cooccurrences_of(sentences(docs, **columns))


def extracted(docs: DataFrame, **columns: str) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of each document, from sentences that are read once and written."""
    said = scratch.written(sentences(docs, **columns), "sentences")  # all of them: a filter would be pushed below and extract everything twice
    said = said.filter("size(ents) > 0 OR size(rels) > 0")
    return entities_of(said), relations_of(said).union(cooccurrences_of(said))


def extracted_counts(docs: DataFrame, **columns: str) -> DataFrame:
    """(doc_id, n_entities, n_relations): what each document gave, whether new to the graph or not."""
    own, found = extracted(docs, **columns)
    marks = own.select("doc_id", F.lit(1).alias("e"), F.lit(0).alias("r")).union(found.select("doc_id", F.lit(0), F.lit(1)))
    return marks.groupBy("doc_id").agg(F.sum("e").alias("n_entities"), F.sum("r").alias("n_relations"))


def upserted(rows: DataFrame) -> DataFrame:
    """(id, label, type, attributes) of (seq, id, label, type, attributes): the latest label and type win, attributes are merged and the latest value of each wins.

    A blank id or label fails the job.
    """
    blank = F.coalesce(F.trim("id"), F.lit("")) == ""
    blank = blank | (F.coalesce(F.trim("label"), F.lit("")) == "")
    checked = rows.withColumn("id", F.when(blank, F.raise_error(F.lit("an entity needs an id and a label")).cast("string")).otherwise(F.col("id")))
    last = checked.groupBy("id").agg(F.max_by(F.struct("label", F.coalesce("type", F.lit("concept")).alias("type")), "seq").alias("e"))
    values = checked.select("id", "seq", F.explode("attributes").alias("k", "v")).groupBy("id", "k").agg(F.max_by("v", "seq").alias("v"))
    merged = values.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("attributes"))  # one entity's attributes
    return last.join(merged, "id", "left").select("id", "e.label", "e.type", F.coalesce("attributes", F.create_map().cast("map<string,string>")).alias("attributes"))


def triples(found: DataFrame, source_col: str = "doc_id") -> DataFrame:
    """(s, p, o, count, confidence, n_sources, first_source): counts add up, the highest confidence stays.  The sources themselves are rows of ``provenance``, for a common triple has too many for one row."""
    own = found.groupBy("s", "p", "o", source_col).agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("confidence"))
    return own.groupBy("s", "p", "o").agg(F.sum("n").alias("count"), F.max("confidence").alias("confidence"), F.count(source_col).alias("n_sources"), F.min(source_col).alias("first_source"))


def provenance(found: DataFrame, source_col: str = "doc_id") -> DataFrame:
    """(s, p, o, source): the distinct sources of each triple."""
    return found.select("s", "p", "o", F.col(source_col).alias("source")).dropna(subset=["source"]).distinct()


def sourced(graph: DataFrame, found: DataFrame, source_col: str = "doc_id") -> DataFrame:
    """Triples with their sorted ``sources``; meant for a graph narrowed by ``pattern`` first."""
    lists = provenance(found, source_col).join(graph.select("s", "p", "o"), ["s", "p", "o"], "left_semi").groupBy("s", "p", "o").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    return graph.join(lists, ["s", "p", "o"], "left").withColumn("sources", F.coalesce("sources", F.array().cast(lists.schema["sources"].dataType)))


def with_placeholders(entity: DataFrame, graph: DataFrame) -> DataFrame:
    """Entities and, for ends of triples without one, placeholders labelled with their id."""
    ends = graph.select(F.col("s").alias("id")).union(graph.select("o")).distinct()
    missing = ends.join(entity, "id", "left_anti").select("id", F.col("id").alias("label"), F.lit("concept").alias("type"))
    return entity.select("id", "label", "type").union(missing)


def latest(entity: DataFrame, by: str = "doc_id") -> DataFrame:
    """(id, label, type): of extracted entities the one of the latest document."""
    return entity.groupBy("id").agg(F.max_by(F.struct("label", "type"), by).alias("e")).select("id", "e.label", "e.type")


# --- storage
def save(nodes: DataFrame, graph: DataFrame, path: str) -> None:
    """Parquet tables, and a manifest with the schema's version written last, so a broken save is no graph."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    graph.write.mode("overwrite").parquet(f"{path}/triples")
    nodes.sparkSession.createDataFrame([(SCHEMA_VERSION,)], "schema_version int").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, triples); a missing graph or another schema version is an error."""
    version = spark.read.schema("schema_version int").json(f"{path}/manifest").first()
    if version is None or version.schema_version != SCHEMA_VERSION:
        raise ValueError(f"graph at {path}: schema version {version and version.schema_version}, not {SCHEMA_VERSION}")
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/triples")


def exported(nodes: DataFrame, graph: DataFrame) -> DataFrame:
    """(kind, json): one line of JSON a node and triple."""
    line = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*sorted(df.columns))).alias("json"))
    return line(nodes, "node").union(line(graph, "triple"))


def repaired(graph: DataFrame) -> DataFrame:
    """Loaded triples (s, p, o, count, confidence, sources) whose count is at least the number of sources, and 1; the rest stays as it was."""
    n = F.coalesce(F.size(F.coalesce("sources", F.array().cast("array<string>"))), F.lit(0))
    return graph.withColumn("count", F.greatest(F.coalesce("count", F.lit(1)), n, F.lit(1)).cast("long"))


def cleaned(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with their text as extraction reads it, without the marks of markdown."""
    return docs.withColumn(text_col, plain_markdown(F.col(text_col)))


def build(docs: DataFrame, path: str, *, least_entities: int = 50, least_relations: int = 100, markdown: bool = True, **columns: str) -> dict:
    """The build job: clean (``markdown``), extract, aggregate, save; fails under the floors, after the graph is saved.  Returns the counts and the top entities."""
    docs = cleaned(docs, columns.get("text_col", "text")) if markdown else docs
    own, found = extracted(docs, **columns)
    graph = scratch.written(triples(found), "triples")
    save(with_placeholders(latest(own), graph), graph, path)
    nodes, graph = load(docs.sparkSession, path)
    told = {"entities": nodes.count(), "relations": graph.count(), "top": [(r.id, r.degree) for r in degrees(graph).collect()]}
    if told["entities"] < least_entities or told["relations"] < least_relations:
        raise RuntimeError(f"graph too small: {told['entities']} entities of {least_entities}, {told['relations']} relations of {least_relations}")
    return told


# --- queries
def counts(nodes: DataFrame, graph: DataFrame) -> DataFrame:
    """(entities, relations)"""
    return nodes.agg(F.count(F.lit(1)).alias("entities")).join(graph.select("s", "p", "o").distinct().agg(F.count(F.lit(1)).alias("relations")))  # a row each


def known(asked: DataFrame, nodes: DataFrame, id_col: str = "id") -> DataFrame:
    """Adds ``known`` to rows of ids."""
    return asked.join(nodes.select(F.col("id").alias(id_col), F.lit(True).alias("known")), id_col, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def of_type(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.filter(F.col("type") == kind)


def pattern(graph: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    for name, value in (("s", s), ("p", p), ("o", o)):
        graph = graph if value is None else graph.filter(F.col(name) == value)
    return graph


def neighbours(graph: DataFrame, nodes: DataFrame, node: str, predicate: str | None = None) -> DataFrame:
    """(id, label, type, p) of the ends of a node's triples, once each and predicate; none of an unknown node."""
    return pattern(graph, s=node, p=predicate).select(F.col("o").alias("id"), "p").join(nodes.select("id", "label", "type"), "id")


def facts(graph: DataFrame, node: str) -> DataFrame:
    """Triples that begin or end at the node; a loop comes twice."""
    return pattern(graph, s=node).union(pattern(graph, o=node))


def compare(graph: DataFrame, a: str, b: str) -> DataFrame:
    """(kind, id, predicates): common, a_only and b_only out-neighbours, and the direct relations a_to_b and b_to_a."""
    rows = graph.filter(F.col("s").isin(a, b)).groupBy("o").agg(F.max((F.col("s") == a).cast("int")).alias("a"), F.max((F.col("s") == b).cast("int")).alias("b"), F.array_join(F.array_sort(F.collect_set("p")), ",").alias("predicates"))
    kind = F.when((F.col("a") == 1) & (F.col("b") == 1), "common").when(F.col("a") == 1, "a_only").otherwise("b_only")
    direct = [pattern(graph, s=x, o=y).groupBy("o").agg(F.array_join(F.array_sort(F.collect_set("p")), ",").alias("predicates")).select(F.lit(name).alias("kind"), F.col("o").alias("id"), "predicates") for name, x, y in (("a_to_b", a, b), ("b_to_a", b, a))]
    return rows.select(kind.alias("kind"), F.col("o").alias("id"), "predicates").union(direct[0]).union(direct[1])


def degrees(graph: DataFrame, k: int = 10) -> DataFrame:
    """The k entities with most ends of triples."""
    ends = graph.select(F.col("s").alias("id")).union(graph.select("o"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree")).orderBy(F.desc("degree"), "id").limit(k)


def resolved(asked: DataFrame, nodes: DataFrame, key: str, label: str) -> DataFrame:
    """(key, id): the first slug candidate of each row's label that the graph has; rows without one are left out."""
    tried = asked.select(key, F.posexplode(slug_candidates(F.col(label))).alias("pos", "id"))
    return tried.join(nodes.select("id"), "id").groupBy(key).agg(F.min_by("id", "pos").alias("id"))


def all_facts(graph: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """(key, rank, s, p, o, confidence) of every row's node ``id``: facts by confidence, then count, then name."""
    out = asked.join(graph, asked["id"] == graph["s"]).select(key, "s", "p", "o", "confidence", "count")
    into = asked.join(graph, asked["id"] == graph["o"]).select(key, "s", "p", "o", "confidence", "count")
    order = Window.partitionBy(key).orderBy(F.desc("confidence"), F.desc("count"), "s", "p", "o")
    return out.union(into).withColumn("rank", F.row_number().over(order)).drop("count")


def sentence_of(s: Column, p: Column, o: Column) -> Column:
    """A fact in words."""
    words = lambda c: F.translate(c, "_", " ")
    return F.concat(words(s), F.lit(" "), words(p), F.lit(" "), words(o), F.lit("."))


def sentences_of(found: DataFrame, key: str, most: int = 8) -> DataFrame:
    """(key, facts): up to ``most`` facts of each row as an array of sentences."""
    own = found.filter(F.col("rank") <= most).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", sentence_of(F.col("s"), F.col("p"), F.col("o")).alias("t")))).alias("x"))  # ``most`` at most
    return own.select(key, F.transform("x", lambda v: v["t"]).alias("facts"))
