"""From gated chunks and facts to answers: context, symbolic stage, answer forms, prompts and assembly.  The wording is our own."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import annotate, graph, hybrid

#: Chunks in a context, facts in a context, chunks that comparison and explanation show.
CONTEXT_CHUNKS, CONTEXT_FACTS, COMPARED, EXPLAINED = 2, 8, 5, 3
NOT_FOUND = "Nothing in the indexed documents answers this."
FAILED = "This question could not be processed."
CHUNKS = "array<struct<rank:int,text:string,score_cosine:double>>"


class Generator(Protocol):
    """Something that turns a prompt column into an answer column; null where it has none."""

    name: str

    def __call__(self, prompt: Column) -> Column: ...


def gate_threshold(raw: str | None) -> float:
    """The gate's threshold as configured; what is no number from 0 to 1 is ignored."""
    try:
        value = float(raw or "")
    except ValueError:
        return hybrid.GATE
    return value if 0 <= value <= 1 else hybrid.GATE


def collected(gated: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, text, chunks) of every query: its gated chunks, as many as the search gave, by rank."""
    own = gated.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), "text", "score_cosine"))).alias("chunks"))  # k at most
    return queries.join(own, "query_id", "left").withColumn("chunks", F.coalesce("chunks", F.array().cast(CHUNKS)))


# --- the symbolic stage
def symbolic(queries: DataFrame, nodes: DataFrame, triples: DataFrame) -> DataFrame:
    """(query_id, structure, entity, a, b, facts, compared, confidence): what the graph says about a question.

    A comparison of two known entities gives what they have in common and apart,
    a question about a known entity its facts.  The confidence is 0.85 with
    facts, 0.7 with chunks only (``n_chunks``, where the queries have it), else 0.4.
    """
    q = queries.select("query_id", annotate.structure(F.col("text")).alias("structure"), annotate.comparison_pair(F.col("text")).alias("pair"), annotate.definition_entity(F.col("text")).alias("about"), (F.col("n_chunks") if "n_chunks" in queries.columns else F.lit(0)).alias("n_chunks"))
    named = q.select("query_id", F.explode(F.array(F.struct(F.lit("entity").alias("role"), F.col("about").alias("label")), F.struct(F.lit("a").alias("role"), F.col("pair.a").alias("label")), F.struct(F.lit("b").alias("role"), F.col("pair.b").alias("label")))).alias("x"))
    named = named.select("query_id", "x.role", "x.label").filter("label IS NOT NULL").withColumn("key", F.struct("query_id", "role"))
    known = graph.resolved(named, nodes, "key", "label").select("key.query_id", "key.role", "id")
    wide = known.groupBy("query_id").agg(*[F.max(F.when(F.col("role") == r, F.col("id"))).alias(r) for r in ("entity", "a", "b")])
    told = graph.sentences_of(graph.all_facts(triples, known.filter("role = 'entity'").select("query_id", "id"), "query_id"), "query_id", CONTEXT_FACTS)
    ends = known.filter("role <> 'entity'").join(triples.select(F.col("s").alias("id"), "o"), "id").groupBy("query_id", "o").agg(F.max((F.col("role") == "a").cast("int")).alias("a"), F.max((F.col("role") == "b").cast("int")).alias("b"))
    kind = F.when((F.col("a") == 1) & (F.col("b") == 1), 0).when(F.col("a") == 1, 1).otherwise(2)
    sides = ends.withColumn("kind", kind).groupBy("query_id", "kind").agg(F.slice(F.array_sort(F.collect_list("o")), 1, CONTEXT_FACTS).alias("ids"))  # a node's neighbours
    name = F.element_at(F.array(F.lit("in common"), F.lit("only the first"), F.lit("only the second")), F.col("kind") + 1)
    lines = sides.select("query_id", "kind", F.concat(name, F.lit(": "), F.translate(F.array_join("ids", ", "), "_", " ")).alias("line"))
    compared = lines.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "line"))), lambda x: x["line"]), "; ").alias("compared"))  # three at most
    out = q.join(wide, "query_id", "left").join(told, "query_id", "left").join(compared.join(wide.filter("a IS NOT NULL AND b IS NOT NULL").select("query_id"), "query_id", "left_semi"), "query_id", "left")
    facts = F.coalesce("facts", F.array().cast("array<string>"))
    sure = F.when((F.size(facts) > 0) | F.col("compared").isNotNull(), 0.85).when(F.col("n_chunks") > 0, 0.7).otherwise(0.4)
    return out.select("query_id", "structure", "entity", "a", "b", facts.alias("facts"), "compared", sure.alias("confidence"))


# --- context, prompts
def context(chunks: Column, facts: Column, most: int = CONTEXT_CHUNKS) -> Column:
    """Texts for a generator: the first chunks, then the facts, blanks left out."""
    texts = F.concat(F.transform(F.slice(chunks, 1, most), lambda c: c["text"]), F.slice(F.coalesce(facts, F.array().cast("array<string>")), 1, CONTEXT_FACTS))
    return F.filter(texts, lambda t: F.trim(F.coalesce(t, F.lit(""))) != "")


def prompt(query: Column, texts: Column, strict: bool = True) -> Column:
    """The question after its context; strict prompts ask for nothing but the context, and an empty context gets the bare question."""
    rule = "Answer from these passages only; say so if they do not answer it.\n\n" if strict else "Use these passages where they help.\n\n"
    listed = F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), t)), "\n")
    return F.when(F.size(texts) > 0, F.concat(F.lit(rule), listed, F.lit("\n\nQuestion: "), query)).otherwise(F.concat(F.lit("Question: "), query))


# --- answer forms
def shown(chunks: Column) -> Column:
    """Chunks that are shown: the first, and the others only if the second's cosine is nearly the first's."""
    near = F.coalesce(F.get(chunks, F.lit(1))["score_cosine"] >= hybrid.SECOND * F.get(chunks, F.lit(0))["score_cosine"], F.lit(False))
    return F.when(near, chunks).otherwise(F.slice(chunks, 1, 1))


def form(n_chunks: Column, n_memory: Column, structure: Column) -> Column:
    """Which form an answer takes."""
    by_chunks = F.when(structure.isin("comparison", "explanation"), structure).otherwise("factual")
    return F.when((n_chunks == 0) & (n_memory == 0), "not_found").when(n_chunks > 0, by_chunks).otherwise("conversation")


def rendered(kind: Column, chunks: Column, n_memory: Column, query: Column) -> Column:
    """The answer in its form, from chunks (all gated for comparisons, those shown for the others)."""
    texts = F.transform(chunks, lambda c: c["text"])
    own = F.transform(shown(chunks), lambda c: c["text"])
    bullets = lambda a: F.array_join(F.transform(a, lambda t: F.concat(F.lit("\n- "), t)), "")
    rest = lambda a, n: F.slice(a, 2, n)
    numbered = F.array_join(F.transform(F.slice(texts, 1, COMPARED), lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t)), "\n")
    greets = annotate.query_type(query) == "conversation"
    talk = F.when(n_memory <= 1, "Hello. What would you like to know?").when(greets, F.concat(F.lit("We have had "), n_memory.cast("string"), F.lit(" turns so far. Go on."))).otherwise("Could you ask that in another way?")
    return (
        F.when(kind == "factual", F.concat(F.get(own, F.lit(0)), bullets(rest(own, 100)))).when(kind == "comparison", numbered)
        .when(kind == "explanation", F.concat(F.get(own, F.lit(0)), F.when(F.size(own) > 1, F.concat(F.lit("\nAlso:"), bullets(rest(own, EXPLAINED - 1)))).otherwise("")))
        .when(kind == "conversation", talk).otherwise(NOT_FOUND)
    )


def code_report(n_checked: Column, n_valid: Column, n_skipped: Column, errors: Column) -> Column:
    """The report on verified code blocks."""
    head = F.concat(n_valid.cast("string"), F.lit(" of "), n_checked.cast("string"), F.lit(" code blocks are valid"), F.when(n_skipped > 0, F.concat(F.lit(", "), n_skipped.cast("string"), F.lit(" skipped"))).otherwise(""), F.lit("."))
    return F.concat(head, F.array_join(F.transform(F.coalesce(errors, F.array().cast("array<string>")), lambda e: F.concat(F.lit("\n- "), e)), ""))


def generated(rows: DataFrame, generator: Generator | None = None, strict: bool = True) -> DataFrame:
    """Adds (answer, form, generated_by, confidence) to rows (query_id, text, chunks, facts, structure, n_memory[, code_report]).

    A code report comes first, then a generator that gives an answer, then the
    form.  In strict mode an empty context is refused and never generated from.
    """
    report = F.col("code_report") if "code_report" in rows.columns else F.lit(None).cast("string")
    texts = context(F.col("chunks"), F.col("facts"))
    out = rows.withColumn("form", F.when(report.isNotNull(), "code").otherwise(form(F.size("chunks"), F.col("n_memory"), F.col("structure"))))
    allowed = (F.size(texts) > 0) if strict else F.lit(True)
    model = F.when(allowed, generator(prompt(F.col("text"), texts, strict))) if generator else F.lit(None).cast("string")
    out = out.withColumn("_model", model).withColumn("_report", report)
    by = F.when(F.col("_report").isNotNull(), "code").when(F.col("_model").isNotNull(), generator.name if generator else "model").otherwise("template")
    answer = F.coalesce("_report", "_model", rendered(F.col("form"), F.col("chunks"), F.col("n_memory"), F.col("text")))
    return out.withColumns({"answer": answer, "generated_by": by, "confidence": F.when(by == "template", 0.6).otherwise(0.7)}).drop("_model", "_report")


class Extractive:
    """The offline generator: the first passage of the prompt."""

    name = "extractive"

    def __call__(self, prompt: Column) -> Column:
        first = F.regexp_extract(prompt, r"(?m)^\[1\] (.*)$", 1)
        return F.when(first != "", first)


def assembled(outputs: Mapping[str, Column] | list[Column]) -> Column:
    """The last stage's output that isn't null, in order of the stages; else a fixed text."""
    columns = list(outputs.values()) if isinstance(outputs, Mapping) else outputs
    return F.coalesce(*reversed(columns), F.lit(FAILED))


def structure_of(rows: DataFrame, names: tuple[str, ...] = ("structure", "structure_type")) -> Column:
    """The structure column by its present or its former name; explanation without either."""
    return F.coalesce(*[F.col(n) for n in names if n in rows.columns], F.lit("explanation"))


Stage = Callable[[DataFrame], DataFrame]
