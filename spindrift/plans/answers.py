"""Questions about questions: annotation, routing, the symbolic stage, answers and the engine, over small inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotate, answer, hybrid, intent
from ..sources import scratch
from . import fixtures as fx
from .base import example, query, table
from .engine import Engine, Memory, Retrieve, Symbolic, Verify
from .graphs import small
from .hybrids import gated, store


@example(fx.golden("query_id structure", [(1, "explanation"), (2, "comparison"), (3, "explanation"), (4, "explanation"), (5, "explanation"), (6, "explanation"), (7, "explanation"), (8, "comparison"), (9, "analysis"), (10, "explanation"), (11, "explanation"), (12, "explanation")]))
def response_structure(spark, sf):
    return fx.questions(spark).select("query_id", annotate.structure(F.col("text")).alias("structure"))


@example(fx.golden("query_id a b", [(2, "Danube", "Rhine"), (8, "cat", "dog")]))
def comparison_pair(spark, sf):
    return fx.questions(spark).select("query_id", annotate.comparison_pair(F.col("text")).alias("p")).filter("p IS NOT NULL").select("query_id", "p.*")


@example(fx.golden("query_id entity", [(1, "quasar"), (7, "Ada Lovelace"), (11, "entropy"), (12, "énergie")]))
def definition_entity(spark, sf):
    return fx.questions(spark).select("query_id", annotate.definition_entity(F.col("text")).alias("entity")).filter("entity IS NOT NULL")


_R, _C = "retrieve,symbolic,generate", "memory,generate"


@example(fx.golden("query_id kind stages domain", [(1, "factual", _R, None), (2, "conversation", _C, None), (3, "reasoning", _R, "technology"), (4, "conversation", _C, None), (5, "creative", "intent,generate", "geography"), (6, "code", "verify,generate", "code"), (7, "factual", _R, None), (8, "factual", _R, None), (9, "conversation", _C, "language"), (10, "conversation", _C, None), (11, "conversation", _C, None), (12, "factual", _R, "science")]))
def routed_questions(spark, sf):
    r = annotate.routed(F.col("text"))
    return fx.questions(spark).select("query_id", r.alias("r")).select("query_id", "r.kind", F.array_join("r.stages", ",").alias("stages"), "r.domain")


@example(fx.golden("query_id kind reason", [(1, "complex", "classifier"), (2, "conversation", "cues"), (3, "reasoning", "cues"), (4, "creative", "classifier"), (6, "code", "code fence")]))
def classifier_routes(spark, sf):
    """A sure label wins over cues, an unsure or unknown one doesn't, and a code fence wins over all."""
    told = fx.frame(spark, [(1, "complex", 0.5), (2, "complex", 0.49), (3, "weather", 0.9), (4, "creative", 0.8), (6, "factual", 1.0)], "query_id long, label string, sure double")
    rows = fx.questions(spark).join(told, "query_id")
    return rows.select("query_id", annotate.routed(F.col("text"), F.col("label"), F.col("sure")).alias("r")).select("query_id", "r.kind", "r.reason")


_ABOUT = [(1, "What is Python?"), (2, "Compare Spark and DuckDB"), (3, "What is a quasar?"), (4, "Why?")]


def _symbolic(spark):
    nodes, triples, _, _ = small(spark)
    rows = fx.frame(spark, [(i, t, 2 if i == 3 else 0) for i, t in _ABOUT], "query_id long, text string, n_chunks int")
    return answer.symbolic(rows, nodes, triples)


@example(fx.golden("query_id structure entity facts compared confidence", [(1, "explanation", "python", "python is a language.", None, 0.85), (2, "comparison", None, "", "in common: arrow, optimizer, spark; only the first: jvm", 0.85), (3, "explanation", None, "", None, 0.7), (4, "explanation", None, "", None, 0.4)]))
def symbolic_stage(spark, sf):
    return _symbolic(spark).select("query_id", "structure", "entity", F.array_join("facts", "|").alias("facts"), "compared", "confidence")


def _answered(spark, generator=None, strict=True):
    rows, queries = gated(spark)
    out = answer.collected(rows, queries)
    facts = fx.frame(spark, [(1, ["danube is a river."]), (3, ["x of y."])], "query_id long, facts array<string>")
    out = out.join(facts, "query_id", "left").withColumn("facts", F.coalesce("facts", F.array().cast("array<string>")))
    structure = F.when(F.col("query_id") == 1, "comparison").when(F.col("query_id") == 5, "explanation").otherwise(annotate.structure(F.col("text")))
    return answer.generated(out.withColumn("structure", structure).withColumn("n_memory", F.when(F.col("query_id") == 2, 3).otherwise(0).cast("long")), generator, strict)


@example(fx.golden("query_id texts", [(1, "Danube The Danube flows. far . away|second|danube is a river."), (2, ""), (3, "x of y."), (4, "the and for"), (5, "DÉBIT du fleuve")]))
def answer_context(spark, sf):
    return _answered(spark).select("query_id", F.array_join(answer.context(F.col("chunks"), F.col("facts")), "|").alias("texts"))


@example(fx.golden("query_id form generated_by answer", [(1, "comparison", "template", "1. Danube The Danube flows. far . away\n2. second"), (2, "conversation", "template", "Could you ask that in another way?"), (3, "not_found", "template", answer.NOT_FOUND), (4, "explanation", "template", "the and for"), (5, "explanation", "template", "DÉBIT du fleuve")]))
def answer_forms(spark, sf):
    return _answered(spark).select("query_id", "form", "generated_by", "answer")


@example(fx.golden("query_id generated_by answer confidence", [(1, "extractive", "Danube The Danube flows. far . away", 0.7), (2, "template", "Could you ask that in another way?", 0.6), (3, "extractive", "x of y.", 0.7), (4, "extractive", "the and for", 0.7), (5, "extractive", "DÉBIT du fleuve", 0.7)]))
def generated_answers(spark, sf):
    """A generator is asked only where there is context."""
    return _answered(spark, answer.Extractive()).select("query_id", "generated_by", "answer", "confidence")


_RULE = "Answer from these passages only; say so if they do not answer it.\n\n"


@example(fx.golden("query_id prompt", [(1, _RULE + "[1] Danube The Danube flows. far . away\n[2] second\n[3] danube is a river.\n\nQuestion: Where does the Danube flow?"), (2, "Question: What is entropy?"), (3, _RULE + "[1] x of y.\n\nQuestion: too far away"), (4, _RULE + "[1] the and for\n\nQuestion: the and"), (5, _RULE + "[1] DÉBIT du fleuve\n\nQuestion: quel débit ?")]))
def prompts(spark, sf):
    return _answered(spark).select("query_id", answer.prompt(F.col("text"), answer.context(F.col("chunks"), F.col("facts"))).alias("prompt"))


_SHOWN = [(1, [(1, "a", 0.9), (2, "b", 0.82)]), (2, [(1, "a", 0.9), (2, "b", 0.80), (3, "c", 0.79)]), (3, [])]


@example(fx.golden("query_id texts", [(1, "a|b"), (2, "a"), (3, "")]))
def shown_chunks(spark, sf):
    """Further chunks are shown only if the second is nearly as close as the first."""
    rows = fx.frame(spark, _SHOWN, f"query_id long, chunks {answer.CHUNKS}")
    return rows.select("query_id", F.array_join(F.transform(answer.shown(F.col("chunks")), lambda c: c["text"]), "|").alias("texts"))


@example(fx.golden("id text", [(1, "late"), (2, "early"), (3, answer.FAILED)]))
def assembled(spark, sf):
    rows = fx.frame(spark, [(1, "early", "late"), (2, "early", None), (3, None, None)], "id long, a string, b string")
    return rows.select("id", answer.assembled({"a": F.col("a"), "b": F.col("b")}).alias("text"))


@query(fx.golden("query_id kind form generated_by", [(1, "factual", "not_found", "template"), (2, "conversation", "not_found", "template"), (3, "reasoning", "not_found", "template"), (4, "conversation", "conversation", "template"), (5, "creative", "not_found", "template"), (6, "code", "code", "code"), (7, "factual", "not_found", "template"), (8, "factual", "not_found", "template"), (9, "conversation", "not_found", "template"), (10, "conversation", "not_found", "template"), (11, "conversation", "not_found", "template"), (12, "factual", "not_found", "template")]))
def engine_answers(spark, sf):
    """The whole chain: nothing in the tables answers these questions, the greeting's session has turns, and the code is reported on."""
    nodes, triples, _, _ = small(spark)
    engine = Engine().register(Retrieve(store(spark, sf), threshold=hybrid.GATE)).register(Symbolic(nodes, triples)).register(Memory(table(spark, sf, "conversations"))).register(Verify())
    session = F.when(F.col("query_id") == 4, F.lit(_session(spark, sf))).cast("long")
    return engine.process(fx.questions(spark).withColumn("conv_id", session)).select("query_id", "kind", "form", "generated_by")


def _session(spark, sf):
    return table(spark, sf, "conversations").agg(F.min("conv_id")).first()[0]


@query()
def intent_classify(spark, sf):
    """A multinomial classifier of languages over the offline encoder, fitted on every document with a language; texts are encoded once for both."""
    rows = table(spark, sf, "documents").dropna(subset=["lang"])
    rows = scratch.written(rows.select("doc_id", "lang", F.when(F.col("text").isNotNull(), hybrid.encoded(F.col("text"))).alias("v")), "features")
    names = tuple(r.lang for r in rows.select("lang").distinct().orderBy("lang").collect())  # every class of the model
    model = intent.fit(rows, names, label_col="lang", vector_col="v")
    return model.classify(rows.select("doc_id", "v"), vector_col="v").select("doc_id", "label", "confidence")


@example(fx.golden("query_id label confidence", [(1, None, None), (2, None, None)]))
def intent_without_model(spark, sf):
    return intent.stage(fx.questions(spark).filter("query_id < 3"), None).select("query_id", "label", "confidence")
