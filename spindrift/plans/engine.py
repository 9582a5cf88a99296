"""The query pipeline over a batch or a stream of questions: route, then the stages of each kind, then assembly."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Protocol

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import annotate, answer, graph, hybrid, intent, memory, metrics, verify
from ..operators.store import Store, retrieval_confidence
from ..sources import scratch
from ..streaming.counters import Counters, counters


class Module(Protocol):
    """A stage: ``run`` takes queries (query_id, text, ...) and gives rows by query_id."""

    name: str

    def run(self, queries: DataFrame, so_far: dict[str, DataFrame]) -> DataFrame: ...

    def describe(self) -> dict: ...


class Retrieve:
    name = "retrieve"

    def __init__(self, store: Store, k: int = 5, threshold: float = hybrid.GATE):
        self.store, self.k, self.threshold = store, k, threshold

    def run(self, queries: DataFrame, so_far: dict[str, DataFrame]) -> DataFrame:
        """(query_id, chunks, retrieval_confidence): the chunks that the gate lets through."""
        found = self.store.search(queries.select("query_id", "text"), self.k)
        gated = hybrid.gate(found, queries.select("query_id", "text"), self.store.chunks.select("id", "text"), self.threshold) if self.store.count() else found.withColumn("text", F.lit(""))
        out = answer.collected(gated, queries.select("query_id"))
        return out.join(retrieval_confidence(found, queries).select("query_id", F.col("confidence").alias("retrieval_confidence")), "query_id")

    def describe(self) -> dict:
        return self.store.describe()


class Symbolic:
    name = "symbolic"
    #: Paths whose graph couldn't be read, and why.
    failed: dict[str, str] = {}

    def __init__(self, nodes: DataFrame, triples: DataFrame):
        self.nodes, self.triples = nodes, triples

    @classmethod
    def lazy(cls, spark: SparkSession, path: str) -> "Symbolic | None":
        """The saved graph's stage, or None where there is no usable graph; the stage is then skipped.

        A failed load is remembered with its reason (``failed``) and not tried
        again until ``forget``; other errors than those of reading are raised.
        """
        if path in cls.failed:
            return None
        try:
            return cls(*graph.load(spark, path))
        except (AnalysisException, ValueError) as e:  # no such folder; another schema version
            cls.failed[path] = f"{type(e).__name__}: {str(e).splitlines()[0]}"
            return None

    @classmethod
    def forget(cls, path: str) -> None:
        cls.failed.pop(path, None)

    def run(self, queries: DataFrame, so_far: dict[str, DataFrame]) -> DataFrame:
        chunks = so_far.get("retrieve")
        rows = queries.select("query_id", "text")
        if chunks is not None:
            rows = rows.join(chunks.select("query_id", F.size("chunks").alias("n_chunks")), "query_id", "left")
        out = answer.symbolic(rows, self.nodes, self.triples)
        lines = F.when(F.col("compared").isNotNull(), F.concat(F.array("compared"), F.col("facts"))).otherwise(F.col("facts"))
        return out.select("query_id", lines.alias("facts"), F.col("confidence").alias("symbolic_confidence"))

    def describe(self) -> dict:
        return {"stage": self.name, "healthy": True, "capabilities": ["facts", "compare"]}


class Memory:
    name = "memory"

    def __init__(self, turns: DataFrame, session: str = "conv_id"):
        self.turns, self.session = turns, session

    def run(self, queries: DataFrame, so_far: dict[str, DataFrame]) -> DataFrame:
        """(query_id, n_memory): turns so far of the query's session, if queries have one."""
        if self.session not in queries.columns:
            return queries.select("query_id", F.lit(0).cast("long").alias("n_memory"))
        told = memory.context(self.turns, key=self.session).select(self.session, "turn_count")
        return queries.select("query_id", self.session).join(told, self.session, "left").select("query_id", F.coalesce("turn_count", F.lit(0)).cast("long").alias("n_memory"))

    def describe(self) -> dict:
        return {"stage": self.name, "healthy": True, "capabilities": ["history", "last_turns"]}


class Verify:
    name = "verify"

    def run(self, queries: DataFrame, so_far: dict[str, DataFrame]) -> DataFrame:
        done = verify.verify_stage(queries.select("query_id", "text"))
        told = answer.code_report(F.col("n_checked"), F.col("n_valid"), F.col("n_skipped"), F.col("errors"))
        return done.filter("n_blocks > 0").select("query_id", told.alias("code_report"))

    def describe(self) -> dict:
        return {"stage": self.name, "healthy": True, "capabilities": sorted(set(verify.ALIASES.values()))}


class Engine:
    """Stages by name; those that a kind of question asks for and that aren't there are skipped, and one that fails leaves an error and the others go on."""

    def __init__(self, classifier: intent.Intent | None = None, generator: answer.Generator | None = None, strict: bool = True):
        self.classifier, self.generator, self.strict = classifier, generator, strict
        self.modules: dict[str, Module] = {}

    def register(self, module: Module | None) -> "Engine":
        if module is not None:
            self.modules[module.name] = module
        return self

    def health(self) -> dict[str, bool]:
        return {name: bool(m.describe().get("healthy")) for name, m in self.modules.items()}

    def describe(self) -> list[dict]:
        own = {"stage": "generate", "healthy": True, "capabilities": [self.generator.name if self.generator else "template"]}
        return [*[m.describe() for m in self.modules.values()], own]

    def process(self, queries: DataFrame) -> DataFrame:
        """(query_id, text, kind, domain, answer, form, generated_by, confidence, errors) of questions (query_id, text[, session])."""
        rows = scratch.written(intent.routed(queries, self.classifier), "routed")  # every stage reads it, and plans begin anew there
        done: dict[str, DataFrame] = {}
        errors: dict[str, str] = {}
        for name in ("verify", "memory", "retrieve", "symbolic"):
            if name in self.modules:
                wanted = rows.filter(F.array_contains("stages", name))
                try:
                    done[name] = scratch.written(self.modules[name].run(wanted, done), name)  # run here, so its failure is its own
                except Exception as e:  # a stage's failure is part of the answer
                    errors[name] = f"{name}: {type(e).__name__}"
        for own in done.values():
            rows = rows.join(own, "query_id", "left")
        for column, kind in (("chunks", answer.CHUNKS), ("facts", "array<string>"), ("n_memory", "long"), ("code_report", "string")):
            empty = F.array().cast(kind) if kind.startswith("array") else F.lit(0 if kind == "long" else None).cast(kind)
            rows = rows.withColumn(column, F.coalesce(F.col(column), empty) if column in rows.columns else empty)
        rows = rows.withColumn("structure", annotate.structure(F.col("text")))
        out = answer.generated(rows, self.generator, self.strict)
        failed = F.filter(F.array(*[F.when(F.array_contains("stages", n), F.lit(t)) for n, t in errors.items()]).cast("array<string>"), lambda x: x.isNotNull())
        return out.select("query_id", "text", "kind", "domain", answer.assembled([F.col("answer")]).alias("answer"), "form", "generated_by", "confidence", failed.alias("errors"))

    def process_stream(self, queries: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, stats: Callable[[DataFrame], None] | None = None, kept: Counters | None = None) -> StreamingQuery:
        """The same for a stream of questions; each micro-batch goes to ``sink``, and its counters to ``stats`` even if the sink fails.

        ``kept`` adds the batches' counters up, each batch once.  A question's
        latency is its share of its batch's time.
        """

        def answer_batch(rows: DataFrame, batch: int) -> None:
            began = time.time()
            done = scratch.written(self.process(rows), "answers")  # computed once for the sink and the counters
            each = F.lit((time.time() - began) / max(1, done.count()))
            try:
                sink(done, batch)
            finally:
                told = done.select("query_id", "kind", "generated_by", each.alias("latency_s"), F.current_timestamp().alias("at"))
                if stats:
                    stats(metrics.usage(told))
                if kept:
                    kept.add(counters(told, "kind", "at", "query_id", "latency_s", "generated_by"), batch)

        return queries.writeStream.foreachBatch(answer_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
