"""Evaluation metrics, usage counters and label splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import significant_words
from ..sources import scratch
from . import selection


def stratified_split(rows: DataFrame, label: str, id_col: str, ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``split``: of each class max(1, rint(n x ratio)) rows, the smallest hashes of their id, validate."""
    if not 0 < ratio < 1:
        raise ValueError("ratio must lie between 0 and 1")
    spread = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))
    code = F.conv(F.substring(spread, 1, 13), 16, 10).cast("long")  # in the order of the hashes, 52 bits of them: doubles hold these exactly
    most = lambda n: F.greatest(F.lit(1.0), F.rint(n * ratio))
    last = selection.selected(rows.withColumn("_code", code), "_code", {"last": lambda n: most(n) - 1}, label)
    last = scratch.written(last.select(F.col("k").alias("_k"), F.col("value").alias("_last"), most(F.col("n")).alias("_most")), "classes")
    with_last = rows.withColumns({"_code": code, "_md5": spread}).join(F.broadcast(last) if last.count() <= selection.KEYS else last, F.col(label).eqNullSafe(F.col("_k")))
    below = F.when(F.col("_code") < F.col("_last"), 1)
    under = with_last.groupBy(label).agg(F.count(below).alias("_under")).withColumnRenamed(label, "_c")
    ties = with_last.filter("_code = _last").join(under, F.col(label).eqNullSafe(F.col("_c")))
    rank = F.row_number().over(Window.partitionBy(label).orderBy("_md5", id_col))  # rows of one hash
    tied = ties.withColumn("split", F.when(F.col("_under") + rank <= F.col("_most"), "val").otherwise("train"))
    rest = with_last.filter("_code <> _last").withColumn("split", F.when(F.col("_code") < F.col("_last"), "val").otherwise("train"))
    names = [*rows.columns, "split"]
    return rest.select(names).union(tied.select(names))


def class_balance(rows: DataFrame, label: str) -> DataFrame:
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def accuracy(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """(label, is_total, accuracy, n): one row a class, null included, and the total."""
    right = F.round(F.avg(F.coalesce(F.col(label) == F.col(predicted), F.lit(False)).cast("double")), 6)
    return rows.rollup(label).agg(F.grouping_id().cast("int").alias("is_total"), right.alias("accuracy"), F.count(F.lit(1)).alias("n"))


def latency_summary(rows: DataFrame, value: str, key: str, limit: float = 1000.0) -> DataFrame:
    told = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.max(value).alias("max"), F.bool_and(F.col(value) < limit).alias("all_under"))
    middle = selection.median(rows, value, key).select("k", F.round("median", 6).alias("median"))
    return told.join(middle, F.col(key).eqNullSafe(F.col("k")), "left").select(key, "n", "median", "mean", "max", "all_under")


def nearest_rank(rows: DataFrame, value: str, shares: list[float], key: str | None = None) -> DataFrame:
    """(key, share, value): the value at place rint(share x (n - 1)), halves to even, of the sorted values."""
    found = selection.selected(rows, value, {str(s): lambda n, s=s: F.rint(F.lit(s) * (n - 1)) for s in shares}, key)
    return found.select(*([F.col("k").alias(key)] if key else []), F.col("place").cast("double").alias("share"), "value")


def grounded(response: Column, context: Column) -> Column:
    """Whether an answer and its context share a significant word."""
    return F.arrays_overlap(significant_words(response), significant_words(context))


def summary(results: DataFrame) -> DataFrame:
    """One row over (query, expect_refusal, refused, generated_by, latency_s, response_chars, grounded).

    The refusal rate is that of the queries that should be refused, 1 without
    any; the grounding rate that of generated answers, 0 without any.
    """
    model = ~F.col("refused") & ~F.col("generated_by").isin("template", "none")
    n = lambda c: F.count(F.when(c, 1))
    refusals, written = n(F.col("expect_refusal")), n(model)
    told = results.agg(
        F.count(F.lit(1)).alias("n"), n(F.col("refused")).alias("n_refused"), written.alias("n_generated"),
        F.when(refusals > 0, n(F.col("expect_refusal") & F.col("refused")) / refusals).otherwise(1.0).alias("refusal_rate"),
        F.when(written > 0, n(model & F.col("grounded")) / written).otherwise(0.0).alias("grounding_rate"),
        F.round(F.avg("latency_s"), 6).alias("mean"), F.max("latency_s").alias("max"),
        F.coalesce(F.bool_and(F.when(F.col("refused"), F.col("latency_s") < 1)), F.lit(True)).alias("refusals_under_1s"),
    )
    p95 = nearest_rank(results, "latency_s", [0.95]).select(F.col("value").alias("p95"))  # one row
    middle = selection.median(results, "latency_s").select(F.round("median", 6).alias("median"))  # one row
    return told.join(middle, how="left").join(p95, how="left")


def run_cases(cases: DataFrame, process) -> DataFrame:
    """Result rows for ``summary`` of cases (query_id, text, expect_refusal[, context]) that ``process``, an engine's, answers as one batch; the latency is the batch's share of a case."""
    import time

    began = time.time()
    done = process(cases.select("query_id", "text")).select("query_id", "answer", "form", "generated_by").collect()  # a bounded set of cases
    each = (time.time() - began) / max(1, len(done))
    told = cases.sparkSession.createDataFrame([tuple(r) for r in done], "query_id long, answer string, form string, generated_by string")
    context = F.col("context") if "context" in cases.columns else F.col("text")
    rows = cases.join(told, "query_id")
    return rows.select(F.col("text").alias("query"), "expect_refusal", (F.col("form") == "not_found").alias("refused"), "generated_by", F.lit(each).alias("latency_s"), F.length("answer").alias("response_chars"), grounded(F.col("answer"), context).alias("grounded"))


def hit_at_k(found: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, hit): whether any result (query_id, language, origin) has the query's language and one of its ``keywords`` in its origin; queries without results have none."""
    q = asked.select("query_id", F.col("language").alias("_l"), "keywords")
    match = (F.col("language") == F.col("_l")) & F.exists("keywords", lambda k: F.contains(F.lower("origin"), F.lower(k)))
    hits = found.join(q, "query_id").groupBy("query_id").agg(F.bool_or(F.coalesce(match, F.lit(False))).alias("hit"))
    return asked.select("query_id").join(hits, "query_id", "left").select("query_id", F.coalesce("hit", F.lit(False)).alias("hit"))


def sweep(truth: DataFrame, search, settings: list) -> DataFrame:
    """(setting, recall): mean recall of ``search(setting)`` against exact results, for probe or shard counts."""
    from .search import recall

    out = None
    for s in settings:
        own = recall(search(s), truth).agg(F.round(F.avg("recall"), 6).alias("recall")).select(F.lit(int(s)).cast("long").alias("setting"), "recall")
        out = own if out is None else out.union(own)
    return out


def usage(queries: DataFrame) -> DataFrame:
    """(kind, generated_by, n, mean_latency, last_id) of recorded queries (query_id, kind, generated_by, latency_s): counters of each kind and generator, of each kind (generator null) and of all (both null), told apart by ``level``."""
    return queries.rollup("kind", "generated_by").agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n"), F.round(F.avg("latency_s"), 6).alias("mean_latency"), F.max("query_id").alias("last_id"))


def report(told: DataFrame) -> DataFrame:
    """(line): a summary row in words."""
    pct = lambda c: F.concat(F.round(F.col(c) * 100, 1).cast("string"), F.lit(" %"))
    return told.select(F.concat_ws("; ", F.concat(F.col("n").cast("string"), F.lit(" queries")), F.concat(F.lit("refusal rate "), pct("refusal_rate")), F.concat(F.lit("grounding rate "), pct("grounding_rate")), F.concat(F.lit("median "), F.col("median").cast("string"), F.lit(" s"))).alias("line"))
