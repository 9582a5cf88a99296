"""The stored graph: batches, lookups by either end, compaction, streams."""

import random

import pytest
from pyspark.sql import functions as F

from spindrift.operators import graph, snapshots
from spindrift.operators.graphstore import Graph, stream

NAMES = ["Ada", "Bob", "Cleo", "NASA", "Dover", "Émile", "Rio Grande"]


def documents(spark, first, n):
    rng = random.Random(first)
    text = lambda: " ".join(f"{rng.choice(NAMES)} {rng.choice(['is a', 'has', 'uses', 'of', 'and'])} {rng.choice(['the ', ''])}{rng.choice(['tool', 'Ada', 'river', 'NASA'])}{rng.choice(['. ', ' '])}" for _ in range(rng.randrange(1, 7)))
    return spark.createDataFrame([(first + i, text()) for i in range(n)], "doc_id long, text string")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_batches_add_up(spark, tmp_path):
    docs = [documents(spark, 100 * i, 20) for i in range(3)]
    all_ = docs[0].union(docs[1]).union(docs[2])
    own, found = graph.extracted(all_)
    whole = graph.triples(found)
    g = Graph(spark, str(tmp_path))
    with pytest.raises(ValueError, match="no graph"):
        g.triples()
    for i, d in enumerate(docs):
        g = g.append(d, f"b{i}")
    assert rows(g.triples()) == rows(whole) and len(g.parts) == 3
    assert rows(g.nodes()) == rows(graph.with_placeholders(graph.latest(own), whole))
    assert rows(g.append(docs[1], "b1").triples()) == rows(whole)  # not twice
    assert rows(g.facts("ada")) == rows(graph.facts(whole, "ada")) and rows(g.degrees(4)) == rows(graph.degrees(whole, 4))
    one = g.compact()
    assert len(one.parts) == 1 and rows(one.triples()) == rows(whole) and rows(one.nodes()) == rows(g.nodes())
    assert rows(one.degrees(4)) == rows(graph.degrees(whole, 4)) and rows(one.into("tool")) == rows(graph.pattern(whole, o="tool"))
    assert rows(one.facts("nobody")) == [] and rows(Graph(spark, str(tmp_path), 1).triples()) == rows(graph.triples(graph.extracted(docs[0])[1]))
    plan = one.out_of("ada")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "PartitionFilters: [isnotnull(bucket" in plan
    assert rows(one.append(docs[0].withColumn("doc_id", F.col("doc_id") + 5000), "b9").triples()) == rows(graph.triples(found.union(graph.extracted(docs[0].withColumn("doc_id", F.col("doc_id") + 5000))[1])))


def test_a_failed_batch_is_not_there(spark, tmp_path, monkeypatch):
    g = Graph(spark, str(tmp_path)).append(documents(spark, 0, 5), "a")
    before = rows(g.triples())
    monkeypatch.setattr(snapshots, "publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        g.append(documents(spark, 50, 5), "b")
    monkeypatch.undo()
    assert rows(Graph(spark, str(tmp_path)).triples()) == before


def test_streamed_graph(spark, tmp_path):
    docs = documents(spark, 0, 30)
    docs.repartition(3).write.parquet(f"{tmp_path}/in")
    run = lambda: stream(spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), f"{tmp_path}/g", f"{tmp_path}/cp").awaitTermination()
    run()
    more = documents(spark, 500, 10)
    more.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert rows(Graph(spark, f"{tmp_path}/g").triples()) == rows(graph.triples(graph.extracted(docs.union(more))[1]))


def test_long_sentences_are_paired_in_blocks(spark):
    few, many = " and ".join(f"Ab{chr(97 + i)}x" for i in range(20)), " and ".join(f"Ab{chr(97 + i // 20)}{chr(97 + i % 20)}x" for i in range(150))
    docs = spark.createDataFrame([(1, few), (2, many), (3, f"{few} and {few}. {few}"), (4, None), (5, "")], "doc_id long, text string")
    got = graph.cooccurrences(docs).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got} == {1: 190, 2: 150 * 149 // 2, 3: 190}
