"""Versions of stores, their inverted index, kept sums and growing cells."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import hybrid, search, shards, snapshots
from spindrift.operators import store as S
from spindrift.operators.store import Options, Store, open_store
from spindrift.sources import ingest, scratch

PLAIN = Options(shard_key=None, reranker=False)


def texts(spark, n, first=0, seed=0):
    rng = np.random.default_rng(seed + first)
    words = np.array([f"word{i}" for i in range(60)])
    p = 1 / np.arange(1, 61)
    rows = [(first + i, " ".join(rng.choice(words, rng.integers(0, 9), p=p / p.sum())), f"d{i % 3}" if i % 7 else None) for i in range(n)]
    return spark.createDataFrame(rows, "id long, text string, domain string").withColumn("embedding", hybrid.encoded(F.col("text")))


def vectors(spark, n, first=0, dim=16, groups=5):
    centers = np.random.default_rng(1).normal(size=(groups, dim))
    rng = np.random.default_rng(100 + first)
    rows = [(first + i, "", f"g{i % groups}", (centers[i % groups] + 0.4 * rng.normal(size=dim)).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "id long, text string, label string, embedding array<double>")


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/**", recursive=True) if os.path.isfile(f)}


def brute(rows, queries, k):
    """The best k by boosted score of all pairs."""
    out = set()
    for q in queries:
        scored = []
        for r in rows:
            cosine = round(float(np.dot(q.embedding, r.embedding)), 6)
            scored.append((-round(cosine + min(hybrid.CAP, hybrid.BOOST * len(set(q.qt) & set(r.qt))), 6), r.id))
        out |= {(q.query_id, i, n) for n, (_, i) in enumerate(sorted(scored)[:k], 1)}
    return out


@pytest.mark.parametrize("near,k", [(1, 1), (4, 2), (64, 5)])
def test_inverted_index_finds_the_boosted_best(spark, tmp_path, near, k):
    from spindrift.functions.text import tokens

    first, more = texts(spark, 250), texts(spark, 150, 1000)
    store = Store.save(first, f"{tmp_path}/s", compression="none", options=PLAIN).append(more)
    asked = texts(spark, 25, 5000, 7).select(F.col("id").alias("query_id"), "text")
    asked = asked.union(spark.createDataFrame([(1, "word59 word58 word57"), (2, ""), (3, "nowhere to be found"), (4, "word0 word1 word2 word3 word4 word5")], "query_id long, text string"))
    q = asked.withColumn("embedding", hybrid.encoded(F.col("text"))).withColumn("qt", tokens(F.col("text")))
    rows = first.union(more).withColumn("qt", tokens(F.col("text"))).collect()
    found = hybrid.boosted_topk(store.chunks, store.postings(), store.terms(), q, k, near=near)
    assert {(r.query_id, r.vec_id, r["rank"]) for r in found.collect()} == brute(rows, q.collect(), k)
    sent = {(r.query_id, r.id, r["rank"]) for r in store.search(asked, k).collect()}
    assert sent == brute(rows, q.collect(), k)


def test_postings_are_those_of_the_texts(spark, tmp_path):
    rows = texts(spark, 80)
    store = Store.save(rows, f"{tmp_path}/s", options=PLAIN).append(texts(spark, 20, 500))
    from spindrift.functions.text import tokens

    want = {(t, r.id) for r in rows.union(texts(spark, 20, 500)).select("id", tokens(F.col("text")).alias("t")).collect() for t in r.t}
    assert {(r.token, r.id) for r in store.postings().collect()} == want
    assert {r.token: r.n for r in store.terms().groupBy("token").agg(F.sum("n").alias("n")).collect()} == {t: len({i for x, i in want if x == t}) for t, _ in want}
    plan = store.search(spark.createDataFrame([(1, "word3 word50")], "query_id long, text string"), 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all(translate(lower(coalesce(text#" not in plan.split("tokens#")[0] or "tokens#" in plan


def test_readers_keep_their_version(spark, tmp_path):
    one = Store.save(texts(spark, 30), f"{tmp_path}/s", options=PLAIN)
    before = files(f"{tmp_path}/s/chunks")
    two = one.append(texts(spark, 12, 100))
    assert (one.count(), two.count(), one.chunks.count(), two.chunks.count()) == (30, 42, 30, 42)
    assert Store.load(spark, one.path, version=1).chunks.count() == 30 and Store.load(spark, one.path).manifest["version"] == 2
    assert before.items() <= files(f"{tmp_path}/s/chunks").items()  # nothing was written anew
    with pytest.raises(S.NoStore, match="version 9"):
        Store.load(spark, one.path, version=9)
    again = one.append(texts(spark, 5, 200))  # from a reader of version 1, after version 2
    assert again.manifest["version"] == 3 and again.count() == 47 and sorted(snapshots.versions(spark, one.path)) == [1, 2, 3]
    assert two.append(texts(spark, 3, 300), batch="b").append(texts(spark, 3, 300), batch="b").count() == 50  # once
    replaced = Store.save(texts(spark, 4), one.path, options=PLAIN)
    assert replaced.manifest["version"] == 5 and replaced.count() == 4 and Store.load(spark, one.path, version=2).chunks.count() == 42


def test_a_failed_append_is_not_there(spark, tmp_path, monkeypatch):
    store = Store.save(texts(spark, 10), f"{tmp_path}/s", options=PLAIN)

    def stop(*_):
        raise OSError("lost")

    monkeypatch.setattr(snapshots, "publish", stop)
    with pytest.raises(OSError):
        store.append(texts(spark, 10, 50))
    monkeypatch.undo()
    assert len(glob.glob(f"{tmp_path}/s/chunks/part=*")) == 2 and Store.load(spark, store.path).chunks.count() == 10
    with pytest.raises(Exception, match="64 entries"):
        store.append(texts(spark, 3, 90).withColumn("embedding", F.array(F.lit(1.0))))
    assert store.append(texts(spark, 1, 70)).count() == 11
    with pytest.raises(ValueError, match="no column more"):
        store.append(texts(spark, 1, 80).withColumn("more", F.lit(1)))
    assert store.append(texts(spark, 1, 81).drop("domain")).chunks.filter("id = 81").first().domain is None


def test_a_version_is_published_once(spark, tmp_path):
    snapshots.publish(spark, str(tmp_path), {"version": 1, "a": "é"})
    with pytest.raises(snapshots.Taken):
        snapshots.publish(spark, str(tmp_path), {"version": 1, "a": 2})
    assert snapshots.read(spark, str(tmp_path)) == {"version": 1, "a": "é"} and snapshots.read(spark, f"{tmp_path}/none") is None
    assert snapshots.advance(spark, str(tmp_path), lambda m: {"a": m["a"] + "x"}) == {"version": 2, "a": "éx"}
    assert not glob.glob(f"{tmp_path}/versions/_*")


def test_nothing_takes_a_broken_stores_place(spark, tmp_path):
    store = Store.save(texts(spark, 10), f"{tmp_path}/s", options=PLAIN)
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.txt").write_text("A text that is long enough to make one chunk of the store, surely.")
    with open(f"{tmp_path}/s/versions/{1:012}.json", "w") as f:
        f.write("{broken")
    for c in glob.glob(f"{tmp_path}/s/versions/.*.crc"):
        os.remove(c)
    with pytest.raises(ValueError):
        ingest.open_or_ingest(spark, store.path, f"{tmp_path}/docs")
    with pytest.raises(ValueError):
        open_store(spark, store.path)
    assert ingest.open_or_ingest(spark, f"{tmp_path}/new", f"{tmp_path}/docs").count() == 1
    assert ingest.open_or_ingest(spark, f"{tmp_path}/newer") is None


def test_sums_add_up_and_prune(spark, tmp_path):
    rows, more = vectors(spark, 200), vectors(spark, 90, 500)
    lone = spark.createDataFrame([(9000, "", None, [0.1] * 16)], "id long, text string, label string, embedding array<double>")
    store = Store.save(rows, f"{tmp_path}/s", partition_by="label", compression="none", options=Options(shard_key="label", reranker=False)).append(more).append(lone)
    kept = {r.key: (r.n, np.array(r.centroid)) for r in store.centers("label").collect()}
    anew = {r.key: (r.n, np.array(r.centroid)) for r in shards.centroids(store.vectors(), "label").collect()}
    assert kept.keys() == anew.keys() == {f"g{i}" for i in range(5)}
    assert all(kept[k][0] == anew[k][0] and np.allclose(kept[k][1], anew[k][1], atol=1e-12) for k in kept)
    asked = rows.filter("id < 10").select(F.col("id").alias("vec_id"), "embedding")
    routed = scratch.written(shards.route(asked, store.centers("label"), 0.003), "routed")
    found = shards.routed_topk(store.vectors(), asked, routed, 4, "label")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower() and "Generate" not in plan
    held = {r.query_id: r.best for r in routed.filter("routed IS NOT NULL").collect()}
    assert len(held) == 10
    all_ = store.vectors().select("vec_id", "embedding", "label").collect()
    for i, best in held.items():
        q = next(r.embedding for r in all_ if r.vec_id == i)
        want = sorted((-round(float(np.dot(q, r.embedding)), 6), r.vec_id) for r in all_ if r.label in (best, None))[:4]
        assert sorted((-r.score, r.vec_id) for r in found.collect() if r.query_id == i) == want


def test_cells_grow_and_split(spark, tmp_path):
    store = Store.save(vectors(spark, 300), f"{tmp_path}/s", compression="none", options=Options(ann="ivf", shard_key=None))
    index = store.ivf()
    first = files(f"{tmp_path}/s/ivf/cells")
    rows = vectors(spark, 300)
    for i in range(10):
        more = vectors(spark, 40, 1000 * (i + 1))
        rows, store = rows.union(more), store.append(more)
        index = store.ivf()
    assert index.assigned.count() == 700 and sum(r.n for r in index.sizes().collect()) == 700
    assert {r.cell_id: r.n for r in index.assigned.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n")).collect()} == {r.cell_id: r.n for r in index.sizes().filter("n > 0").collect()}
    assert first.items() <= files(f"{tmp_path}/s/ivf/cells").items()  # what was stored first still is
    q = rows.filter("id % 100 = 0").select(F.col("id").alias("vec_id"), "embedding")
    exact = {(r.query_id, r.vec_id) for r in search.topk(store.vectors(), q, 10).collect()}
    recall = lambda x: len(exact & {(r.query_id, r.vec_id) for r in x.collect()}) / len(exact)
    assert recall(index.search(q, 10, max(4, index.open_cells // 2))) >= 0.9 and recall(index.search(q, 10, index.open_cells)) == 1.0
    whole, apart = index.sizes().agg(F.max("n").alias("n")).first().n, index.split(30)
    assert whole > 30 >= apart.sizes().agg(F.max("n").alias("n")).first().n and apart.assigned.count() == 700 and apart.open_cells > index.open_cells
    assert recall(apart.search(q, 10, apart.open_cells)) == 1.0 and recall(apart.search(q, 10, apart.open_cells // 2)) >= 0.9
    later = apart.extend(vectors(spark, 20, 50_000).select(F.col("id").alias("vec_id"), "embedding").withColumn("part", F.lit("x")))
    assert later.assigned.count() == 720 and not {str(c) for c in later.manifest["retired"]} & later.manifest["sizes"].keys()
    assert Store.load(spark, store.path, store.options, version=1).ivf().assigned.count() == 300  # an older version's rows only


def test_cells_of_equal_rows_stay_whole(spark, tmp_path):
    same = spark.range(50).select(F.col("id").alias("vec_id"), F.array(*map(F.lit, [1.0, 0.0])).alias("embedding"))
    index = shards.Ivf.build(same, cells=1).save(f"{tmp_path}/i").split(10)
    assert index.assigned.count() == 50 and index.open_cells == 1
