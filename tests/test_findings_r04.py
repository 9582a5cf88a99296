"""Tests of the fourth review's findings, by number."""

import random

import numpy as np

from spindrift.llm import components, edits, lines, minhash
from spindrift.operators import hybrid, intent
from spindrift.plans import answers


def test_classifiers_are_fitted_on_every_labelled_row(spark, tmp_path, monkeypatch):
    """more rows than the bound of 50 000 that there was."""
    from pyspark.ml.classification import LogisticRegression

    n, seen, fit = 50_400, [], LogisticRegression.fit
    monkeypatch.setattr(LogisticRegression, "fit", lambda self, df: seen.append(df.count()) or fit(self, df))
    text = "CASE WHEN id = 7 THEN NULL WHEN id % 2 = 0 THEN concat('river number', id) ELSE concat('fleuve numero', id) END"
    rows = spark.range(n).selectExpr("id AS doc_id", f"{text} AS text", "if(id % 2 = 0, 'en', 'fr') AS lang")
    rows.union(spark.sql("SELECT -1L, 'river', CAST(NULL AS STRING)")).write.parquet(f"{tmp_path}/documents.parquet")
    got = answers.intent_classify(spark, str(tmp_path)).collect()
    assert seen == [n] and len(got) == n
    assert sum(r.label == ("en" if r.doc_id % 2 == 0 else "fr") for r in got) > 0.9 * n
    assert [(r.label, r.confidence) for r in got if r.doc_id == 7] == [(None, None)]


def test_vectors_that_are_there_are_classified_as_their_texts(spark):
    rows = spark.createDataFrame([(f"river number{i}" if i % 2 else f"fleuve numero{i}", "en" if i % 2 else "fr") for i in range(40)] + [(None, "en"), ("", "fr")], "text string, label string")
    model = intent.fit(rows, ("en", "fr"))
    asked = rows.select("text", hybrid.encoded(rows.text).alias("w")).selectExpr("text", "if(text IS NULL, NULL, w) AS v")
    by_text = model.classify(asked).select("text", "label", "confidence").collect()
    assert sorted(map(repr, by_text)) == sorted(map(repr, model.classify(asked, vector_col="v").select("text", "label", "confidence").collect()))
    assert [r for r in by_text if r.text is None][0].label is None


def test_long_and_short_pairs_go_apart(monkeypatch):
    """short pairs don't idle beside long ones, and few pairs are left to the way for one; the distances stay."""
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    edited = lambda a, n: "".join(c if rng.random() > n else rng.choice("xyz") for c in a)
    long, short = [text(3000) for _ in range(30)], [text(200) for _ in range(600)]
    pairs = [(a, edited(a, rng.choice((0.1, 0.3)))) for a in long + short] + [(a := text(9000), edited(a, 0.1))]
    most = np.array([len(a) // 5 for a, _ in pairs])
    seen, alone = [], []
    monkeypatch.setattr(edits, "_side_by_side", lambda a, b, m, f=edits._side_by_side: seen.append((max(map(len, a)), min(map(len, a)))) or f(a, b, m))
    got = edits.distances(pairs, most, lambda a, b, m: alone.append(len(a)) or lines.distance(a, b, m))
    assert max(alone) == 9000 and all(x < 2 * y for x, y in seen)
    want = np.array([lines.distance(a, b, int(m)) for (a, b), m in zip(pairs, most)])
    assert ((got <= most) == (want <= most)).all() and (got[want <= most] == want[want <= most]).all()


def test_band_keys_as_bytes_join_what_lists_join(spark):
    """keys that Spark moves whole give the edges of lists, null keys, none and heads among them."""
    rng = random.Random(4)
    ids = np.arange(300) % 250
    keys = np.array([[rng.choice((-1, 1)) * (rng.randrange(90) << 40) for _ in range(3)] for _ in ids], np.int64)
    sig, heads = minhash.preaggregated(ids, keys, ids % 7 > 0)
    rows = [(int(i), s.as_py(), np.frombuffer(s.as_py(), np.int64).tolist(), h.as_py()) for i, s, h in zip(ids, sig, heads)]
    points = spark.createDataFrame(rows, "id long, b binary, l array<bigint>, heads array<bigint>").repartition(3)
    by_bytes = minhash.candidates(minhash.bucketed(points.selectExpr("id", "b AS sig", "heads")))
    by_lists = minhash.candidates(points.selectExpr("id", "l AS sig", "heads"))
    assert sorted(by_bytes.collect()) == sorted(by_lists.collect()) and by_bytes.count() > 100


def test_a_text_is_moved_once(spark):
    """the last join takes the row, which has the text; its column may have any name."""
    docs = spark.createDataFrame([(1, "a line of some words here\nown", "x"), (2, "other\nA line of some words  here", "y"), (3, None, "z")], "doc_id long, `the text` string, key string")
    out = lines.dedup(docs, text_col="the text")
    join = [x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "xxhash64" in x]
    assert join and all(" AS text#" not in x for x in join)
    assert {r.doc_id: (r.n_lines, r.n_removed, r.clean, r.row["key"]) for r in out.collect()} == {1: (2, 0, "a line of some words here\nown", "x"), 2: (2, 1, "other", "y"), 3: (0, 0, None, "z")}


def test_edges_of_gigabytes_settle_in_one_round(spark):
    """a million and a half edges, about those of 6 GB, are one block; more are blocks of no more."""
    edges = spark.range(100).selectExpr("id AS a", "id + 1 AS b").repartition(8)
    assert components._blocks(edges, 1_500_000).rdd.getNumPartitions() == 1
    assert components._blocks(edges, 3 * components.TOGETHER).rdd.getNumPartitions() == 3
