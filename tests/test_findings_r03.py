"""What findings of the third review named, each on a small input that showed it."""

import random
import signal
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spindrift.llm import components, lines, minhash, near, packing, simhash
from spindrift.operators import annotate, graph, graphstore, hybrid, intent, selection
from spindrift.operators.store import Options, Store
from spindrift.plans import registry


@contextmanager
def within(seconds):
    """Fails what does not end by itself."""

    def late(*_):
        raise TimeoutError(f"not done in {seconds} s")

    before = signal.signal(signal.SIGALRM, late)
    signal.alarm(seconds)
    try:
        yield
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, before)


@pytest.mark.parametrize("values", [[2**59 + 1, 2**60 - 1], [2**62 + i for i in range(9)], [-(2**62) + 1, 2**62 - 1, 2**62 + 1]])
def test_selection_of_integers_that_doubles_do_not_hold(spark, values):
    with within(90):
        rows = spark.createDataFrame([(v,) for v in values], "v long")
        for at in (0, len(values) // 2, len(values) - 1):
            found = selection.selected(rows, "v", {"p": lambda n, at=at: F.lit(at)}).collect()
            assert [r.value for r in found] == [sorted(values)[at]]


def test_int8_codes_use_the_scale_itself(spark, tmp_path):
    """89 by the scale, 88 by the scale rounded to nine places."""
    top = 0.352478176355361938
    rows = spark.createDataFrame([(1, [top, 88.5000004 * top / 127])], "vec_id long, embedding array<double>")
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert round(88.5000004 * (top / 127) / round(top / 127, 9)) == 88
    assert registry.QUERIES["int8_codes"](spark, str(tmp_path)).first().codes == "127,89"


def test_routes_fold_a_question_a_few_times_only(spark):
    """Each fold holds the letters of all scripts; the route once held 26 of them for every cue."""
    rows = spark.createDataFrame([(1, "Hello"), (2, "What is a river and an ocean?"), (3, None)], "id long, text string").withColumns({"label": F.lit(None).cast("string"), "sure": F.lit(None).cast("double")})
    out = rows.select("id", annotate.routed(F.col("text"), F.col("label"), F.col("sure")).alias("r"))
    plan = out._jdf.queryExecution().analyzed()
    assert plan.expressions().mkString().count("translate(") <= 9
    assert [(r.id, r.r.kind, r.r.domain) for r in out.orderBy("id").collect()] == [(1, "conversation", None), (2, "factual", "geography"), (3, "conversation", None)]


_SAID = [(1, "Ada Lovelace uses Engines. The Rhine has a Bridge. Ada met Babbage"), (2, "Bridge uses the Rhine. x9abc is a tool. A-b-c de la Ville"), (3, "Ada is a Poet. Ada is a Poet is a Name, été de l'Été de été"), (4, None)]


def test_a_graph_of_one_part_is_not_written_again(spark, tmp_path):
    g = graphstore.Graph(spark, str(tmp_path)).append(spark.createDataFrame(_SAID, "doc_id long, text string"), "first")
    one = g.compact()
    assert one.parts == g.parts and one.manifest["degrees"] == g.parts[0]
    assert sorted(map(tuple, one.degrees(50).collect())) == sorted(map(tuple, graph.degrees(g.triples(), 50).collect()))


def test_known_nodes_are_looked_up_by_bucket(spark, tmp_path):
    g = graphstore.Graph(spark, str(tmp_path)).append(spark.createDataFrame(_SAID, "doc_id long, text string"), "first")
    asked = spark.createDataFrame([(r.id,) for r in g.nodes().collect()] + [("nobody",), ("nobody",)], "id string")
    got = g.known(asked)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, graph.known(asked, g.nodes()).collect()))
    assert {r.id for r in got.filter("NOT known").collect()} == {"nobody"}


def test_typed_relations_are_those_of_the_pattern(spark):
    said = spark.createDataFrame([*_SAID, (5, "a" * 30 + " x_y-z9 is an a9-_ of of of the of The a1 has has has")], "id long, text string")
    for _, _, words in graph.TYPED:
        both = said.select(*[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(n) for n, p in (("a", graph.typed_pattern(words)), ("b", graph._fast(words)))]).collect()
        assert all(r.a == r.b for r in both)


def test_stores_of_codes_keep_no_postings_and_broadcast_their_window(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"word{i % 7} other{i % 3} thing") for i in range(60)], "id long, text string")
    store = Store.save(rows.withColumn("embedding", hybrid.encoded(F.col("text"))), str(tmp_path), options=Options(reranker=False))
    assert not (tmp_path / "postings").exists() and store.terms().count() == 11
    found = store.search(spark.createDataFrame([(1, "word3 thing")], "query_id long, text string"), 3)
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString() and found.count() == 3
    assert "SortMergeJoin [id" not in found._jdf.queryExecution().executedPlan().toString()


def test_classifiers_are_fitted_on_rows_that_no_task_gathers(spark, monkeypatch):
    from pyspark.ml.classification import LogisticRegression

    seen = []
    monkeypatch.setattr(LogisticRegression, "fit", lambda self, df: seen.append(df))
    rows = spark.createDataFrame([(f"text number{i} of many", "a" if i % 2 else "b") for i in range(400)], "text string, label string").repartition(4)
    intent.fit(rows, ("a", "b"), most=100)
    assert seen[0].count() == 100
    intent.fit(rows, ("a", "b"), most=1000)
    assert seen[1].count() == 400
    assert seen[0].rdd.getNumPartitions() > 1


def test_packing_takes_portions_of_a_batch():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, "", "b" * 50, "c", "d" * 9])], names=["_text"])
    got = [p.column(0).to_pylist() for p in packing.portions(batch, most=10)]
    assert got == [["a" * 10, ""], ["b" * 50], ["c", "d" * 9]]


def test_sentences_are_read_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(graph.scratch, "written", lambda df, name: written.append(df) or df)
    graph.extracted(spark.createDataFrame(_SAID, "doc_id long, text string"))
    assert written[0]._jdf.queryExecution().optimizedPlan().toString().count("(?<!") == len(graph.TYPED)


def test_near_dedup_has_the_links_of_fingerprints(spark):
    """SimHashes within four bits link, below a similarity of 0.8 too; and the similarity still links beyond four bits."""
    word = lambda k, i: f"{k}{i * 7919 % 1000}"
    passage = [word("p", i) for i in range(31)] * 20
    rows = [(1, " ".join(passage + [word("a", i) for i in range(30)])), (2, " ".join(passage + [word("b", i) for i in range(30)]))]
    own = [word("w", i) for i in range(204)]
    rows += [(3, " ".join(own)), (4, " ".join(word("x", i) if i in (30, 80, 130, 180) else w for i, w in enumerate(own))), (5, "quite another text of seven words")]
    prints = {i: simhash.fingerprint(t, 5) for i, t in rows}
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in rows}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert (prints[1] ^ prints[2]).bit_count() <= 4 and alike(1, 2) < 0.8
    assert (prints[3] ^ prints[4]).bit_count() > 4 and alike(3, 4) >= 0.8
    kept = near.first_of_each(spark.createDataFrame(rows, "doc_id long, text string"), words=5, bits=4)
    assert {r.doc_id for r in kept.collect()} == {1, 3, 5}


def test_shingles_hashed_together_are_those_of_each_text():
    texts = [None, "", " \t", "a", "A b", "one two three four five", "\t é Ü 字 🙂\n\x0b q", "x" * 700 + " y z w v u", " ".join(f"w{i * i}" for i in range(3000))] + [f"word{i} and other words that are no longer {i}" for i in range(200)]
    for words in (1, 4, 5):
        together = list(simhash.all_shingle_hashes(texts, words))
        assert [h.tolist() for h in together] == [simhash.shingle_hashes(t, words).tolist() for t in texts]


def test_alignment_by_words_is_never_below_the_edit_distance():
    rng = random.Random(3)
    words = ["a", "bb", "c", "dd", "eee", "f", "", "g", "hh"]
    for _ in range(2000):
        a, b = (" ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))) for _ in range(2))
        assert lines.anchored(a, b) >= lines.distance(a, b, 1 << 20)
    own = [f"w{i}" for i in range(60)]
    assert lines.anchored(" ".join(own), " ".join(own[:20] + ["new"] + own[20:40] + own[42:])) == 4 + 8  # a word more, two less


def test_buckets_dealt_into_parts_join_what_shares_one(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PART", 64)  # many parts a partition
    monkeypatch.setattr(minhash, "DEALT", 100)
    rng = random.Random(5)
    rows = [(i, [rng.choice((-1, 1)) * (rng.randrange(300) << 40) for _ in range(3)], []) for i in range(400)]
    points = spark.createDataFrame(rows, "id long, sig array<bigint>, heads array<bigint>")
    edges = [(r.a, r.b) for r in minhash.candidates(points).collect()]
    holders = {}
    for i, sig, _ in rows:
        for k in sig:
            holders.setdefault(k, set()).add(i)
    assert all(any({a, b} <= own for own in holders.values()) for a, b in edges)
    joined = components.forest(*(np.array(x) for x in zip(*edges)))
    wanted = components.forest(*(np.array(x) for x in zip(*((i, min(own)) for own in holders.values() for i in own if len(own) > 1))))
    assert dict(zip(*(x.tolist() for x in joined))) == dict(zip(*(x.tolist() for x in wanted)))
    assert minhash.candidates(points.limit(0)).count() == 0


def test_few_edges_settle_in_one_round(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(components, "_large_star", lambda e, n, star=components._large_star: rounds.append(n) or star(e, n))
    chain = spark.range(200).selectExpr("id AS a", "id + 1 AS b").repartition(8)
    assert {(r.node, r.root) for r in components.components(chain).collect()} == {(i, 0) for i in range(1, 201)}
    assert len(rounds) == 1


def test_few_keys_are_joined_once(spark, monkeypatch):
    """Few rows have one join, by broadcast, and a round makes its first half once; more rows go by hubs, with the same result."""
    rows = spark.range(40).selectExpr("id % 7 AS a", "id AS b")
    facts = rows.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("m"))
    few = components.with_facts(rows, facts, ["a"], "n", 40)
    assert few._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    leaves = []
    monkeypatch.setattr(components, "_small_star", lambda e, n, star=components._small_star: leaves.append(e._jdf.queryExecution().optimizedPlan().collectLeaves().size()) or star(e, n))
    chain = spark.range(60).selectExpr("id AS a", "id + 1 AS b").repartition(4)
    wanted = {(i, 0) for i in range(1, 61)}
    assert {(r.node, r.root) for r in components.components(chain).collect()} == wanted
    assert set(leaves) == {1}
    monkeypatch.setattr(components, "FEW", 0)
    monkeypatch.setattr(components, "LEAST_ENDS", 3)
    assert sorted(components.with_facts(rows, facts, ["a"], "n", 40).collect()) == sorted(few.collect())
    assert {(r.node, r.root) for r in components.components(chain).collect()} == wanted


def test_lines_are_split_and_keyed_without_copies(monkeypatch):
    """Words part at all of Unicode's white space; keys are the same whether all lines are needed or few, empty ones among them."""
    import pyarrow.compute as pc

    spaces = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isspace()]
    texts = pa.array([*(f"{s}Ab{s}{s} cÉ{s}" for s in spaces), "", " ", "one", *(" ".join(f"w{(i * k) % 13}é" for k in range(i)) for i in range(5, 40)), ""])
    wanted = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(texts))).to_pylist()
    monkeypatch.setattr(pc, "utf8_split_whitespace", None)
    words = lines.words_of(texts)
    assert words.to_pylist() == wanted
    normal = pc.binary_join(words, " ")
    everything = lines.some_bands(words, normal, np.ones(len(words), bool))
    for i in range(len(words)):
        few = np.arange(len(words)) == i
        found = lines.some_bands(words, normal, few)
        assert (found[i] == everything[i]).all() and not found[~few].any()
    of, number, long, place, _, _ = lines.real_lines(pa.array(["a\n\n?!\nb", "-" * lines.MIN_CHARS]))
    assert [of.tolist(), number.tolist(), long.tolist(), place.tolist()] == [[0, 0, 1], [0, 3, 0], [False, False, True], [0, 3, 4]]
