import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.functions import encoders
from tests import plain
from spindrift.operators import chunks, graph, hybrid, intent, metrics, search, shards
from spindrift.operators.store import Options, Store, build_compressed, open_store
from spindrift.plans import fixtures as fx
from spindrift.plans.engine import Engine, Retrieve, Symbolic, Verify
from spindrift.sources import ingest, readers, remote
from spindrift.streaming.memory import last_turns_stream


def vectors(spark, n=300, d=16, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x, spark.createDataFrame([(i, v.tolist(), "ab"[i % 2]) for i, v in enumerate(x)], "vec_id long, embedding array<float>, key string").repartition(3)


def chunks_of(rows):
    return rows.select(F.col("vec_id").alias("id"), F.lit("a text").alias("text"), "embedding", "key")


@pytest.mark.parametrize("bad,what", [([1.0], "1 entries"), (None, "null"), ([0.0, float("nan")], "not finite")])
def test_vectors_are_checked(spark, bad, what):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (7, bad)], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match=f"vector 7.*{what}"):
        search.topk(rows, q, 2).collect()


def test_running_best_is_the_best(spark):
    rng = np.random.default_rng(2)
    s, ids = np.round(rng.normal(size=(7, 900)), 1), rng.permutation(900)
    best = search.Best(7, 10)
    for a in range(0, 900, 100):
        best.add(s[:, a : a + 100], ids[a : a + 100])
    for i in range(7):
        assert best.id[i].tolist() == [int(ids[j]) for j in sorted(range(900), key=lambda j: (-s[i, j], ids[j]))[:10]]
    assert search.topk(vectors(spark)[1], vectors(spark, 3)[1], 0).count() == 0


def test_packed_bits_agree_with_signs():
    x = np.random.default_rng(3).normal(size=(20, 70))
    want = ((x[:, None] > 0) == (x[None] > 0)).sum(axis=2)
    assert (search.hamming_scores(search.packed(x), search.packed(x), 70) == want).all()


@pytest.mark.parametrize("mode", ["none", "int8", "binary"])
def test_store_modes(spark, tmp_path, mode):
    x, rows = vectors(spark)
    store = Store.save(chunks_of(rows), f"{tmp_path}/s", compression=mode)
    again = Store.load(spark, f"{tmp_path}/s", model="hash")
    assert again.count() == 300 and ("embedding" in again.chunks.columns) == (mode == "none")
    q = rows.filter("vec_id < 20").select("vec_id", "embedding")
    found = {(r.query_id, r.vec_id) for r in again.coarse(q, 10).collect()}
    exact = {(r.query_id, r.vec_id) for r in search.topk(rows, q, 10).collect()}
    assert len(found & exact) >= (0.8 if mode == "binary" else 0.9) * len(exact)
    more = again.append(chunks_of(vectors(spark, 50, 16, 1)[1].withColumn("vec_id", F.col("vec_id") + 1000)))
    assert more.count() == 350 and more.manifest["version"] == 2
    with pytest.raises(Exception, match="16 entries"):
        again.append(chunks_of(vectors(spark, 5, 8)[1]))
    assert store.describe()["chunks"] == 300


def test_store_errors(spark, tmp_path):
    _, rows = vectors(spark, 20)
    store = Store.save(chunks_of(rows), f"{tmp_path}/g", scale="global")
    with pytest.raises(ValueError, match="global"):
        store.append(chunks_of(rows))
    with pytest.raises(ValueError, match="vectors of hash"):
        Store.load(spark, f"{tmp_path}/g", model="other")
    assert open_store(spark, f"{tmp_path}/nothing") is None and open_store(spark, f"{tmp_path}/nothing", lambda: store) is store
    with pytest.raises(RuntimeError, match="20 chunks"):
        build_compressed(chunks_of(rows), f"{tmp_path}/few", least=21)
    with pytest.raises(ValueError):
        Store.save(chunks_of(rows), f"{tmp_path}/x", compression="zip")


def test_ivf_is_stored_and_follows_the_version(spark, tmp_path):
    _, rows = vectors(spark, 400, 32)
    store = Store.save(chunks_of(rows), f"{tmp_path}/s", options=Options(ann="ivf"))
    index = store.ivf()
    assert index.cells == 20 and index.assigned.count() == 400 and index.probes() == 2 and index.probes(0) == 2 and index.probes(99) == 20
    assert store.ivf() is index and Store.load(spark, f"{tmp_path}/s").ivf().assigned.count() == 400
    q = rows.filter("vec_id < 30").select("vec_id", "embedding")
    exact = search.topk(store.vectors(), q, 10)
    shares = [metrics.sweep(exact, lambda n: index.search(q, 10, n), [n]).first().recall for n in (2, 10, 20)]
    assert shares[0] <= shares[1] <= shares[2] == 1.0
    assert all(r.query_id == r.vec_id for r in index.search(q, 1).collect())
    n = index.tuned(rows.filter("vec_id between 100 and 150"), 10, 0.95)
    assert metrics.sweep(exact, lambda k: index.search(q, 10, k), [n]).first().recall >= 0.9
    sizes = sorted((r.n for r in index.sizes().collect()), reverse=True)
    assert shards.scan_bound(index.sizes(), 3).first().bound == sum(sizes[:3])
    assert store.append(chunks_of(rows.withColumn("vec_id", F.col("vec_id") + 1000))).ivf().assigned.count() == 800
    plan = index.search(q.filter("vec_id = 1"), 5, 1)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cell_id" in plan or "PartitionFilters: [cell_id" in plan or "cell_id IN" in plan


def test_routing(spark):
    rows = fx.frame(spark, fx.TRAP, "vec_id long, embedding array<double>, label string")
    between = fx.frame(spark, [(1, [0.7071, 0.7071, 0.0, 0.0])], "vec_id long, embedding array<double>")
    centers = shards.centroids(rows.filter("vec_id <> 20 AND vec_id <> 30"))
    assert shards.route(between, centers, margin=0.05).first().routed is None  # a tie abstains
    alone = shards.sharded_topk(rows.filter("label = 'a'"), between, 3, kind="exact")
    assert alone.count() == 3  # one key: nothing to route


def test_search_without_chunks_or_reranker(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the river rhine flows north", "g"), (2, "a cat sleeps", "x"), (3, "rhine wine cellar", "x")], "id long, text string, domain string").withColumn("embedding", hybrid.encoded(F.col("text")))
    q = spark.createDataFrame([(9, "rhine river")], "query_id long, text string")
    for mode in ("none", "int8", "binary"):
        store = Store.save(docs, f"{tmp_path}/{mode}", compression=mode, options=Options(shard_key=None, reranker=False))
        rows = sorted(store.search(q, 2).collect(), key=lambda r: r["rank"])
        assert [r.id for r in rows] == [1, 3] and rows[0].score > rows[0].score_cosine
        assert [r.id for r in store.search(q, 1, domain="none such").collect()] == [1]  # a filter that leaves nothing is dropped
        assert [r.id for r in store.search(q, 1, domain="x").collect()] == [3]
    failing = hybrid.load_scorer(lambda: __import__("no_such_reranker"))
    assert failing is None and store.with_options(reranker=True).search(q, 2, scorer=failing).count() == 2


def test_labelled_data(spark, tmp_path):
    def load(*lines):
        (tmp_path / "l.jsonl").write_text("\n".join(lines))
        return readers.labelled(spark, str(tmp_path / "l.jsonl")).collect()

    good = json.dumps({"query": "why?", "label": "reasoning"})
    assert len(load(good, "", "  ", good)) == 2
    for bad, what in (("{oops", "line 2: bad JSON"), ('{"label": "code"}', "line 2: no query"), ('{"query": "x"}', "line 2: no label"), ('{"query": " ", "label": "code"}', "line 2: a blank query"), ('{"query": "x", "label": "weather"}', "line 2: unknown label weather"), ("[1]", "line 2: bad JSON")):
        with pytest.raises(Exception, match=what):
            load(good, bad)


def test_numbered_lines(spark, tmp_path):
    """Numbers go on over the splits of a file, blank lines and files that end without a line end."""
    texts = {"a": "".join(f"line {i}\n" if i % 3 else "\n" for i in range(500)), "b": "x\r\ny", "c": ""}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        got = readers.numbered_lines(spark, str(tmp_path))
        rows = {(r.path[-1], r.at, r.line) for r in got.collect()}
        assert got.select("path", "at").distinct().count() == got.count() and got.rdd.getNumPartitions() > 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert rows == {(n, i + 1, line) for n, t in texts.items() for i, line in enumerate(t.removesuffix("\n").split("\n") if t else [])}


def test_yaml(tmp_path):
    path = str(tmp_path / "c.yaml")
    assert readers.read_yaml(path, {"a": {"b": 1}}) == {"a": {"b": 1}}
    (tmp_path / "c.yaml").write_text("a: {c: 2}\nd: [1]\n")
    assert readers.read_yaml(path, {"a": {"b": 1, "c": 0}, "d": {"e": 1}}) == {"a": {"b": 1, "c": 2}, "d": [1]}
    for text, want in (("", {"x": 1}), ("- 1", None)):
        (tmp_path / "c.yaml").write_text(text)
        if want is None:
            with pytest.raises(ValueError, match="no mapping"):
                readers.read_yaml(path)
        else:
            assert readers.read_yaml(path, {"x": 1}) == want


def test_sources(spark, tmp_path):
    files = {
        "docs/a.md": "# A\ntext", "docs/b.txt": "plain", "docs/sub/c.md": "deep", "web/css/grid/index.md": "---\ntitle: Grid\n---\nUse it.", "web/html/p/index.md": "bare", "bundles/lists/x.txt": "list", "bundles/other/y.txt": "no",
        "db/sql-select.html": "<h1>Select</h1>", "db/sql.html": "<p>s</p>", "db/sqlite.html": "no", "c/run/r.md": "---\ntitle: Run\n---\n{{< x >}}\nGo",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    at = lambda p: str(tmp_path / p)
    assert [(r.name, r.pattern) for r in readers.text_globs(spark, at("docs"), ["*.txt", "*.md", "c*"]).collect()] == [("b.txt", 0), ("a.md", 1), ("c.md", 1)]
    web = {(r.origin, r.text, r.language) for r in readers.source("web", spark, at("web"), None).collect()}
    assert {(o, t) for o, t, _ in web} >= {("Grid", "Use it.")}
    assert [r.origin for r in readers.source("bundle", spark, at("bundles"), ["lists"]).collect()] == ["lists/x.txt"]
    assert {r.origin for r in readers.source("database", spark, at("db"), ["sql"]).collect()} == {"sql", "sql-select"}
    assert [(r.origin, r.text) for r in readers.source("container", spark, at("c"), ["run"]).collect()] == [("Run", "Go")]
    rows = readers.sources([("text", {"path": at("docs")}), ("container", {"path": at("c")})], spark)
    assert rows.columns == list(readers.ROW) and rows.count() == 4
    with pytest.raises(KeyError, match="unknown source"):
        readers.source("nowhere", spark)
    pages = spark.createDataFrame([("git-log", "N\bNAME"), ("x", "  ")], "page string, text string")
    assert [(r.origin, r.text, r.language) for r in readers.manuals(pages).collect()] == [("git-log", "NAME", "git")]
    long = spark.createDataFrame([("a", " " + "x" * 400), ("b", "x" * 399), ("c", "y" * 500)], "title string, text string")
    assert sorted(r.origin for r in readers.encyclopedia(long).collect()) == ["a", "c"] and readers.encyclopedia(long, most=1).count() == 1
    assert readers.read_env(["A=1", "# B=2", "export C='x y'", "D"], {"A": "9"}) == {"A": "9", "C": "x y"}


def test_ingest_jobs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "history.md").write_text("# Rome\nThe empire lasted for many a century. It fell to war in the end, as they do.\n## Empty\n")
    (tmp_path / "in" / "b.txt").write_text("short")
    store, counts = ingest.ingest_prose(readers.text_files(spark, str(tmp_path / "in")), f"{tmp_path}/prose")
    assert [(r.section, r.domain) for r in store.chunks.collect()] == [("Rome", "history")] and counts.first().n == 1
    assert ingest.open_or_ingest(spark, f"{tmp_path}/prose").count() == 1
    assert ingest.open_or_ingest(spark, f"{tmp_path}/fresh", str(tmp_path / "in")).count() == 1 and ingest.open_or_ingest(spark, f"{tmp_path}/none") is None
    code = fx.frame(spark, [("o1", "x = 1\n" * 20, "s", "python"), ("o2", "y = 2\n" * 20, "s", "python")], "origin string, text string, source string, language string")
    store, counts = ingest.ingest_code(code, f"{tmp_path}/code", most_docs=1)
    assert {r.origin for r in store.chunks.collect()} == {"o1"} and counts.first().language == "python"
    with pytest.raises(RuntimeError):
        ingest.checked(None)


def test_streaming_ingest_keeps_what_came_before(spark, tmp_path):
    text = "One sentence that is rather long and repeats. " * 12
    schema = "origin string, text string, source string, language string"
    add = lambda n: fx.frame(spark, [(n, text + n, "encyclopedia", None)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: ingest.ingest_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), f"{tmp_path}/store", f"{tmp_path}/cp").awaitTermination()
    add("a")
    run()
    first = Store.load(spark, f"{tmp_path}/store").count()
    add("b")
    run()
    store = Store.load(spark, f"{tmp_path}/store")
    assert first > 0 and store.count() == 2 * first and {r.origin for r in store.chunks.select("origin").distinct().collect()} == {"a", "b"}
    assert store.manifest["version"] == 2 and store.chunks.select("id").distinct().count() == store.count()


def test_streamed_memory(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 2, None, "b"), (1, 2, "user", None), (1, 1, "user", "a"), (2, 1, "user", "x"), (3, 1, "user", "x"), (3, 2, "reset", None), (3, 3, "user", "y")]
    fx.frame(spark, rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = last_turns_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), n=2)
    q = stream.writeStream.format("memory").queryName("kept").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.conv_id, r.turn_count, r.turns) for r in spark.table("kept").collect()} == {(1, 3, "2|2"), (2, 1, "1"), (3, 1, "3")}


def test_graph_job(spark, tmp_path):
    docs = spark.createDataFrame([(1, "The Rhine meets Basel. NASA uses Linux here"), (2, "Linux of Basel")], "doc_id long, text string")
    with pytest.raises(RuntimeError, match="graph too small"):
        graph.build(docs, f"{tmp_path}/g")
    told = graph.build(docs, f"{tmp_path}/g", least_entities=2, least_relations=2)
    nodes, triples = graph.load(spark, f"{tmp_path}/g")
    assert told["entities"] == nodes.count() and ("nasa", "uses", "linux") in {(r.s, r.p, r.o) for r in triples.collect()}
    assert {r.id: r.type for r in nodes.collect()}["nasa"] == "acronym"
    nodes.sparkSession.createDataFrame([(2,)], "schema_version int").coalesce(1).write.mode("overwrite").json(f"{tmp_path}/g/manifest")
    with pytest.raises(ValueError, match="schema version 2"):
        graph.load(spark, f"{tmp_path}/g")
    assert Symbolic.lazy(spark, f"{tmp_path}/none") is None
    blank = spark.createDataFrame([(1, " ", "x", None, {})], "seq long, id string, label string, type string, attributes map<string,string>")
    with pytest.raises(Exception, match="needs an id"):
        graph.upserted(blank).collect()


def test_engine_goes_on_after_a_failure(spark):
    class Broken:
        name = "symbolic"

        def run(self, queries, so_far):
            raise OSError("gone")

        def describe(self):
            return {"stage": "symbolic", "healthy": False}

    engine = Engine().register(Broken()).register(Verify()).register(None)
    out = {r.query_id: r for r in engine.process(fx.questions(spark)).collect()}
    assert len(out) == len(fx.QUESTIONS) and out[1].errors == ["symbolic: OSError"] and out[6].errors == [] and out[6].generated_by == "code"
    assert engine.health() == {"symbolic": False, "verify": True} and engine.describe()[-1]["capabilities"] == ["template"]


def test_engine_on_a_stream(spark, tmp_path):
    fx.questions(spark).coalesce(1).write.parquet(f"{tmp_path}/q")
    seen, counted = [], []
    q = Engine().register(Verify()).process_stream(spark.readStream.schema("query_id long, text string").parquet(f"{tmp_path}/q"), lambda rows, _: seen.extend(rows.collect()), f"{tmp_path}/cp", lambda rows: counted.extend(rows.filter("level = 3").collect()))
    q.awaitTermination()
    assert len(seen) == len(fx.QUESTIONS) and counted[0].n == len(fx.QUESTIONS)


def test_retrieval_stage_with_a_store(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Lovelace wrote the first program"), (2, "a cat sleeps")], "id long, text string").withColumn("embedding", hybrid.encoded(F.col("text")))
    store = Store.save(docs, f"{tmp_path}/s")
    q = spark.createDataFrame([(1, "What is the first program that Lovelace wrote"), (2, "What is zebra crossing?")], "query_id long, text string")
    out = {r.query_id: r for r in Engine().register(Retrieve(store, threshold=0.6)).process(q).collect()}
    assert "Lovelace wrote" in out[1].answer and out[2].form == "not_found"


def test_intent_training(spark, tmp_path):
    words = {"factual": "capital population distance", "reasoning": "because therefore consequence", "creative": "poem story melody", "conversation": "hello thanks goodbye", "complex": "strategy roadmap tradeoff", "code": "function variable compile"}
    rows = [(f"{w} {i} {w2}", k) for k, v in words.items() for i in range(12) for w in v.split() for w2 in v.split()]
    examples = spark.createDataFrame(rows, "query string, label string")
    model = intent.train(examples, f"{tmp_path}/m", floor=0.65)
    assert model.accuracy > 0.9
    again = intent.Intent.load(spark, f"{tmp_path}/m")
    r = again.classify(spark.createDataFrame([(1, "poem story")], "query_id long, text string")).first()
    assert r.label == "creative" and abs(sum(r.probabilities.values()) - 1) < 1e-3 and len(r.probabilities) == 6
    for wrong in ({"dim": 32}, {"encoder": "e5"}, {"labels": ("code",)}):
        with pytest.raises(ValueError):
            intent.Intent.load(spark, f"{tmp_path}/m", **wrong)
    with pytest.raises(RuntimeError, match="under"):
        intent.train(examples.withColumn("label", F.element_at(F.array(*map(F.lit, readers.LABELS)), (F.pmod(F.xxhash64("query"), F.lit(6)) + 1).cast("int"))), f"{tmp_path}/bad", floor=0.65)
    with pytest.raises(ValueError):
        metrics.stratified_split(examples, "label", "query", 1.0)


def test_packed_sentences_against_a_second_way():
    import random

    rng = random.Random(2)
    for _ in range(200):
        text = " ".join("".join(rng.choice("abc ") for _ in range(rng.randrange(2, 500))).strip() + rng.choice(".!? ") for _ in range(rng.randrange(1, 9)))
        flat, sentences, at = " ".join(text.split()), [], 0
        for i, c in enumerate(flat):
            if c == " " and flat[i - 1] in ".!?":
                sentences.append(flat[at:i])
                at = i + 1
        sentences.append(flat[at:])
        want, held = [], []
        for s in sentences:
            if len(s) > 400:
                want.append(" ".join(held))
                held = []
                at = 0
                while at < len(s):
                    want.append(s[at : at + 400])
                    at += 350
            elif sum(map(len, held)) + len(held) + len(s) <= 400:
                held.append(s)
            else:
                want.append(" ".join(held))
                held = [s]
        want.append(" ".join(held))
        assert plain.packed_sentences(text) == [c for c in want if len(c.strip()) > 20]


def test_fences_and_oversize_blocks():
    text = "T\n===\n\n" + "\n".join(f"line {i} of a long block" for i in range(200))
    out = chunks.code_chunks(text)
    assert "\n".join(c for _, c in out).count("\n") == 199 and all(len(c) <= 1500 for _, c in out)
    assert chunks.units("```\na\n\n~~~\n# x\n```\n\nb") == [("", "```\na\n\n~~~\n# x\n```"), ("", "b")]
    assert chunks.units("# no markdown here", markdown=False) == [("", "# no markdown here")]
    assert chunks.code_chunks("x" * 2000) == [("", "x" * 2000)]  # one line stays whole


def test_encoders(spark):
    class Fake:  # a model of two entries: lengths of the text and its first word
        def encode(self, texts):
            return [[float(len(t)), float(len(t.split()[0]))] for t in texts]

    rows = spark.createDataFrame([(1, "two words"), (2, "x")], "id long, text string")
    model = encoders.register(encoders.ModelEncoder("my-e5-small", 2, Fake))
    assert encoders.get("my-e5-small") is model and encoders.get() is encoders.get("hash")
    got = {r.id: r.v for r in rows.select("id", model(F.col("text"), "query").alias("v")).collect()}
    x = np.array([len("query: two words"), len("query:")], float)
    assert np.allclose(got[1], x / np.linalg.norm(x))
    broken = encoders.ModelEncoder("none", 2, lambda: 1 / 0)
    assert rows.select(broken(F.col("text")).alias("v")).filter("v IS NOT NULL").count() == 0
    assert abs(sum(v * v for v in encoders.encode_one(spark, "some query", encoders.get())) - 1) < 1e-9
    with pytest.raises(ValueError):
        encoders.encode_one(spark, "  ", encoders.get())
    with pytest.raises(Exception, match="a query is blank"):
        encoders.queries(spark.createDataFrame([(" ",)], "text string"), encoders.get()).collect()
    with pytest.raises(KeyError):
        encoders.get("no such")


def test_remote_table(spark, tmp_path):
    assert remote.connect(spark, f"{tmp_path}/r", 2) is None
    table = remote.RemoteTable.create(spark, f"{tmp_path}/r", 2)
    table.insert_one("a", [1, 0])
    table.insert(spark.createDataFrame([("b", [0.0, 2.0]), ("c", [1.0, 1.0])], "content string, embedding array<float>"))
    assert remote.connect(spark, f"{tmp_path}/r", 2).count() == 3
    assert [(r.content, r.similarity) for r in table.search([0.0, 1.0], 2).collect()] == [("b", 1.0), ("c", 0.707107)]
    with pytest.raises(Exception, match="2 entries"):
        table.insert_one("d", [1.0])
    with pytest.raises(ValueError):
        table.search([1.0])


def test_benchmark_cases(spark):
    cases = spark.createDataFrame([(1, "What is a quasar?", True), (2, "look\n```sql\nselect 1\n```", False)], "query_id long, text string, expect_refusal boolean")
    told = metrics.summary(metrics.run_cases(cases, Engine().register(Verify()).process)).first()
    assert (told.n, told.n_refused, told.refusal_rate) == (2, 1, 1.0)
