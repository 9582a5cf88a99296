import duckdb
import pytest

import __spark_entry__ as entry
from spindrift.operators import chunks, graph, verify
from spindrift.plans import answers, base, registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    return [tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in rows]


@pytest.mark.parametrize("name", sorted({**registry.SQL, **base.EXAMPLE_SQL}))
def test_against_sql(spark, duck, name):
    """Registered queries over the tables, and examples over small inputs of our own."""
    got = {**registry.QUERIES, **base.EXAMPLES}[name](spark, SF)
    names = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(names)} FROM ({ {**registry.SQL, **base.EXAMPLE_SQL}[name]})").fetchall()
    assert sorted(map(repr, plain([tuple(r) for r in got.select(*names).collect()]))) == sorted(map(repr, plain(want)))


def test_ivf_recall(spark):
    sf = "/root/testdata/sf0.1"
    exact = {(r.query_id, r.vec_id) for r in registry.exact_topk(spark, sf).collect()}
    found = {(r.query_id, r.vec_id) for r in registry.ivf_topk(spark, sf).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_chunkers():
    code = chunks.code_chunks("# T\n\n```\na = 1\n\n# no heading\nb = 2\n```\n\nlonger text that makes the chunk long enough to stay")
    assert code[0][0] == "T" and "# no heading" in code[0][1]
    assert all(len(p) <= 10 for p in chunks.message_parts("abc def\nghi jklm nop", 10))


def test_verifiers():
    assert verify.verify("py", "def f():\n  return 1")[0] and not verify.verify("python", "def f(:")[0]
    assert verify.verify("cobol", "x")[0] is None and verify.verify("py", " ")[0] is False
    assert verify.verify("js", "x")[0] is None  # not checked unless asked for
    assert verify.verify("sh", "if true; then echo 1; fi", outside=True)[0] and not verify.verify("bash", "if true; then", outside=True)[0]
    assert verify.checked_by(["no-such-program"], "x") == ["no-such-program is not installed"]
    assert verify.verify("bash", "#!/bin/sh\nf() { :; }\nfunction g { :; }", outside=True)[4] == {"functions": ["f", "g"], "shebang": True, "lines": 3}
    found = verify.javascript("import a from 'b'; const f = (x) => x; class K {} function* g() {} require('c')")[2]
    assert found == {"functions": ["f", "g"], "classes": ["K"], "imports": ["b", "c"]}


def test_all_pairs_of_a_sentence(spark):
    names = [f"{a}{b}lon" for a in "BCDFG" for b in "aeiou"] + [f"{a}{b}{c}ron" for a in "BCDFGHK" for b in "aeiou" for c in "lmn"]
    docs = spark.createDataFrame([(1, " and ".join(names)), (2, "Talon and Belon. Belon and Talon")], "doc_id long, text string")
    got = {(r.doc_id, r.s, r.o) for r in graph.cooccurrences(docs).collect()}
    low = [n.lower() for n in names]
    assert got == {(1, a, b) for i, a in enumerate(low) for b in low[i + 1 :]} | {(2, "talon", "belon")}


def test_intents_beyond_a_hundred(spark, tmp_path):
    rows = [(i, f"word{i % 104} text", f"l{i % 104:03}") for i in range(208)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.label for r in answers.intent_classify(spark, str(tmp_path)).collect()}
    assert None not in got and got & {f"l{i}" for i in range(100, 104)}
