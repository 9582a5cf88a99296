"""Chunkers as expressions against plain versions of them."""

import random

from pyspark.sql import functions as F

from spindrift.operators import chunks
from tests import plain


def _texts() -> list[str]:
    rng = random.Random(5)
    bits = ["word", "Über", "x" * 90, "y" * 420, ". ", "! ", "? ", ".", " ", "  ", "\n", "\n# ", "\n## head\n", "\n##### five ", "#", "\u00a0", "\u2028", "\r\n", "\x0b", "\x1d", "\x85", "😀", "\n#### T\u3000"]
    made = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 120))) for _ in range(400)]
    odd = ["", " ", "\n", "# ", "# only", "#\n", "a. . b", "# A\nx\n## B\n\n# C\ny", "z" * 400, "z" * 401, ("z" * 399 + ". ") * 3, "z" * 750, "s. " * 5000, "a" * 30_000, "Some sentence of a very long text. " * 30_000]
    return made + odd


def test_against_plain(spark):
    texts = _texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    t = F.col("text")
    rows = docs.select("doc_id", chunks.sections(t).alias("s"), chunks.packed_sentences(t).alias("p"), chunks.prose(t).alias("b")).collect()
    assert len(rows) == len(texts)
    prose = lambda text: [(n, c) for n, body in plain.sections(text) for c in plain.packed_sentences(body)]
    for r in rows:
        text = texts[r.doc_id]
        assert [tuple(x) for x in r.s] == plain.sections(text)
        assert r.p == plain.packed_sentences(text)
        assert [tuple(x) for x in r.b] == prose(text)


def test_nulls_clashing_names_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, "q"), (2, "# T\nA sentence that is long enough.", "r"), (2, "# T\nA sentence that is long enough.", "r")], "doc_id long, text string, chunk string")
    got = [tuple(r) for r in chunks.exploded(docs, chunks.prose(F.col("text")), "doc_id").collect()]
    assert got == [(2, 0, "T", "A sentence that is long enough.")] * 2
    assert chunks.exploded(docs.limit(0), chunks.packed_sentences(F.col("text")), "doc_id").collect() == []
    plan = chunks.exploded(docs, chunks.prose(F.col("text")), "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
