"""Small inputs of our own for operators that the driver's tables don't feed, and SQL of the results worked out by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUESTIONS = [
    (1, "What is a quasar?"), (2, "Compare the Danube and the Rhine"), (3, "Why does software fail?"), (4, "hello there"), (5, "Write a poem about a river and an ocean and a mountain"),
    (6, "fix this\n```python\nx = (1\n```\nand\n```css\na { b: c }\n```"), (7, "Who was Ada Lovelace?"), (8, "difference between the cat and a dog?"), (9, "analysis of verbs"), (10, "thanks"), (11, "Define entropy"), (12, "qu'est-ce que l'énergie ?"),
]

#: seq, id, label, type, attributes
ENTITIES = [
    (1, "spark", "Spark", "concept", {"kind": "engine"}), (2, "jvm", "JVM", "acronym", {}), (3, "spark", "Apache Spark", "software", {"since": "2010", "kind": "cluster engine"}),
    (4, "arrow", "Arrow", "software", {"kind": "format"}), (5, "python", "Python", "software", {}), (6, "duckdb", "DuckDB", "software", {"kind": "database"}),
]
#: source, s, p, o, confidence
RELATIONS = [
    ("a", "spark", "uses", "jvm", 0.5), ("b", "spark", "uses", "jvm", 0.9), ("a", "spark", "uses", "jvm", 0.7), ("a", "spark", "uses", "arrow", 0.7), ("b", "duckdb", "uses", "arrow", 0.7),
    ("b", "spark", "has", "optimizer", 0.7), ("c", "duckdb", "has", "optimizer", 0.7), ("c", "duckdb", "co_occurs_with", "spark", 0.3), ("c", "python", "is_a", "language", 0.8), (None, "python", "is_a", "language", 0.6), ("a", "spark", "of", "spark", 0.5),
]
#: s, p, o, count, confidence, sources
DAMAGED = [("a", "uses", "b", None, 0.7, ["x", "y"]), ("a", "has", "c", 1, 0.4, ["x", "y", "z"]), ("b", "of", "c", 5, 0.5, []), ("c", "of", "d", 0, 0.5, None)]

#: id, language, code
SNIPPETS = [
    (1, "Python", "import os\nfrom a.b import c\n\nclass K:\n    async def f(self):\n        pass\n\nif __name__ == '__main__':\n    K()\n"), (2, "py", "def f(:\n"), (3, "py", "a = 1\n" * 7), (4, "sql", "select 1; -- drop x\ninsert into t values ('a;b')"), (5, "SQL", "hello"),
    (6, "html", "<html><body><p>a<br></p></body></html>"), (7, "html", "<p><b>x</p></i>"), (8, "css", "@media print { a { b: c } }\n@import 'x';"), (9, "css", "a { b }"), (10, "css", "a { b: c"), (11, "cobol", "x"), (12, "python", "  "), (13, "sh", "echo 1"),
]

#: id, html
PAGES = [
    (1, "<div class='navheader'><p>nav</div><h1>Body</h1><p>text   stays</p>"), (2, "<style>x{}</style><h2>T &amp; U</h2><ul><li>one<li>two</ul><pre>a  b\n&lt;c&gt;</pre><script>if (a<b) {}</script>tail"),
    (3, "<table><tr><td>a</td><td>b</td></tr></table><br>x<br/>y<div class='navfooter'><div>inner</div>gone</div>kept"), (4, None),
]

#: path, raw page
WEB = [("web/css/x", "---\ntitle: \"Grid & flow\"\nslug: a\n---\n{{CSSRef}}\nUse {{cssxref(\"grid\")}} or {{HTMLElement('div', 'x')}} with {{Note}}care.\n"), ("web/api/y", "no head\n{{A}} {{B}}\nbody"), ("learn/z", "---\nslug: b\n---\ntext")]
CONTAINER = [("a", "---\ntitle: Run it\n---\n{{< note >}}\nKeep {{% param \"x\" %}}calm.\n{{< /note >}}\nend"), ("b", "plain {{ kept }}")]

#: query_id, id, rank, score, score_cosine, text
GATED = [
    (1, 10, 1, 1.10, 0.92, "# Danube\nThe Danube flows ## far .. away"), (1, 11, 2, 1.05, 0.86, "second"), (1, 12, 3, 1.02, 0.79, "boosted but far"),
    (2, 13, 1, 0.95, 0.95, "nothing of the kind"), (3, 14, 1, 0.90, 0.83, "too far"), (4, 15, 1, 0.99, 0.99, "the and for"), (5, 16, 1, 0.91, 0.91, "DÉBIT du fleuve"),
]
ASKED = [(1, "Where does the Danube flow?"), (2, "What is entropy?"), (3, "too far away"), (4, "the and"), (5, "quel débit ?")]

#: query, expect_refusal, refused, generated_by, latency_s, response_chars, grounded
RESULTS = [
    ("a", True, True, "none", 0.25, 40, False), ("b", True, False, "model", 2.5, 300, False), ("c", False, False, "model", 4.0, 500, True), ("d", False, False, "template", 0.5, 200, True), ("e", False, False, "model", 8.25, 400, True),
]
#: query_id, language, keywords; and query_id, language, origin
WANTED = [(1, "sql", ["join", "merge"]), (2, "css", ["grid"]), (3, "html", ["div"])]
FOUND = [(1, "sql", "doc-JOIN-types"), (1, "css", "x"), (2, "html", "grid"), (2, "css", "flex")]

#: query_id, kind, generated_by, latency_s
RECORDED = [(1, "factual", "template", 0.5), (2, "factual", "model", 1.5), (3, "code", "code", 0.25), (4, "factual", "template", 0.75)]

#: vec_id, embedding, key: five near each of two axes, one of the second key exactly on the first axis, and one without a key
TRAP = [
    *[(i, [1.0, 0.02 * i, 0.0, 0.01], "a") for i in range(1, 6)], *[(10 + i, [0.02 * i, 1.0, 0.01, 0.0], "b") for i in range(1, 6)], (20, [1.0, 0.0, 0.0, 0.0], "b"), (30, [0.9, 0.1, 0.0, 0.0], None),
]


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def questions(spark: SparkSession) -> DataFrame:
    return frame(spark, QUESTIONS, "query_id long, text string")


def _value(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return f"{v}::BIGINT"
    if isinstance(v, float):
        return f"{v!r}::DOUBLE"
    return "'" + v.replace("'", "''") + "'"


def golden(columns: str, rows: list[tuple]) -> str:
    """SQL that gives the rows, of columns as in ``a b c``."""
    names = columns.split()
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_value, r)) + ')' for r in rows)}) AS t({', '.join(names)})"


def values(rows: list[tuple], columns: str) -> str:
    """The same as a table expression."""
    return f"({golden(columns, rows)})"
