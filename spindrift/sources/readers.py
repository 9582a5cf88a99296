"""Sources: scans of files, the registry of named sources, labelled data and configuration.

Every registered source gives rows (origin, text, source, language).
"""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import verify

SOURCES: dict[str, Callable[..., DataFrame]] = {}
ROW = ("origin", "text", "source", "language")
#: Labels of queries, in their fixed order.
LABELS = ("factual", "reasoning", "creative", "conversation", "complex", "code")
#: Languages of the web documentation's areas; other areas are named after themselves.
AREAS = {"api": "javascript"}
#: Commands whose manual pages have a language of their own, and whether their subcommands' pages share it; all others are about the shell.
MANUALS = {"bash": ("bash", False), "git": ("git", True)}


def text_files(spark: SparkSession, path: str, glob: str = "*.{txt,md}") -> DataFrame:
    """One row a file, at any depth: (path, name, text); files that can't be read are skipped."""
    rows = spark.read.option("ignoreMissingFiles", True).text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))


def text_globs(spark: SparkSession, path: str, globs: list[str]) -> DataFrame:
    """(path, name, text, pattern): files of several patterns, each once, under the first pattern that takes it; ordered by (pattern, path)."""
    rows = None
    for i, g in enumerate(globs):
        own = text_files(spark, path, g).withColumn("pattern", F.lit(i))
        rows = own if rows is None else rows.union(own)
    first = rows.groupBy("path").agg(F.min_by(F.struct("name", "text", "pattern"), "pattern").alias("f"))
    return first.select("path", "f.name", "f.text", "f.pattern").orderBy("pattern", "path")


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def bundles(spark: SparkSession, path: str, categories: list[str]) -> DataFrame:
    """Text bundles by category, the folder under ``path`` that they are in; categories without files give no rows."""
    rows = text_files(spark, path, "*.txt").withColumn("category", F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1))
    return rows.filter(F.col("category").isin(*categories)).select(F.concat_ws("/", "category", "name").alias("origin"), "text", F.lit("bundle").alias("source"), F.lit("python").alias("language"))


def web_docs(spark: SparkSession, path: str, areas: list[str] | None = None) -> DataFrame:
    """Index pages of web documentation under the areas, without their head and macros."""
    rows = text_files(spark, path, "index.md").withColumn("page", T.web_page(F.col("text")))
    area = F.regexp_extract("path", r"(web/[^/]+)/", 1)
    rows = rows.withColumn("area", F.lower(area))
    rows = rows if areas is None else rows.filter(F.col("area").isin(*[a.lower() for a in areas]))
    return rows.select(F.when(F.col("page.title") != "", F.col("page.title")).otherwise(F.col("path")).alias("origin"), F.col("page.body").alias("text"), F.lit("web").alias("source"), T.area_language(F.col("area"), AREAS).alias("language"))


def container_docs(spark: SparkSession, path: str, areas: list[str] | None = None) -> DataFrame:
    """Container documentation in markdown under the areas, without its head and shortcodes."""
    rows = text_files(spark, path, "*.md").withColumn("page", T.container_page(F.col("text")))
    if areas is not None:
        rows = rows.filter(F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).isin(*areas))
    return rows.select(F.when(F.col("page.title") != "", F.col("page.title")).otherwise(F.col("name")).alias("origin"), F.col("page.body").alias("text"), F.lit("container").alias("source"), F.lit("docker").alias("language"))


def database_docs(spark: SparkSession, path: str, prefixes: list[str] | None = None) -> DataFrame:
    """HTML pages of database documentation whose stem is a prefix or begins with one and a dash; no prefixes take all."""
    rows = text_files(spark, path, "*.html").withColumn("stem", stem(F.col("name")))
    if prefixes:
        wanted = F.lit(False)
        for p in prefixes:
            wanted = wanted | (F.col("stem") == p) | F.col("stem").startswith(f"{p}-")
        rows = rows.filter(wanted)
    return verify.html_texts(rows, "stem", "text").select(F.col("id").alias("origin"), "text", F.lit("database").alias("source"), F.lit("sql").alias("language"))


def manuals(rows: DataFrame) -> DataFrame:
    """Rendered manual pages (page, text): overstrikes go, blank pages too."""
    clean = T.no_overstrike(F.col("text"))
    return rows.withColumn("text", clean).filter(F.trim("text") != "").select(F.col("page").alias("origin"), "text", F.lit("man").alias("source"), T.manual_language(F.col("page"), MANUALS).alias("language"))


def encyclopedia(rows: DataFrame, *, most: int | None = None, least_chars: int = 400) -> DataFrame:
    """Articles (title, text) of ``least_chars`` or more; ``most`` is a cap on articles where one is asked for.  Batch or stream (without a cap)."""
    own = rows.withColumn("text", F.trim("text")).filter(F.length("text") >= least_chars)
    own = own if most is None else own.limit(most)
    return own.select(F.col("title").alias("origin"), "text", F.lit("encyclopedia").alias("source"), F.lit(None).cast("string").alias("language"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, at, line): the lines of text files with their numbers from 1.  Files are read by splits, whose numbers of lines are counted first and added up over each file."""
    own = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"), F.col("value").alias("line"))
    splits = own.groupBy("path", "split").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    file = Window.partitionBy("path").orderBy("split")  # as many rows as the file has splits
    before = splits.select("path", "split", "first", (F.sum("n").over(file) - F.col("n")).alias("before"))
    return own.join(before, ["path", "split"]).select("path", (F.col("before") + F.col("row") - F.col("first") + 1).alias("at"), "line")


def labelled(spark: SparkSession, path: str, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """JSON lines of (query, label).  Blank lines are skipped; bad JSON, a missing key, a blank query or an unknown label fails the load and names the line."""
    lines = numbered_lines(spark, path).filter("trim(line) <> ''")
    parsed = lines.withColumn("r", F.from_json("line", "query string, label string"))
    wrong = (
        F.when(F.get_json_object("line", "$").isNull() | ~F.trim("line").startswith("{"), "bad JSON")
        .when(F.col("r.query").isNull(), "no query").when(F.col("r.label").isNull(), "no label")
        .when(F.trim("r.query") == "", "a blank query").when(~F.col("r.label").isin(*labels), F.concat(F.lit("unknown label "), F.col("r.label")))
    )
    failed = F.raise_error(F.concat(F.lit("line "), F.col("at").cast("string"), F.lit(": "), F.col("wrong"))).cast("string")
    told = parsed.withColumn("wrong", wrong)
    return told.select(F.when(F.col("wrong").isNotNull(), failed).otherwise(F.col("r.query")).alias("query"), F.col("r.label").alias("label"))


def remote_topk(table: DataFrame, query: list[float], k: int = 5) -> DataFrame:
    """(id, content, metadata, similarity) of a vector table (id, content, embedding, metadata): one minus the cosine distance, the best k."""
    from ..operators.search import dot, of_dimension

    q = F.array(*[F.lit(float(x)) for x in query])
    e = of_dimension(F.col("embedding"), len(query))
    similarity = dot(e, q) / F.sqrt(dot(F.col("embedding"), F.col("embedding")) * dot(q, q))
    return table.select("id", "content", "metadata", F.round(similarity, 6).alias("similarity")).orderBy(F.desc("similarity"), "id").limit(k)


def newest_stable(versions: DataFrame, column: str = "version") -> DataFrame:
    """(version): the largest by numbers of major and minor; others than plain numbers are no stable versions."""
    own = versions.filter(F.col(column).rlike(r"^\d+\.\d+$")).select(F.col(column).alias("version"), F.split(column, r"\.").cast("array<int>").alias("n"))
    return own.agg(F.max_by("version", "n").alias("version"))


def read_env(lines: list[str], real: Mapping[str, str] | None = None) -> dict[str, str]:
    """KEY=value lines; comments and blanks are skipped, quotes go, and what the real environment has wins."""
    real = os.environ if real is None else real
    out = {}
    for line in lines:
        key, sign, value = line.strip().removeprefix("export ").partition("=")
        if sign and key.strip() and not key.startswith("#"):
            value = value.strip()
            quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "'\""
            out[key.strip()] = value[1:-1] if quoted else value
    return {k: real.get(k, v) for k, v in out.items()}


def read_yaml(path: str, defaults: Mapping | None = None) -> dict:
    """The mapping of a YAML file (configuration, rule templates) laid over ``defaults``, level by level; a missing or empty file gives the defaults, anything but a mapping fails."""
    import yaml

    try:
        with open(path, encoding="utf-8") as f:
            told = yaml.safe_load(f)
    except FileNotFoundError:
        told = None
    told = {} if told is None else told
    if not isinstance(told, Mapping):
        raise ValueError(f"{path} holds no mapping")
    return _over(defaults or {}, told)


def _over(under: Mapping, over: Mapping) -> dict:
    both = {k: _over(under[k], v) if isinstance(v, Mapping) and isinstance(under.get(k), Mapping) else v for k, v in over.items()}
    return {**under, **both}


def source(name: str, *args, **kw) -> DataFrame:
    """The rows of a named source, in the order of ``ROW``."""
    if name not in SOURCES:
        raise KeyError(f"unknown source {name}; there are {', '.join(sorted(SOURCES))}")
    return SOURCES[name](*args, **kw).select(*ROW)


def sources(asked: list[tuple[str, dict]], spark: SparkSession) -> DataFrame:
    """The rows of several sources, one after the other."""
    out = None
    for name, kw in asked:
        own = source(name, spark, **kw)
        out = own if out is None else out.unionByName(own)
    return out


def _prose(spark: SparkSession, path: str, glob: str = "*.{txt,md}") -> DataFrame:
    return text_files(spark, path, glob).select(F.col("name").alias("origin"), "text", F.lit("text").alias("source"), F.lit(None).cast("string").alias("language"))


SOURCES |= {"text": _prose, "bundle": bundles, "web": web_docs, "container": container_docs, "database": database_docs}
