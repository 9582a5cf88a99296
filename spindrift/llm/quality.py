"""Quality rules with adaptive thresholds (operator 4), in built-in functions only.

Counts are made inside each row, so texts are never exploded or shuffled.  The
thresholds come from mergeable quantile sketches with logarithmic buckets
(relative error ``GAMMA - 1``): a sketch is a table of bucket counts, sketches
merge by adding, and every (language, source) has one for each measure.  Groups
of fewer than ``least_group`` rows use the merged sketch of their language, and
languages of fewer that of the whole table.  A measure is out of bounds beyond
median + spread * (upper quartile - median) + slack; medians and quartiles move
with the source, while junk below half of a group's rows doesn't move them far.
Word lengths are judged for texts of ``least_words`` words or more.

Defined results: null text has no words and fails the base rules; a null
language or source is in one group with the empty one; repeated rows are judged each; an empty table
gives no rows; columns other than the four named are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SPACE = r"[\\x20\\x09-\\x0D]+"
GAMMA, MIN_GROUP, MIN_WORDS = 1.02, 100, 50
#: measure: (spread, slack); symbols and repeated lines per thousand, characters per hundred words
FENCES = {"symbols": (4, 100), "word_chars": (8, 100), "dup_lines": (4, 500)}


def let(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``value`` once a row and uses it in ``body`` as ``name``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _repeated() -> str:
    """Words in windows of five that occur twice or more, from ``ws``."""
    grams = "if(size(hw) < 5, array(), transform(sequence(0, size(hw) - 5), i -> xxhash64(hw[i], hw[i + 1], hw[i + 2], hw[i + 3], hw[i + 4])))"
    twins = "filter(s, (e, k) -> get(s, k - 1).h = e.h OR get(s, k + 1).h = e.h)"
    length = "5L + aggregate(transform(ps, (p, k) -> least(5, p - coalesce(get(ps, k - 1), p))), 0L, (a, x) -> a + x)"
    spans = let("sort_array(transform(g, (x, k) -> struct(x AS h, k AS p)))", "s", let(f"sort_array(transform({twins}, e -> e.p))", "ps", length))
    return let("transform(ws, w -> xxhash64(w))", "hw", let(f"cast({grams} AS array<bigint>)", "g", f"if(size(array_distinct(g)) = size(g), 0L, {spans})"))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The counts of each row; the text is gone from here on."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source"))
    words = let(f"filter(split(t, '{SPACE}'), w -> w <> '')", "ws", f"struct(cast(size(ws) AS bigint) AS n_words, {_repeated()} AS n_repeat_words)")
    lines = let(f"filter(split(t, '\\n'), l -> l RLIKE '[^\\\\x20\\\\x09-\\\\x0D]')", "ls", "struct(cast(size(ls) AS bigint) AS n_lines, cast(size(ls) - size(array_distinct(ls)) AS bigint) AS n_dup_lines)")
    blanks = " \t\n\x0b\f\r"
    return rows.select(
        "doc_id", "lang", "source", F.expr(words).alias("w"), F.expr(lines).alias("l"),
        F.length(F.translate("t", blanks, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
    ).select("doc_id", "lang", "source", "w.*", "l.*", "word_chars", "n_symbols")


def _with_measures(counts: DataFrame) -> DataFrame:
    per = lambda n, of, by: F.expr(f"{n} * {by} div greatest({of}, 1)")
    return counts.withColumns({"symbols": per("n_symbols", "n_words", 1000), "word_chars_100": per("word_chars", "n_words", 100), "dup_lines": per("n_dup_lines", "n_lines", 1000)})


def thresholds(counts: DataFrame, least_group: int = MIN_GROUP) -> DataFrame:
    """(lang, source, symbols_max, word_chars_max, dup_lines_max) of each group, from merged sketches."""
    long = _with_measures(counts).select("lang", "source", F.expr("stack(3, 'symbols', symbols, 'word_chars', word_chars_100, 'dup_lines', dup_lines) AS (measure, v)"))
    bucket = F.when(F.col("v") <= 0, F.lit(-1)).otherwise(F.ceil(F.log(F.col("v").cast("double")) / F.log(F.lit(GAMMA))).cast("int"))
    sketch = long.groupBy("lang", "source", "measure", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    levels = (sketch.withColumn("level", F.expr("explode(array(0, 1, 2))"))
              .withColumns({"lang": F.expr("if(level < 2, lang, null)"), "source": F.expr("if(level < 1, source, null)")})
              .groupBy("level", "lang", "source", "measure", "bucket").agg(F.sum("n").alias("n")))
    value = "if(bucket < 0, 0D, power({g}, bucket))".format(g=f"{GAMMA}D")
    group = Window.partitionBy("level", "lang", "source", "measure")  # a sketch has as many rows as buckets
    ranked = levels.select("level", "lang", "source", "measure", F.expr(value).alias("v"), F.sum("n").over(group.orderBy("bucket")).alias("upto"), F.sum("n").over(group).alias("total"))
    quartiles = ranked.groupBy("level", "lang", "source", "measure").agg(F.max("total").alias("total"), F.expr("min(v) FILTER (WHERE 2 * upto >= total)").alias("q50"), F.expr("min(v) FILTER (WHERE 4 * upto >= 3 * total)").alias("q75"))
    fence = "CASE measure " + " ".join(f"WHEN '{m}' THEN q50 + {k} * (q75 - q50) + {s}" for m, (k, s) in FENCES.items()) + " END"
    wide = quartiles.groupBy("level", "lang", "source").agg(F.max("total").alias("total"), *[F.expr(f"max({fence}) FILTER (WHERE measure = '{m}')").alias(f"{m}_max") for m in FENCES])
    names = [f"{m}_max" for m in FENCES]
    at = lambda k, p: wide.filter(f"level = {k}").select("lang", *(["source"] if k == 0 else []), F.col("total").alias(f"total{p}"), *[F.col(n).alias(n + p) for n in names])
    found = at(0, "").join(at(1, "_l"), "lang").join(F.broadcast(at(2, "_a").drop("lang")))  # the last has one row
    pick = lambda n: F.when(F.col("total") >= least_group, F.col(n)).when(F.col("total_l") >= least_group, F.col(n + "_l")).otherwise(F.col(n + "_a"))
    return found.select("lang", "source", *[pick(n).alias(n) for n in names])


def judge(docs: DataFrame, *, least_group: int = MIN_GROUP, least_words: int = MIN_WORDS, **columns: str) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, symbols_failed, word_chars_failed, dup_lines_failed)."""
    counts = common.written(measured(docs, **columns), "quality")
    joined = _with_measures(counts).join(thresholds(counts, least_group), ["lang", "source"])
    failed = joined.withColumns({
        "base_failed": F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"),
        "symbols_failed": F.expr("symbols > symbols_max"),
        "word_chars_failed": F.expr(f"n_words >= {least_words} AND word_chars_100 > word_chars_max"),
        "dup_lines_failed": F.expr("dup_lines > dup_lines_max"),
    })
    kept = F.expr("NOT (base_failed OR symbols_failed OR word_chars_failed OR dup_lines_failed)")
    return failed.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "symbols_failed", "word_chars_failed", "dup_lines_failed")
