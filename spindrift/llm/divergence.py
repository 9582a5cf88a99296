"""Audit of how far sources diverge, by DuckDB over shards (operator 13).

1. Tasks count the terms of their texts: (lang, source, term) with occurrences
   and documents, summed over a run of texts before they are sent.
2. Rows are dealt by language and term.  In each partition DuckDB sums them and
   keeps the terms in enough documents of the language.
3. Spark sums what the groups (lang, source) and languages hold.
4. Kept terms are dealt into shards of one language each, with the language's
   groups beside them.  DuckDB computes in integers each term's share in every
   group, the partial sums of each pair of groups and the first terms of each
   group.  Terms that a group lacks aren't listed for it: pairs are summed from
   what either group has by itself, from a histogram of its shares, and what both
   have, so the work follows the rows that exist.
5. Spark adds the pairs' partial sums and ranks.

Hot languages are many shards; hot terms are one row a task and group.  A
language's sources are held together: its pairs are rows of the result.

Defined results: null text, lang and source are ''; groups without terms have
their pairs; a language without kept terms has pairs of value 0; repeated rows
are documents of their own; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common, words

#: Words counted together and distinct ones of them at most, rows that DuckDB takes at a time, rows of a partition and of a shard.
TOGETHER, DISTINCT, AT_ONCE, PARTITION, SHARD = 3_000_000, 600_000, 500_000, 1_500_000, 20_000
#: Added to every count.
SMOOTH = 5

_NORMAL = bytes(common.ASCII_LOWER[c] if 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_COUNTS = "lang string, source string, term string, n long, docs long"


def _counted(docs: DataFrame) -> DataFrame:
    """``_COUNTS`` of ``docs`` (lang, source, text), some rows for one term of a group."""

    def rows(held: list, ids: words.Ids, groups: dict) -> pa.RecordBatch:
        names, kinds = pa.array(list(ids), pa.binary()).cast(pa.string()), list(groups)
        own = np.repeat(np.array([g for g, _ in held]), [len(c) for _, c in held])
        code = np.concatenate([c for _, c in held])
        group = own * len(ids) + (code & (1 << 32) - 1)
        group, at = np.unique(group, return_inverse=True)
        docs_ = np.bincount(at, minlength=len(group))
        n = np.bincount(at, code >> 32, minlength=len(group)).astype(np.int64)
        own, term = group // len(ids), group % len(ids)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in kinds], pa.string()).take(pa.array(own)), pa.array([k[1] for k in kinds], pa.string()).take(pa.array(own)), names.take(pa.array(term)), pa.array(n), pa.array(docs_)], names=["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.trim()
        held, ids, groups, n = [], words.Ids(), {}, 0
        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text")):
                own = text.as_py().encode().translate(_NORMAL).split()
                if not own:
                    continue
                code, count = np.unique(np.fromiter(map(ids.__getitem__, own), np.int64, len(own)), return_counts=True)
                held.append((groups.setdefault((lang, source), len(groups)), code | count << 32))  # a text has fewer than 2**31 words
                n += len(code)
                if n >= TOGETHER or len(ids) >= DISTINCT:
                    yield rows(held, ids, groups)
                    held, ids, groups, n = [], words.Ids(), {}, 0
        if held:
            yield rows(held, ids, groups)

    return docs.mapInArrow(run, _COUNTS)


def _duck() -> duckdb.DuckDBPyConnection:
    """A database in this worker's memory, which writes nothing."""
    return duckdb.connect(config={"threads": 1, "temp_directory": "", "memory_limit": "500MB", "preserve_insertion_order": False})


def _kept(counts: DataFrame, least: int, partitions: int) -> DataFrame:
    """(lang, source, term, n) of the terms in ``least`` documents of their language or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.trim()
        with _duck() as db:
            db.execute("CREATE TABLE counts (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
            held, n = [], 0

            def summed() -> None:
                given = pa.Table.from_batches(held)  # noqa: F841  read by name below
                db.execute("INSERT INTO counts SELECT lang, source, term, sum(n)::BIGINT, sum(docs)::BIGINT FROM given GROUP BY ALL")

            for batch in batches:
                held.append(batch)
                n += batch.num_rows
                if n >= AT_ONCE:
                    summed()
                    held, n = [], 0
            if n:
                summed()
            held.clear()
            found = db.sql(f"""
                WITH often AS (SELECT lang, term FROM counts GROUP BY ALL HAVING sum(docs) >= {least})
                SELECT lang, source, term, sum(n)::BIGINT AS n FROM counts JOIN often USING (lang, term) GROUP BY ALL""")  # fmt: skip
            yield from found.to_arrow_reader(50_000)

    return counts.repartition(partitions, "lang", "term").mapInArrow(run, "lang string, source string, term string, n long")


#: Of one shard: ``terms`` (source, term, n), ``sources`` (source, t: the group's sum) and the language's sum and number of kept terms.  A share is ``p``, that of a term that isn't there ``p0``.
_SHARD = """
CREATE TABLE own AS SELECT source, t, CASE WHEN {v} > 0 THEN (1 + 1000000000::HUGEINT * {c} // (t + {c}::HUGEINT * {v}))::BIGINT END AS p0 FROM sources;
CREATE TABLE shares AS
SELECT source, term, p0, (1 + 1000000000::HUGEINT * (n + {c}) // (t + {c}::HUGEINT * {v}))::BIGINT AS p FROM terms JOIN own USING (source);
CREATE TABLE lone AS SELECT source, p0, p, count(*) AS k FROM shares GROUP BY ALL;
"""
_PAIRS = """
WITH alone AS (
  SELECT a.source AS a, b.source AS b, sum(k * (abs(a.p - b.p0) - abs(a.p0 - b.p0)))::BIGINT AS f
  FROM lone a JOIN own b ON a.source <> b.source GROUP BY ALL),
common AS (
  SELECT a.source AS a, b.source AS b, sum(abs(a.p - b.p) - abs(a.p - b.p0) - abs(a.p0 - b.p) + abs(a.p0 - b.p0))::BIGINT AS f
  FROM shares a JOIN shares b ON a.term = b.term AND a.source < b.source GROUP BY ALL)
SELECT x.source AS a, y.source AS b,
       ((SELECT count(DISTINCT term) FROM shares) * coalesce(abs(x.p0 - y.p0), 0) + coalesce(l.f, 0) + coalesce(r.f, 0) + coalesce(t.f, 0))::BIGINT AS value
FROM own x JOIN own y ON x.source < y.source
LEFT JOIN alone l ON l.a = x.source AND l.b = y.source LEFT JOIN alone r ON r.a = y.source AND r.b = x.source
LEFT JOIN common t ON t.a = x.source AND t.b = y.source
"""
_FIRST = """
WITH whole AS (SELECT term, (1 + 1000000000::HUGEINT * (sum(n) + {c}) // ({t} + {c}::HUGEINT * {v}))::BIGINT AS q FROM terms GROUP BY term)
SELECT source AS a, term AS b, p - q AS value FROM shares JOIN whole USING (term) WHERE p > q
QUALIFY row_number() OVER (PARTITION BY source ORDER BY p - q DESC, term) <= {top}
"""


def _audited(kept: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """(lang, part, a, b, value): partial sums of pairs a < b, and each shard's first terms b of the groups a.

    ``kept`` has (lang, slot, source, term, n), ``groups`` (lang, slot, source, t, whole, v) for every slot.
    """
    schema = pa.schema([("lang", pa.string()), ("part", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64())])

    def run(terms: pa.Table, groups: pa.Table) -> pa.Table:
        whole, v, lang = (groups.column(c)[0].as_py() for c in ("whole", "v", "lang"))
        out = []
        with _duck() as db:
            db.register("terms", terms)
            db.register("sources", groups)
            db.execute(_SHARD.format(c=SMOOTH, v=v))
            for part, sql in (("pair", _PAIRS), ("term", _FIRST.format(c=SMOOTH, v=v, t=whole, top=top))):
                found = db.sql(sql).to_arrow_table()
                n = found.num_rows
                out.append(pa.table([pa.array([lang] * n, pa.string()), pa.array([part] * n, pa.string()), *(found.column(c).cast(k) for c, k in (("a", pa.string()), ("b", pa.string()), ("value", pa.int64())))], schema=schema))
        return pa.concat_tables(out)

    return kept.groupBy("lang", "slot").cogroup(groups.groupBy("lang", "slot")).applyInArrow(run, "lang string, part string, a string, b string, value long")


def audit(docs: DataFrame, *, least: int = 30, top: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source's terms lie from those of the language's other sources, and which terms it has most above the language."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    counts = common.written(_counted(rows), "counts")
    n = counts.count()
    kept = common.written(_kept(counts, least, max(1, -(-n // PARTITION), min(n // 1000, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))), "kept")
    common.drop(counts)
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("t"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("whole"), F.count_distinct("term").alias("v"), F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("slots"))
    groups = rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = common.written(groups.select("lang", "source", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("t", "whole", "v")), F.coalesce("slots", F.lit(1)).alias("slots")), "groups")
    slots = groups.select("lang", "slots").distinct()
    dealt = kept.join(slots, "lang").withColumn("slot", F.pmod(F.xxhash64("term"), F.col("slots")).cast("int")).select("lang", "slot", "source", "term", "n")
    sent = groups.withColumn("slot", F.explode(F.expr("sequence(0, slots - 1)"))).drop("slots")
    found = common.written(_audited(dealt, sent, top), "audited")
    pairs = found.filter("part = 'pair'").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value").union(pairs.select("lang", "b", F.lit("pair"), "a", "value"))
    both = pairs.unionByName(found.filter("part = 'term'").select("lang", F.col("a").alias("source"), "part", F.col("b").alias("item"), "value"))
    ranked = both.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item"))))
    return ranked.filter(f"part = 'pair' OR rank <= {top}")
