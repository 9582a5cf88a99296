"""URL filters through a blocked Bloom filter (operator 9), in built-in functions only.

The listed canonical URLs are rules of a host and a path.  A url's candidate
keys are its host's suffixes at label boundaries, each with the path cut to the
lengths that rule paths have.  Keys are looked up in a blocked Bloom filter (a
64-bit word a block, ``BITS`` bits a key), and only possible hits go on to an
exact hash join with the list, which removes the false positives; the longest
rule that is left wins.  A url without one gets the method's verdict: block if
its whole canonical form (host and path) is in ``listed``, by the same filter
and join, else allow.

Equal urls are judged once.  The filter grows with the list, so false positives
stay rare; it is broadcast up to ``BROADCAST_BLOCKS`` blocks and joined by block
beyond.  The list is joined as Spark's own size checks decide.

Defined results: null urls and urls without ``://`` have an empty host and path,
fit no rule and are allowed; repeated rows get one verdict each; an empty table
gives no rows; columns beyond the two named are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bloom filter: blocks of 64 bits at least, keys a block, bits set for a key, and blocks that may be broadcast (24 bytes each).
BLOCKS, KEYS, BITS, BROADCAST_BLOCKS = 1 << 16, 4, 5, 1 << 20


def blocks_for(keys: int) -> int:
    """Blocks for so many keys: a power of two, with 16 bits or more a key."""
    return max(BLOCKS, 1 << max(0, (keys // KEYS)).bit_length())


def _hash(c: str, blocks: int) -> dict:
    h = F.xxhash64(F.col(c))
    mask = F.lit(0).cast("long")
    for k in range(BITS):
        mask = mask.bitwiseOR(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64({c}), {6 * k}) & 63 AS int))"))
    return {"block": F.pmod(F.shiftrightunsigned(h, 6 * BITS), F.lit(blocks)), "mask": mask}


def filter_of(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, bits): the filter of ``keys`` (key string); never more rows than ``blocks``."""
    return keys.withColumns(_hash("key", blocks)).groupBy("block").agg(F.bit_or("mask").alias("bits"))


def parts(url: str = "url") -> dict:
    """Host and path of a url."""
    rest = f"CASE WHEN instr({url}, '://') > 0 THEN substring({url}, instr({url}, '://') + 3) ELSE '' END"
    rest = f"coalesce({rest}, '')"
    return {
        "host": F.translate(F.expr(f"regexp_extract({rest}, '^[^/?#]*', 0)"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
        "path": F.expr(f"regexp_extract(substring({rest}, length(regexp_extract({rest}, '^[^/?#]*', 0)) + 1), '^[^?#]*', 0)"),
    }


def judge(pages: DataFrame, rules: list[tuple[str, str]], listed: DataFrame | None = None, *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row.

    ``rules``: (verdict, host + path) with a path from the first slash on;
    ``listed``: further canonical URLs to block, a column ``url`` of host + path.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).withColumns(parts())
    table = spark.createDataFrame([(r, r, v) for v, r in rules], "key string, rule string, says string")
    lengths = sorted({len(r) - r.index("/") for _, r in rules})
    keys = [f"transform(filter(hosts, h -> length(path) >= {k}), h -> concat(h, left(path, {k})))" for k in lengths]
    suffixes = "transform(sequence(0, size(split(host, '[.]')) - 1), i -> array_join(slice(split(host, '[.]'), i + 1, size(split(host, '[.]'))), '.'))"
    distinct = rows.select("url", "host", "path").filter("host <> ''").distinct().withColumn("hosts", F.expr(suffixes))
    wanted = distinct.select("url", F.explode(F.expr(f"array_distinct(concat({', '.join(keys)}, array(concat(host, path))))")).alias("key"))
    if listed is not None:
        own = listed.select(F.col("url").alias("key")).filter("key is not null").distinct()
        table = table.union(own.join(table.select("key"), "key", "left_anti").select("key", F.lit(None).cast("string").alias("rule"), F.lit("block").alias("says")))
    blocks = blocks_for(len(rules) + (listed.count() if listed is not None else 0))
    bloom = filter_of(table.select("key"), blocks)
    possible = wanted.withColumns(_hash("key", blocks)).join(F.broadcast(bloom) if blocks <= BROADCAST_BLOCKS else bloom, "block").filter("bits & mask = mask").select("url", "key")
    exact = possible.join(table, "key")
    best = exact.groupBy("url").agg(F.max(F.struct(F.col("rule").isNotNull().alias("is_rule"), F.length("key").alias("n"), "key", "rule", "says")).alias("best"))
    return rows.join(best, "url", "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.says", F.lit("allow")).alias("verdict"))
