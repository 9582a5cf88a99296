"""Exact order statistics of keys of any size, by narrowing brackets.

Each round splits a key's bracket at values of a mergeable quantile sketch,
counts the rows of every cell between them, and keeps the cell that holds the
wanted place.  A split's own value is a cell by itself, so a value that fills
most of a key ends the search, and every round leaves a small share of the
rows.  What meets in one task is a sketch or a few dozen counts a key, never
the values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..sources import scratch

#: Splits of a round, and keys up to which a round's brackets are broadcast.
SPLITS, KEYS = 32, 100_000


def _with(rows: DataFrame, brackets: DataFrame) -> DataFrame:
    """``rows`` (k, v) within the ``brackets`` (k, place, lo, hi and others) of their key."""
    b = brackets.withColumnRenamed("k", "bk")
    b = F.broadcast(b) if b.count() <= KEYS else b
    return rows.join(b, F.col("k").eqNullSafe(F.col("bk")) & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))).drop("bk")


def selected(rows: DataFrame, value: str, places: dict[str, Callable[[Column], Column]], key: str | None = None) -> DataFrame:
    """(k, n, place, value): for each key (null is one) and named place, which maps the key's number of values to a position from 0, the value there in ascending order.

    Null values don't count; keys without values have no rows.
    """
    base = rows.filter(F.col(value).isNotNull()).select((F.col(key) if key else F.lit(0)).alias("k"), F.col(value).alias("v"))
    totals = base.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    asked = F.array(*[F.struct(F.lit(name).alias("place"), f(F.col("n")).cast("long").alias("at")) for name, f in places.items()])
    now = scratch.written(totals.select("k", "n", "lo", "hi", F.inline(asked)), "brackets")
    done, kind = [], base.schema["v"].dataType
    while True:
        done.append(now.filter("lo = hi").select("k", "n", "place", F.col("lo").alias("value")))
        left = now.filter("lo <> hi")
        if not left.limit(1).count():
            break
        grid = F.array(*[F.lit(i / SPLITS) for i in range(SPLITS + 1)])
        splits = _with(base, left).groupBy("k", "n", "place", "at", "lo", "hi").agg(F.percentile_approx("v", grid, 1000).alias("s"))
        # the sketch counts in doubles, so long integers come back near their values only; the ends and the middle narrow every bracket
        sure = F.array("lo", F.expr("lo DIV 2 + hi DIV 2 + (lo % 2 + hi % 2) DIV 2").cast(kind), "hi") if isinstance(kind, IntegralType) else F.array("lo", "hi")
        splits = splits.withColumn("s", F.array_distinct(F.concat("s", sure)))
        own = _with(base, scratch.written(splits, "splits"))
        cell = 2 * F.size(F.filter("s", lambda x: x < F.col("v"))) + F.array_contains("s", F.col("v")).cast("int")
        cells = own.groupBy("k", "n", "place", "at", cell.alias("cell")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        lists = cells.groupBy("k", "n", "place", "at").agg(F.array_sort(F.collect_list(F.struct("cell", "c", "lo", "hi"))).alias("cells"))  # a few dozen
        # the cell that the place lies in: the first at which the rows so far are more than the place
        upto = F.transform("cells", lambda _, i: F.aggregate(F.slice("cells", 1, i + 1), F.lit(0).cast("long"), lambda a, x: a + x["c"]))
        found = lists.withColumn("upto", upto).withColumn("i", F.size(F.filter("upto", lambda x: x <= F.col("at"))))
        before = F.when(F.col("i") > 0, F.get("upto", F.col("i") - 1)).otherwise(F.lit(0))
        hit = F.get("cells", F.col("i"))
        now = scratch.written(found.select("k", "n", hit["lo"].alias("lo"), hit["hi"].alias("hi"), "place", (F.col("at") - before).alias("at")), "brackets")
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def median(rows: DataFrame, value: str, key: str | None = None) -> DataFrame:
    """(k, median): the middle value, or the mean of the two."""
    two = selected(rows, value, {"low": lambda n: F.floor((n - 1) / 2), "high": lambda n: F.ceil((n - 1) / 2)}, key)
    return two.groupBy("k").agg(F.avg("value").alias("median"))
