"""Vector expressions: quantised codes, sign bits and their sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scale(vector: Column) -> Column:
    """The largest magnitude over 127; 1/127 for a zero vector."""
    top = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    return F.when(top > 0, top / 127.0).otherwise(F.lit(1.0 / 127.0))


def codes(vector: Column, by: Column) -> Column:
    """Rounded half to even, within 127 either way."""
    return F.transform(vector, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.rint(x.cast("double") / by).cast("int"))))


def dequantised(code: Column, by: Column) -> Column:
    return F.transform(code, lambda c: c * by)


def sign_words(vector: Column, dim: int) -> Column:
    """Bits of positive entries as 64-bit words."""
    word = lambda k: F.aggregate(
        F.transform(F.slice(vector, 64 * k + 1, 64), lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L"))), F.struct(F.lit(0).cast("long").alias("w"), F.lit(0).alias("i")),
        lambda a, b: F.struct(a["w"].bitwiseOR(F.call_function("shiftleft", b, a["i"])).alias("w"), (a["i"] + 1).alias("i")), lambda a: a["w"],
    )
    return F.array(*[word(k) for k in range(-(-dim // 64))])
