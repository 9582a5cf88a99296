"""Text encoders as plug-ins: what turns a text column into unit vectors.

An encoder is called with a column and the kind of text (query or passage); the
kind's prefix, which some models want, is its own business.  Encoders are kept
by name, so a name gives the same one everywhere in a process.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import canonical_model, prompt_prefix


class Encoder(Protocol):
    name: str
    dim: int

    def __call__(self, text: Column, kind: str = "passage") -> Column: ...


class HashEncoder:
    """The offline encoder, in built-in functions."""

    name = "hash"

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, text: Column, kind: str = "passage") -> Column:
        from ..operators.hybrid import encoded

        return encoded(text, self.dim)


#: Models of this Python worker, by name; None for one that could not be loaded.
_loaded: dict[str, object] = {}


class ModelEncoder:
    """A model behind ``load``, a function that gives something with ``encode(list of texts)``; loaded once a worker, on first use.

    Vectors are brought to unit length.  A model that can't be loaded gives null
    vectors, which searches refuse by the row's id.
    """

    def __init__(self, name: str, dim: int, load: Callable[[], object]):
        self.name, self.dim, self.load = canonical_model(name), dim, load

    def __call__(self, text: Column, kind: str = "passage") -> Column:
        name, load, prefix = self.name, self.load, prompt_prefix(self.name, kind)

        def encode(batches):
            import numpy as np
            import pyarrow as pa

            if name not in _loaded:
                try:
                    _loaded[name] = load()
                except Exception:  # remembered, and not tried again
                    _loaded[name] = None
            model = _loaded[name]
            for texts in batches:
                if model is None:
                    yield pa.nulls(len(texts), pa.list_(pa.float64()))
                    continue
                x = np.asarray(model.encode([prefix + (t or "") for t in texts.to_pylist()]), np.float64)
                x /= np.maximum(1e-12, np.linalg.norm(x, axis=1, keepdims=True))
                yield pa.array(x.tolist(), pa.list_(pa.float64()))

        import collections.abc

        import pyarrow as pa

        encode.__annotations__ = {"batches": collections.abc.Iterator[pa.Array], "return": collections.abc.Iterator[pa.Array]}
        return F.arrow_udf(encode, "array<double>")(text)


_known: dict[str, Encoder] = {"hash": HashEncoder()}


def register(encoder: Encoder) -> Encoder:
    _known[encoder.name] = encoder
    return encoder


def get(name: str = "hash") -> Encoder:
    """The encoder of a name; the same one each time."""
    for own in (name, canonical_model(name)):
        if own in _known:
            return _known[own]
    raise KeyError(f"unknown encoder {name}; there are {', '.join(sorted(_known))}")


def queries(rows: DataFrame, encoder: Encoder, text_col: str = "text") -> DataFrame:
    """Adds the ``embedding`` of queries; a blank query fails the job."""
    blank = F.coalesce(F.trim(text_col), F.lit("")) == ""
    text = F.when(blank, F.raise_error(F.lit("a query is blank")).cast("string")).otherwise(F.col(text_col))
    return rows.withColumn("embedding", encoder(text, "query"))


def encode_one(spark: SparkSession, text: str, encoder: Encoder) -> list[float]:
    if not text.strip():
        raise ValueError("a query is blank")
    return list(queries(spark.createDataFrame([(text,)], "text string"), encoder).first().embedding)
