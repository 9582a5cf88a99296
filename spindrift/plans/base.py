"""The registry itself: queries by name, and the same in SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import text as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: The same over small inputs of our own: for tests, not registered.
EXAMPLES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
EXAMPLE_SQL: dict[str, str] = {}
K = 5


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def example(sql: str):
    """An operator over a fixed input, with its result worked out by hand."""

    def add(f):
        EXAMPLES[f.__name__], EXAMPLE_SQL[f.__name__] = f, sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- pieces of SQL
def folded(x: str) -> str:
    return f"strip_accents(lower(coalesce({x}, '')))"


def slugged(x: str) -> str:
    return f"coalesce(nullif(regexp_replace(regexp_replace({folded(x)}, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unknown')"


def listed(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def token_list(x: str, stop=T.STOP_SEARCH) -> str:
    return f"list_sort(list_distinct(list_filter(regexp_extract_all({folded(x)}, '[a-z0-9]+'), lambda t: length(t) > 2 AND NOT list_contains({listed(stop)}, t))))"
