"""Connected components of an edge table, by alternating large-star and small-star rounds.

Before a round, edges that lie together become stars of the components that they
form among themselves, which needs no shuffle and saves rounds.  A node's least
neighbour never grows by either step, and stays for all nodes only where every
component is a star, so the rounds end.  Each round is written to the shared folder, so lineage stays short and a lost
executor costs one round at most.  Stars are joined from pre-aggregated minima.
Hubs, nodes with so many ends that no more than ``HUBS`` nodes can be one, are
broadcast instead, so a hub's edges stay where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Hubs at most (16 bytes each), and ends that every hub has at least.
HUBS, LEAST_ENDS = 100_000, 512
#: Rows that have few enough keys to broadcast them all.
FEW = 1 << 18
MAX_ROUNDS = 60
#: Edges that are contracted together (16 bytes each, and some 150 while at work): up to so many settle in one round, and a
#: further round of all edges costs more than the one task that contracts them.
TOGETHER = 1 << 21


def with_facts(rows: DataFrame, facts: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """``rows`` joined with ``facts``, which has one row a key ``on`` and as ``size`` the key's number of rows; ``total`` is that of all rows.

    Keys of so many rows that no more than ``HUBS`` can have as many are broadcast, so their rows stay where they lie;
    of ``FEW`` rows all keys are.
    """
    if total <= FEW:
        return rows.join(F.broadcast(facts), on)
    hot = F.col(size) > max(LEAST_ENDS, total // HUBS)
    hubs = F.broadcast(facts.filter(hot))
    return rows.join(hubs, on).unionByName(rows.join(hubs, on, "left_anti").join(facts.filter(~hot), on))


def _with_least(rows: DataFrame, least: DataFrame, ends: int) -> DataFrame:
    """``rows`` (a, b) with the ``m`` of ``least`` (u, m, ends) for a; ``ends`` is the sum of all ends."""
    return with_facts(rows, least.withColumnRenamed("u", "a"), ["a"], "ends", ends).select("a", "b", "m")


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("ends")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"), "ends")
    grown = _with_least(both.filter("b > a"), least, 2 * n)
    return grown.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """``edges`` have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("ends")).select(F.col("a").alias("u"), "m", "ends")
    moved = _with_least(edges, least, n).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def members(found: DataFrame) -> DataFrame:
    """(node, root, size) from ``found`` by ``components``: all nodes of groups of two or more, the roots too, and the group's number of nodes."""
    sizes = found.groupBy("root").agg((F.count(F.lit(1)) + 1).alias("size"))
    return with_facts(found, sizes, ["root"], "size", found.count()).select("node", "root", "size").union(sizes.select(F.col("root").alias("node"), "root", "size"))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges (a, b) but the smallest of its component, and that smallest one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    up = np.arange(len(nodes))
    while True:
        x, y = up[x], up[y]
        away = x != y
        if not away.any():
            break
        x, y = x[away], y[away]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (up[up] != up).any():
            up = up[up]
    low = np.flatnonzero(up != np.arange(len(nodes)))
    return nodes[low], nodes[up[low]]


def _blocks(edges: DataFrame, n: int) -> DataFrame:
    """The ``n`` edges in as few partitions as have about ``TOGETHER`` each, so that more of them are contracted together."""
    return edges.coalesce(max(1, -(-n // TOGETHER)))


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b), a > b, of the same components: stars of what ``TOGETHER`` edges of a partition join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            a, b = forest(*(np.concatenate([x.column(n).to_numpy() for x in held]) for n in ("a", "b")))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= TOGETHER:
                yield stars(held)
                held, n = [], 0
        if n:
            yield stars(held)

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def _state(edges: DataFrame) -> tuple:
    """The number of edges, and what tells their set from others."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long) but the roots themselves; the root is the smallest node reachable.

    Loops and repeated edges do no harm; no edges give no rows.
    """
    first = common.written(_contracted(edges), "edges")
    now = common.written(_contracted(_blocks(first, first.count())), "edges")
    common.drop(first)
    for _ in range(MAX_ROUNDS):
        state = _state(now)
        grown = common.written(_large_star(now, state[0]), "edges")  # read more than once: it would be made each time
        after = common.written(_small_star(grown, state[0]), "edges")
        common.drop(now, grown)
        if not state[0] or (reached := _state(after)) == state:
            return after.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now = common.written(_contracted(_blocks(after, reached[0])), "edges")
        common.drop(after)
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
