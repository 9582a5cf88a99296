"""SimHash near-duplicates, joined through a sharded vantage-point tree (operator 1).

Fingerprints come from one Arrow pass over whole texts.  Equal fingerprints are
one point from then on, so copies cost nothing further.  The upper levels of a
vantage-point tree, fitted on a bounded sample of points, deal the points out
into shards; a point also visits every shard that its search ball reaches over
a boundary.  Inside a shard the tree goes on, prunes by the triangle bounds and
compares what is left.  A shard reports only a spanning star of each group, and
the stars are joined by connected components, so no pairs of a group are made.

Defined results: null or wordless text has fingerprint zero, linked like any
other; repeated rows share a component; null ids count only where no other id
is reachable; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components, members, with_facts
from .vptree import Shards, halves, link

#: Points that the upper tree is fitted on at most, and points that a shard is meant to hold.
SAMPLE, SHARD_POINTS = 16_384, 16_384
#: Bytes of texts whose shingles are hashed together, and shingles of a size that are hashed one by one.
TEXTS, FEW = 1_000_000, 16
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _votes(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    octets = h.astype("<u8").view(np.uint8).reshape(-1, 8)
    if len(h) < 256:
        return np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """64-bit hashes of a text's word shingles, repeats included; none of a wordless text."""
    from xxhash import xxh64_intdigest

    own = (text or "").encode().translate(common.ASCII_LOWER).split()
    if not own:
        return np.zeros(0, np.uint64)
    joined = b" ".join(own)
    if len(own) <= words:
        return np.array([xxh64_intdigest(joined, 42)], np.uint64)
    starts = np.zeros(len(own), np.int64)
    np.cumsum(np.fromiter(map(len, own[:-1]), np.int64, len(own) - 1) + 1, out=starts[1:])
    ends = np.append(starts[words:] - 1, len(joined)).tolist()
    return np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends)), np.uint64, len(ends))


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def _xxh64(octets: bytes, starts: np.ndarray, size: int, seed: int) -> np.ndarray:
    """XXH64 of the pieces of ``size`` bytes at ``starts``, side by side; eight bytes more follow the last piece."""
    eights = np.ndarray((len(octets) - 7,), "<u8", octets, strides=(1,))
    mixed = lambda lane: _rotated(lane * _P2, 31) * _P1
    at = 0
    if size >= 32:
        v = [np.full(len(starts), x % (1 << 64), np.uint64) for x in (seed + int(_P1) + int(_P2), seed + int(_P2), seed, seed - int(_P1))]
        while size - at >= 32:
            v = [_rotated(x + eights[starts + (at + 8 * k)] * _P2, 31) * _P1 for k, x in enumerate(v)]
            at += 32
        h = sum((_rotated(x, by) for x, by in zip(v, (1, 7, 12, 18))), np.zeros(len(starts), np.uint64))
        for x in v:
            h = (h ^ mixed(x)) * _P1 + _P4
    else:
        h = np.full(len(starts), (seed + int(_P5)) % (1 << 64), np.uint64)
    h += np.uint64(size)
    while size - at >= 8:
        h = _rotated(h ^ mixed(eights[starts + at]), 27) * _P1 + _P4
        at += 8
    if size - at >= 4:
        h = _rotated(h ^ (eights[starts + at] & np.uint64(0xFFFFFFFF)) * _P1, 23) * _P2 + _P3
        at += 4
    while at < size:
        h = _rotated(h ^ (eights[starts + at] & np.uint64(0xFF)) * _P5, 11) * _P1
        at += 1
    h = (h ^ h >> np.uint64(33)) * _P2
    h = (h ^ h >> np.uint64(29)) * _P3
    return h ^ h >> np.uint64(32)


def all_shingle_hashes(texts: Iterable[str | None], words: int) -> Iterator[np.ndarray]:
    """``shingle_hashes`` of every text; those of ``TEXTS`` bytes of text are hashed together."""
    held, size = [], 0
    for text in texts:
        held.append(b" ".join((text or "").encode().translate(common.ASCII_LOWER).split()))
        size += len(held[-1])
        if size >= TEXTS:
            yield from _together(held, words)
            held, size = [], 0
    yield from _together(held, words)


def _together(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    """The shingle hashes of each of ``texts``, words joined by one space."""
    from xxhash import xxh64_intdigest

    filled = [t for t in texts if t]
    octets = b"\n".join(filled) + b"\n" + bytes(8)
    codes = np.frombuffer(octets, np.uint8)[:-8]
    ends = np.flatnonzero((codes == 32) | (codes == 10)) if filled else np.zeros(0, np.int64)
    starts = np.append(0, ends[:-1] + 1) if filled else ends
    last = np.flatnonzero(codes[ends] == 10)
    n_words = np.diff(last, prepend=-1)
    counts = np.maximum(1, n_words - words + 1)
    begin = np.repeat(last - n_words + 1 - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    begin, end = starts[begin], ends[np.minimum(begin + words - 1, np.repeat(last, counts))]
    size = end - begin
    order = np.argsort(size, kind="stable")
    cut = np.concatenate([[0], np.flatnonzero(np.diff(size[order])) + 1, [len(order)]]) if filled else [0]
    h = np.zeros(len(order), np.uint64)
    for a, b in zip(cut[:-1], cut[1:]):
        own = order[a:b]
        if len(own) < FEW:
            h[own] = [xxh64_intdigest(octets[x:y], 42) for x, y in zip(begin[own].tolist(), end[own].tolist())]
        else:
            h[own] = _xxh64(octets, begin[own], int(size[own[0]]), 42)
    parts = iter(np.split(h, np.cumsum(counts)[:-1]) if filled else ())
    for t in texts:
        yield next(parts) if t else np.zeros(0, np.uint64)


def majority(h: np.ndarray) -> int:
    """The 64-bit SimHash of hashes: bits that are set in over half of them."""
    bits = (2 * _votes(h) > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included."""
    return majority(shingle_hashes(text, words))


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))


def fingerprints(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, fp): ``key`` stands for the id and text of a row, the fingerprint is a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([majority(h) for h in all_shingle_hashes((t.as_py() for t in batch.column("_text")), words)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(fp.view(np.int64))], names=["doc_id", "key", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("_text")).mapInArrow(run, "doc_id long, key long, fp long")


def links(points: DataFrame, bits: int) -> DataFrame:
    """Edges (a, b) that join all of ``points`` (fp long, distinct) within ``bits`` differing bits; n - 1 at most a shard and group."""
    spark = points.sparkSession
    n = points.count()
    depth = max(0, math.ceil(math.log2(max(n, 1) / SHARD_POINTS)))
    # a bounded sample for the tree: the smallest hashes
    sample = np.array([r.fp for r in points.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64) if depth else np.zeros(0, np.uint64)
    trees = [Shards(np.unique(halves(sample, h)), depth) for h in (0, 1)]
    shared = spark.sparkContext.broadcast(trees)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            for half, tree in enumerate(trees):
                for leaf, home, over in tree.route(halves(fp.view(np.uint64), half), bits // 2):
                    for own, at_home in ((home, True), (over, False)):
                        if len(own):
                            k = len(own)
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, 2 * leaf + half, np.int64)), pa.array(fp[own]), pa.array(np.full(k, at_home))], names=["shard", "fp", "home"])

    def join(group: pa.Table) -> pa.Table:
        home = group.column("home").to_numpy()
        fp = group.column("fp").to_numpy()
        fp = np.concatenate([np.sort(fp[home]), np.sort(fp[~home])]).view(np.uint64)
        root = link(fp, int(home.sum()), int(group.column("shard")[0].as_py()) & 1, bits)
        away = np.flatnonzero(root != np.arange(len(fp)))
        own = fp.view(np.int64)
        return pa.table({"a": own[away], "b": own[root[away]]})

    dealt = points.select("fp").mapInArrow(deal, "shard long, fp long, home boolean")
    return dealt.groupBy("shard").applyInArrow(join, "a long, b long")


def _grouped(docs: DataFrame, words: int, bits: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, fp, root, component_id) of every row; ``root`` is the smallest fingerprint reachable."""
    prints = common.written(fingerprints(docs, words, id_col, text_col), "prints")
    points = common.written(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "points")
    groups = members(components(links(points, bits)))
    of = points.join(groups, points.fp == groups.node).select("fp", "first", "n", "root", "size")
    least = of.groupBy("root").agg(F.min("first").alias("component_id"), F.first("size").alias("size"))
    linked = with_facts(of.select("fp", "n", "root"), least, ["root"], "size", points.count()).select("fp", "n", "root", "component_id")
    alone = points.join(groups, points.fp == groups.node, "left_anti").select("fp", "n", F.col("fp").alias("root"), F.col("first").alias("component_id"))
    found = common.written(linked.union(alone), "found")
    return with_facts(prints, found, ["fp"], "n", prints.count()).drop("n")


def near_duplicates(docs: DataFrame, *, words: int = 5, bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id, key) for every row of ``docs``."""
    return _grouped(docs, words, bits, id_col, text_col).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "key")


def first_of_each(docs: DataFrame, *, words: int = 5, bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that come first, by id and then by a hash of the text, in their component; of repeated rows one.

    A row with an id goes before rows without; a component of rows without ids keeps one of them.
    """
    return first_rows(docs, _grouped(docs, words, bits, id_col, text_col), id_col, text_col)


def order() -> Column:
    """What the first row of a group comes first by; of (doc_id, key)."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")


def first_rows(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first row of ``docs`` of each root of ``found`` (doc_id, key, root)."""
    first = found.groupBy("root").agg(F.min(order()).alias("first")).select(F.col("first.doc_id").alias("_id"), F.col("first.key").alias("key"))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), row_key(id_col, text_col).alias("key"), F.struct("*").alias("row"))
    same = (rows["key"] == first["key"]) & rows["_id"].eqNullSafe(first["_id"])
    return rows.join(first, same, "left_semi").dropDuplicates(["_id", "key"]).select(*[F.col("row")[c].alias(c) for c in docs.columns])
