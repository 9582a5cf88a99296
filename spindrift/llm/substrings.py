"""Substring dedup by suffix automata of reference shards (operator 11).

Every document is a reference for those with larger ids.  A word goes if a window
of ``window`` words that covers it also starts in a document with a smaller id.

1. Each window is named by its anchor, the least hash among its ``gram``-word
   sequences, so equal windows have equal anchors.  Anchors met in one document
   only are left out: no window of theirs repeats.
2. Stretches of windows with one repeated anchor are cut from the documents.
   Equal stretches are one row with the smallest id, so a group of copies costs
   what one copy does.
3. The stretches are dealt into shards by anchor.  A shard's stretches, in the
   order of their ids, make one generalised suffix automaton, whose states keep
   the first id that reached them.  Each stretch streams through it, its match
   held at ``window`` words: the state tells the first document of every window.
4. Documents get back the windows that begin in an earlier one; the maximal
   spans that these cover are removed.

An automaton holds about ``shard_words`` words.  An anchor with more than that
in distinct stretches (a passage that many texts continue each in their own way)
is taken apart: its windows become stretches of their own, those of one document
go, and the rest are dealt by their own hash.  The automata are sent by key to
the tasks that stream the shard, not by the driver to all: the reference grows
with the corpus, and a stretch can only match in its anchor's shard.

Names of stretches are 128-bit hashes; anchors only deal, so their collisions do
no harm; automata compare words.

Defined results: null, empty or blank text has no words; a row with a null id is
no one's reference and loses nothing; rows with equal ids aren't references of
each other; an empty table gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, components, decontaminate, words

#: Words of one automaton (about 150 bytes each), and windows of one stretch at most.
SHARD_WORDS, STRETCH = 200_000, 1024

_CUTS = "doc_id long, k long, start long, n_words long, h1 long, h2 long, anchor long, content string"
_RANGES = "h1 long, h2 long, n long, ranges array<struct<a:int,b:int,first:long>>"


def _runs(hashes: np.ndarray, sizes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: their text's number, first word in it, number of windows, and anchor."""
    if len(hashes) < window:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    anchors = words.lows(words.grams(hashes, gram), window - gram + 1)
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(sizes)), sizes)[: len(anchors)]
    at = np.flatnonzero(np.arange(len(anchors)) <= ends[text] - window)
    own, anchors = text[at], anchors[at]
    first = np.ones(len(at), bool)
    first[1:] = (own[1:] != own[:-1]) | (anchors[1:] != anchors[:-1])
    heads = np.flatnonzero(first)
    first |= (np.arange(len(at)) - np.repeat(heads, np.diff([*heads, len(at)]))) % STRETCH == 0
    heads = np.flatnonzero(first)
    return own[heads], (at - (ends - sizes)[own])[heads], np.diff([*heads, len(at)]), anchors[heads].view(np.int64)


def _anchored(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc_id, k, anchor) of all windows of ``rows`` (doc_id, k, _text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, hashes, sizes, batch in words.hashed(batches, "_text"):
            text, _, _, anchor = _runs(hashes, sizes, window, gram)
            pick = pa.array(text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pick), batch.column("k").take(pick), pa.array(anchor)], names=["doc_id", "k", "anchor"])

    return rows.mapInArrow(run, "doc_id long, k long, anchor long")


def _name(content: bytes) -> tuple[int, int]:
    """The two signed halves of a stretch's hash."""
    d = xxhash.xxh3_128_digest(content)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _cut(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """The stretches of ``rows`` (doc_id, k, _text, anchors) whose anchor is among the row's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, hashes, sizes, batch in words.hashed(batches, "_text"):
            text, start, count, anchor = _runs(hashes, sizes, window, gram)
            lists = batch.column("anchors")
            ends, values = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy()
            keep = np.zeros(len(text), bool)
            turns = np.searchsorted(text, np.arange(len(sizes) + 1))
            for i in range(len(sizes)):
                keep[turns[i] : turns[i + 1]] = np.isin(anchor[turns[i] : turns[i + 1]], values[ends[i] : ends[i + 1]])
            at = np.flatnonzero(keep)
            content = [b" ".join(texts[t][s : s + c + window - 1]) for t, s, c in zip(text[at].tolist(), start[at].tolist(), count[at].tolist())]
            names = [_name(x) for x in content]
            pick = pa.array(text[at])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pick), batch.column("k").take(pick), pa.array(start[at]), pa.array(count[at] + window - 1), pa.array([a for a, _ in names], pa.int64()), pa.array([b for _, b in names], pa.int64()), pa.array(anchor[at]), pa.array(content, pa.binary()).cast(pa.string())],
                names=["doc_id", "k", "start", "n_words", "h1", "h2", "anchor", "content"],
            )

    return rows.mapInArrow(run, _CUTS)


class Shard(decontaminate.Automaton):
    """A generalised suffix automaton that grows by sequences of ascending ids; a state knows the id that first reached it."""

    def __init__(self, window: int):
        self.window, self.vocabulary, self.more, self.now = window, {}, {}, 0
        self.word, self.to, self.length, self.link = (array("i") for _ in range(4))
        self.first = array("q")
        self._state(0, -1, -1, -1)

    def _state(self, length: int, word: int, to: int, link: int) -> int:
        self.first.append(self.now)
        return super()._state(length, word, to, link)

    def _split(self, p: int, q: int, c: int) -> int:
        clone = super()._split(p, q, c)
        self.first[clone] = self.first[q]
        return clone

    def firsts(self, content: list[bytes], own: int) -> list[dict]:
        """Adds the words under the id ``own`` and returns, for stretches of their windows, the first id that has these."""
        self.now, last = own, 0
        code = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in content]
        for c in code:
            last = self._extend(last, c)
        out: list[dict] = []
        v = length = 0
        word, to, more, link, longest, window = self.word, self.to, self.more, self.link, self.length, self.window
        for i, c in enumerate(code):
            v = to[v] if word[v] == c else more[v][c]
            length += 1
            if length < window:
                continue
            while longest[link[v]] >= window:
                v = link[v]
            length = window
            first, at = self.first[v], i + 1 - window
            if out and out[-1]["first"] == first:
                out[-1]["b"] = at + 1
            else:
                out.append({"a": at, "b": at + 1, "first": first})
        return out


def _streamed(contents: DataFrame, window: int, shards: int) -> DataFrame:
    """``_RANGES`` of ``contents`` (h1, h2, n, first, content, by): shards by ``by``, each with one automaton."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for batch in batches:
            found = []
            for shard, first, content in zip(*(batch.column(c).to_pylist() for c in ("shard", "first", "content"))):
                if shard != at:
                    at, own = shard, Shard(window)
                found.append(own.firsts(content.encode().split(b" "), first))
            kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("first", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("h1", "h2", "n")), pa.array(found, kind)], names=["h1", "h2", "n", "ranges"])

    dealt = contents.withColumn("shard", F.pmod(F.xxhash64("by"), F.lit(shards))).drop("by")
    return dealt.repartition("shard").sortWithinPartitions("shard", "first").mapInArrow(run, _RANGES)


def _windows(contents: DataFrame, window: int) -> DataFrame:
    """Every window of ``contents`` (h1, h2, first, last, content) as a stretch (w1, w2) of its own, with its place ``at`` in the content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for h1, h2, first, last, content in zip(*(batch.column(c).to_pylist() for c in ("h1", "h2", "first", "last", "content"))):
                own = content.encode().split(b" ")
                for i in range(len(own) - window + 1):
                    part = b" ".join(own[i : i + window])
                    rows.append((h1, h2, first, last, i, *_name(part), part.decode()))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.string() if j == 7 else pa.int64()) for j in range(8)], names=["h1", "h2", "first", "last", "at", "w1", "w2", "content"])

    return contents.select("h1", "h2", "first", "last", "content").mapInArrow(run, "h1 long, h2 long, first long, last long, at long, w1 long, w2 long, content string")


def _apart(heavy: DataFrame, window: int, shard_words: int) -> DataFrame:
    """``_RANGES`` of stretches whose anchors have more of them than an automaton holds."""
    cut = common.written(_windows(heavy, window), "windows")
    own = cut.groupBy("w1", "w2").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count(F.lit(1)).alias("n"), F.min("content").alias("content")).filter("first < last")
    own = common.written(own.select(F.col("w1").alias("h1"), F.col("w2").alias("h2"), "n", "first", "content", F.col("w1").alias("by")), "windows")
    shards = max(1, math.ceil(own.count() * window / shard_words))
    found = common.written(_streamed(own, window, shards).select(F.col("h1").alias("w1"), F.col("h2").alias("w2"), F.col("n").alias("ends"), F.col("ranges")[0]["first"].alias("first")), "ranges")
    back = components.with_facts(cut.select("h1", "h2", "at", "w1", "w2"), found, ["w1", "w2"], "ends", cut.count())
    one = F.struct(F.col("at").cast("int").alias("a"), (F.col("at") + 1).cast("int").alias("b"), "first")
    return back.groupBy("h1", "h2").agg(F.collect_list(one).alias("ranges")).join(heavy.select("h1", "h2", "n"), ["h1", "h2"]).select("h1", "h2", "n", "ranges")


def _kept(rows: DataFrame, window: int, with_text: bool) -> DataFrame:
    """The result's columns of ``rows`` (doc_id, _text, hits)."""
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>" + ", clean string" * with_text
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for text, hits in zip(batch.column("_text").to_pylist(), batch.column("hits")):
                own, spans, kept, at = text.encode().split(), [], [], 0
                for h in sorted(hits.as_py() or (), key=lambda h: h["start"]):
                    if spans and h["start"] <= spans[-1]["end"]:
                        spans[-1]["end"] = max(spans[-1]["end"], h["end"])
                    else:
                        spans.append(h)
                for s in spans:
                    kept += own[at : s["start"]]
                    at = s["end"]
                clean = b" ".join(kept + own[at:])
                for c, x in zip(out, (len(own), sum(s["end"] - s["start"] for s in spans), hashlib.sha256(clean).hexdigest(), spans, clean.decode() if with_text else None)):
                    c.append(x)
            cols = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), span, pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols[: 4 + with_text]], names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans", *["clean"] * with_text])

    return rows.mapInArrow(run, schema)


def dedup(docs: DataFrame, *, window: int = 50, gram: int = 16, shard_words: int = SHARD_WORDS, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans) of every row; ``spans`` count words, ends exclusive.

    ``kept_sha256`` is that of the kept words joined by one space; with ``with_text`` these follow as ``clean``.
    """
    gram = min(gram, window)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("k", F.xxhash64("_text"))
    found = common.written(_anchored(rows.filter("doc_id IS NOT NULL"), window, gram), "anchors")
    repeated = found.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("ends")).filter("lo < hi")
    repeated = common.written(repeated.select("anchor", "ends"), "repeated")
    own = components.with_facts(found, repeated, ["anchor"], "ends", found.count()).groupBy("doc_id", "k").agg(F.collect_set("anchor").alias("anchors"))
    cut = common.written(_cut(rows.join(own, ["doc_id", "k"]), window, gram), "stretches")
    common.drop(found, repeated)
    contents = cut.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"), F.min("n_words").alias("n_words"), F.min("anchor").alias("by"), F.min("content").alias("content"))
    contents = common.written(contents, "contents")
    by = common.written(contents.groupBy("by").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_words").alias("words")), "weights")
    n, total = contents.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    shards = max(1, math.ceil(total / shard_words))
    weighed = components.with_facts(contents, by, ["by"], "rows", n)
    found = _streamed(weighed.filter(F.col("words") <= shard_words).select("h1", "h2", "n", "first", "content", "by"), window, shards)
    if by.filter(F.col("words") > shard_words).count():
        found = found.unionByName(_apart(common.written(weighed.filter(F.col("words") > shard_words), "heavy"), window, shard_words))
    found = common.written(found, "ranges")
    common.drop(by, contents)
    hit = components.with_facts(cut.select("doc_id", "k", "start", "h1", "h2"), found, ["h1", "h2"], "n", cut.count())
    spans = F.expr(f"transform(filter(ranges, r -> r.first < doc_id), r -> struct(start + r.a AS start, start + r.b + {window - 1} AS end))")
    hits = hit.select("doc_id", "k", spans.alias("hits")).filter("size(hits) > 0").groupBy("doc_id", "k").agg(F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"))
    return _kept(rows.join(hits, ["doc_id", "k"], "left").select("doc_id", "_text", "hits"), window, with_text)
