"""Benchmark decontamination by a generalised suffix automaton (operator 7).

The test items, normalised to words, make one automaton.  Document words stream
through it; at each word the state and the longest match's length tell whether
a window of ``window`` item words has just ended, and which items hold it.
Words foreign to every item reset the match, so only runs of item words are
walked.  An item of fewer words is one window.

The automaton is broadcast.  Its size is counted first: items beyond
``max_words`` words are dealt into several automata, each run over all
documents in a pass of its own, so the result does not depend on the bound.

Defined results: null or wordless text has no words and no hits; items without
words never occur; a null item id is named ``null``; repeated items count once under each id; an empty benchmark
marks nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Item words of one automaton: about 100 bytes a word in each Python worker.
MAX_WORDS = 300_000
#: Lower-cases A-Z and blanks what is no word: a word is ASCII digits, letters and anything beyond ASCII.
_NORMAL = bytes(common.ASCII_LOWER[c] if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")


def normal(text: str | None) -> bytes:
    """The text's bytes with words kept in their places."""
    return (text or "").encode().translate(_NORMAL)


class Automaton:
    """All factors of the items' word sequences, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        # most states lead on by one word only: that word and state; the other ways are in ``more``
        self.word, self.to, self.link, self.length = array("i", [-1]), array("i", [-1]), array("i", [-1]), array("i", [0])
        self.more: dict[int, dict[int, int]] = {}
        coded = []
        for name, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            coded.append((name, ids))
            last = 0
            for c in ids:
                last = self._extend(last, c)
        states = np.argsort(np.array(self.length), kind="stable").tolist()
        #: the state of a state's suffix of ``window`` words
        self.gram = array("i", range(len(states)))
        for v in states[1:]:
            if self.length[self.link[v]] >= window:
                self.gram[v] = self.gram[self.link[v]]
        self.items: dict[int, set[str]] = {}
        self.short: dict[int, tuple[int, set[str]]] = {}
        self.least = window
        for name, ids in coded:
            v = 0
            for i, c in enumerate(ids):
                v = self._next(v, c)
                if i + 1 >= window:
                    self.items.setdefault(self.gram[v], set()).add(name)
            if 0 < len(ids) < window:
                self.short.setdefault(v, (len(ids), set()))[1].add(name)
                self.least = min(self.least, len(ids))
        #: the nearest state upwards, itself included, that ends a short item
        self.ends = array("i", [-1]) * len(states)
        for v in states:
            self.ends[v] = v if v in self.short else self.ends[self.link[v]] if v else -1

    def _next(self, v: int, c: int) -> int:
        """The state that ``c`` leads to from ``v``; -1 if none."""
        return self.to[v] if self.word[v] == c else self.more[v].get(c, -1) if v in self.more else -1

    def _lead(self, v: int, c: int, to: int) -> None:
        if self.word[v] in (-1, c):
            self.word[v], self.to[v] = c, to
        else:
            self.more.setdefault(v, {})[c] = to

    def _state(self, length: int, word: int, to: int, link: int) -> int:
        for column, value in ((self.word, word), (self.to, to), (self.length, length), (self.link, link)):
            column.append(value)
        return len(self.link) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        clone = self._state(self.length[p] + 1, self.word[q], self.to[q], self.link[q])
        if q in self.more:
            self.more[clone] = dict(self.more[q])
        self.link[q] = clone
        while p >= 0 and self._next(p, c) == q:
            self._lead(p, c, clone)
            p = self.link[p]
        return clone

    def _extend(self, p: int, c: int) -> int:
        q = self._next(p, c)
        if q >= 0:
            return q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        new = self._state(self.length[p] + 1, -1, -1, -1)
        while p >= 0 and self._next(p, c) < 0:
            self._lead(p, c, new)
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self._next(p, c)
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return new

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Hit stretches of words (ascending, apart, end exclusive), items found and the longest match."""
        get, word, to, link, more = self.vocabulary.get, self.word, self.to, self.link, self.more
        ids = np.array([get(w, -1) for w in words], np.int64)
        known = np.concatenate([[False], ids >= 0, [False]])
        turns = np.flatnonzero(known[1:] != known[:-1])
        hits: list[list[int]] = []
        found: set[str] = set()
        longest = 0
        for a, b in zip(turns[::2], turns[1::2]):
            if b - a < self.least:
                continue
            v = length = 0
            for i, c in enumerate(ids[a:b].tolist(), a):
                while True:
                    on = to[v] if word[v] == c else more[v].get(c, -1) if v in more else -1
                    if on >= 0 or not v:
                        break
                    v = link[v]
                    length = self.length[v]
                if on >= 0:
                    v = on
                    length += 1
                longest = max(longest, length)
                start = i + 1
                if length >= self.window:
                    found |= self.items[self.gram[v]]
                    start = i + 1 - self.window
                u = self.ends[v]
                while u > 0:
                    n, names = self.short[u]
                    if n <= length:
                        found |= names
                        start = min(start, i + 1 - n)
                    u = self.ends[self.link[u]]
                if start <= i:
                    while hits and hits[-1][1] >= start:
                        start = min(start, hits.pop()[0])
                    hits.append([start, i + 1])
        return [(int(a), int(b)) for a, b in hits], found, longest


_built: dict[str, Automaton] = {}

def _merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for x, y in sorted(a + b):
        if out and out[-1][1] >= x:
            out[-1][1] = max(out[-1][1], y)
        else:
            out.append([x, y])
    return [(x, y) for x, y in out]


def _automata(benchmark: DataFrame, window: int, max_words: int, item_col: str, text_col: str):
    """The items of each automaton, one after the other, and whether they are the last."""
    words = F.size(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    total = benchmark.agg(F.sum(words)).first()[0] or 0
    parts = max(1, math.ceil(total / max_words))
    for k in range(parts):
        own = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("i"), F.col(text_col).alias("t"))
        own = own.filter(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k)
        yield [(r.i, normal(r.t).split()) for r in own.collect()], k == parts - 1


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, max_words: int = MAX_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest, items, spans) of every row.

    ``spans`` are code points of the text, end exclusive.  With ``with_text``
    the text without its spans follows as ``clean``, and the row itself as ``row``.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"), *([F.struct("*").alias("row")] if with_text else []), F.expr("cast(null as array<struct<a:long,b:long>>) as _hits"), F.expr("cast(null as array<string>) as _items"), F.lit(0).cast("long").alias("_longest"))
    for items, last in _automata(benchmark, window, max_words, item_col, item_text_col):  # one automaton in memory at a time
        before, rows = rows, _pass(rows, spark.sparkContext.broadcast(items), window, last, with_text)
        if not last:
            rows = common.written(rows, "matches")
            common.drop(before)
    return rows


_OUT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long, items array<string>, spans array<struct<start:long,end:long>>"
_KINDS = {"n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(), "items_sha256": pa.string(), "contaminated": pa.bool_(), "longest": pa.int64(), "items": pa.list_(pa.string()), "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "clean": pa.string()}


def _digest(text: str | None, raw: bytes, n_words: int, hits: list[tuple[int, int]], items: list[str], longest: int) -> tuple:
    spans, clean = [], text
    if hits:
        at, source = [m.span() for m in _WORD.finditer(raw)], text.encode()
        spans = [tuple(len(source[:x].decode()) for x in (at[a][0], at[b - 1][1])) for a, b in hits]
        clean = "".join(text[a:b] for a, b in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(text)]))
    found = hashlib.sha256(",".join(items).encode()).hexdigest()
    return n_words, sum(b - a for a, b in hits), len(items), found, bool(hits), longest, items, [{"start": a, "end": b} for a, b in spans], clean


def _pass(rows: DataFrame, shared, window: int, last: bool, with_text: bool) -> DataFrame:
    """Adds one automaton's matches; the last pass makes the result of them."""
    key = uuid.uuid4().hex
    schema = f"{_OUT}, clean string, row {rows.schema['row'].dataType.simpleString()}" if with_text else _OUT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.trim()
        if key not in _built:
            _built.clear()
            _built[key] = Automaton(shared.value, window)
        own = _built[key]
        for batch in batches:
            found: list[tuple] = []
            for text, h, items, longest in zip(*(batch.column(n) for n in ("_text", "_hits", "_items", "_longest"))):
                text = text.as_py()
                raw = normal(text)
                words = raw.split()
                a, b, c = own.matches(words)
                if h.is_valid:
                    a = _merged(a, [(x["a"], x["b"]) for x in h.as_py()])
                    b = b | set(items.as_py())
                c = max(c, longest.as_py())
                found.append(_digest(text, raw, len(words), a, sorted(b), c) if last else ([{"a": x, "b": y} for x, y in a], sorted(b), c))
            cols = [list(c) for c in zip(*found)] or [[]] * (len(_KINDS) if last else 3)
            if last:
                new = {n: pa.array(c, k) for (n, k), c in zip(_KINDS.items(), cols)} | {n: batch.column(n) for n in batch.schema.names if n in ("doc_id", "row")}
                names = ["doc_id", *_KINDS, "row"] if with_text else ["doc_id", *list(_KINDS)[:-1]]
            else:
                names = batch.schema.names
                new = dict(zip(names, batch.columns)) | {n: pa.array(c, batch.schema.field(n).type) for n, c in zip(("_hits", "_items", "_longest"), cols)}
            yield pa.RecordBatch.from_arrays([new[n] for n in names], names=names)

    return rows.mapInArrow(run, schema if last else rows.schema)
