"""Phrase collocation mining by hashed passes, PCY/DHP (operator 12).

Pass m reads the documents and counts, per language, the m-word phrases that may
be frequent: both their parts of m - 1 words are set in a bitmap of the frequent
ones (Apriori), and their own bucket, counted in the pass before, reached the
threshold.  While it does so it counts the buckets of the phrases of m + 1 words
whose two parts it has just counted.  Both bitmaps are broadcast; they have a
fixed size each and no false negatives, so what they let through too much is
counted exactly and falls to the threshold.

A task numbers its words and counts phrases by these numbers, so counts don't
rest on hashes; a run of ``TOGETHER`` words sends each phrase once.  Bucket counts
are sent as the buckets met, and merged by ranges of buckets in tasks that hold a
few ranges each.  The number of buckets follows the input up to ``2**MOST_BUCKETS``
(16 MB of bits); with more text than that serves, more phrases are counted
exactly, and the result is the same.

Frequent phrases are joined with the counts of their parts; a phrase is dropped
for a longer one around it that is as frequent.  The first of each language are
found by salts first, so no task sorts all phrases of a language.

Defined results: null text is empty; null lang is ``und``; languages whose name is
empty are languages; repeated rows count each time; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common, words

#: Words that a task counts together, and distinct ones of them at most.
TOGETHER, DISTINCT = 3_000_000, 800_000
#: Powers of two: buckets at least and at most, bits of the bitmap of frequent phrases, buckets of one range.
LEAST_BUCKETS, MOST_BUCKETS, FREQUENT_BITS, RANGE = 16, 27, 24, 16
#: Parts into which a language's phrases are salted before they are ranked.
SALTS = 32

_BREAK = b"\n"
_NORMAL = bytes(10 if c in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if c == 9 else common.ASCII_LOWER[c] for c in range(256))
_OUT = "lang string, phrase string, n long, chunk int, at binary, counts binary"
_NAMES = ["lang", "phrase", "n", "chunk", "at", "counts"]


def _bit(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the hashes' bits are set in a packed bitmap of a power of two."""
    at = hashes & np.uint64(8 * len(bits) - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 != 0


def _bucket_rows(buckets: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Counts of ascending buckets as a row for each range."""
    cut = np.flatnonzero(np.diff(buckets >> RANGE)) + 1
    at = [x.astype(np.uint16).tobytes() for x in np.split(buckets & (1 << RANGE) - 1, cut)]
    own = [x.astype(np.uint32).tobytes() for x in np.split(counts, cut)]
    chunk = (buckets[np.concatenate([[0], cut]).astype(np.int64)] >> RANGE).astype(np.int32)
    empty = pa.nulls(len(at), pa.string())
    return pa.RecordBatch.from_arrays([empty, empty, pa.nulls(len(at), pa.int64()), pa.array(chunk), pa.array(at, pa.binary()), pa.array(own, pa.binary())], names=_NAMES)


class Counter:
    """Counts what one pass counts of the texts given, a run of them at a time."""

    def __init__(self, m: int, longest: int, bucket_bits: int, frequent: np.ndarray | None, buckets: np.ndarray | None):
        self.m, self.longest, self.mask, self.frequent, self.buckets = m, longest, (1 << bucket_bits) - 1, frequent, buckets
        self._new()

    def _new(self) -> None:
        self.ids, self.langs, self.codes, self.n = words.Ids(), {}, [], 0
        self.brk = self.ids[_BREAK]
        self.blank = self.ids[b""]

    def add(self, text: str, lang: str) -> None:
        tokens = text.encode().translate(_NORMAL).replace(b"\n", b" \n ").split(b" ")
        code = np.fromiter(map(self.ids.__getitem__, tokens), np.int32, len(tokens))
        self.codes.append((self.langs.setdefault(lang, len(self.langs)), code[code != self.blank]))
        self.n += len(self.codes[-1][1])

    @property
    def full(self) -> bool:
        return self.n >= TOGETHER or len(self.ids) >= DISTINCT

    def rows(self) -> Iterator[pa.RecordBatch]:
        """The rows ``_OUT`` of what was added; then it is empty again."""
        codes, langs = [*self.codes], list(self.langs)
        names = list(self.ids)
        if self.n:
            end = np.array([self.brk], np.int32)
            flat = np.concatenate([x for _, c in codes for x in (c, end)])
            lang = np.repeat(np.array([x for x, _ in codes]), [len(c) + 1 for _, c in codes])
            self._new()
            yield from self._counted(flat, lang, names, langs)
        else:
            self._new()

    def _counted(self, flat: np.ndarray, lang: np.ndarray, names: list[bytes], langs: list[str]) -> Iterator[pa.RecordBatch]:
        m = self.m
        own = np.fromiter(map(words.xxhash.xxh3_64_intdigest, names), np.uint64, len(names))[flat]
        stops = np.flatnonzero(flat == self.brk)
        left = np.repeat(stops, np.diff(stops, prepend=-1)) - np.arange(len(flat))  # words up to the piece's end from each place on
        start = np.fromiter((words.xxhash.xxh3_64_intdigest(x.encode()) for x in langs), np.uint64, len(langs))[lang]
        at = np.flatnonzero(left >= m)
        if m > 1:
            shorter = self._hashes(start, own, at, m - 1)
            at = at[_bit(self.frequent, shorter)]
            at = at[_bit(self.frequent, self._hashes(start, own, at + 1, m - 1))]
            at = at[_bit(self.buckets, self._hashes(start, own, at, m))]
        if not len(at):
            return
        code = lang[at].astype(np.int64)
        for j in range(m):  # numbers of phrases, made dense word by word
            code = code * len(names) + flat[at + j]
            if j + 1 < m:
                code = np.unique(code, return_inverse=True)[1].astype(np.int64)
        _, first, n = np.unique(code, return_index=True, return_counts=True)
        first = at[first]
        phrase = [b" ".join([names[x] for x in row]) for row in flat[first[:, None] + np.arange(m)].tolist()]
        none = pa.nulls(len(first))
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()).take(pa.array(lang[first])), pa.array(phrase, pa.binary()).cast(pa.string()), pa.array(n), none.cast(pa.int32()), none.cast(pa.binary()), none.cast(pa.binary())], names=_NAMES)
        if m < self.longest:
            kept = np.zeros(len(flat) + 1, bool)
            kept[at] = True
            on = at[kept[at + 1] & (left[at] > m)]
            if len(on):
                buckets = (self._hashes(start, own, on, m + 1) & np.uint64(self.mask)).astype(np.uint32)
                yield _bucket_rows(*np.unique(buckets, return_counts=True))

    @staticmethod
    def _hashes(start: np.ndarray, own: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
        """Hashes of the ``m`` words from each place on, in its language."""
        out = start[at]
        for j in range(m):
            out = words.mixed(out + own[at + j])
        return out


def _pass(docs: DataFrame, m: int, longest: int, bucket_bits: int, frequent: np.ndarray | None, buckets: np.ndarray | None) -> DataFrame:
    """The rows ``_OUT`` of pass m over ``docs`` (lang, text)."""
    shared = docs.sparkSession.sparkContext.broadcast((frequent, buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.trim()
        own = Counter(m, longest, bucket_bits, *shared.value)
        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist()):
                own.add(text.as_py(), lang)
                if own.full:
                    yield from own.rows()
        yield from own.rows()

    return docs.mapInArrow(run, _OUT)


def _bitmap(rows: DataFrame, bits: int, least: int) -> np.ndarray:
    """The packed bitmap of the buckets of ``rows`` (chunk, at, counts) that reach ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, at, n in zip(batch.column("chunk").to_pylist(), batch.column("at"), batch.column("counts")):
                if chunk not in held:
                    held[chunk] = np.zeros(1 << RANGE, np.uint64)
                held[chunk][np.frombuffer(at.as_py(), np.uint16)] += np.frombuffer(n.as_py(), np.uint32)  # the buckets of a row differ
        out = [(k, np.packbits(x >= least, bitorder="little").tobytes()) for k, x in held.items()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["chunk", "bits"])

    out = np.zeros(1 << bits - 3, np.uint8)
    size = 1 << RANGE - 3
    for r in rows.filter("chunk IS NOT NULL").select("chunk", "at", "counts").repartition("chunk").mapInArrow(run, "chunk int, bits binary").collect():  # 2**bits bits in all
        out[r.chunk * size : (r.chunk + 1) * size] = np.frombuffer(r.bits, np.uint8)
    return out


def _frequent_bits(frequent: DataFrame, m: int) -> np.ndarray:
    """The bitmap of ``frequent`` (lang, phrase), phrases of ``m`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            hashes = np.fromiter(map(words.xxhash.xxh3_64_intdigest, batch.column("lang").to_pylist()), np.uint64, batch.num_rows)
            own = np.fromiter((words.xxhash.xxh3_64_intdigest(w) for p in batch.column("phrase").to_pylist() for w in p.encode().split(b" ")), np.uint64, batch.num_rows * m).reshape(-1, m)
            for j in range(m):
                hashes = words.mixed(hashes + own[:, j])
            yield _bucket_rows(*np.unique((hashes & np.uint64((1 << FREQUENT_BITS) - 1)).astype(np.uint32), return_counts=True))

    return _bitmap(frequent.select("lang", "phrase").mapInArrow(run, _OUT), FREQUENT_BITS, 1)


def frequent_phrases(docs: DataFrame, *, least: int = 100, longest: int = 5, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, m, f) of all phrases of up to ``longest`` words that occur ``least`` times or more, and (lang, n) of all words."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    bits = min(MOST_BUCKETS, max(LEAST_BUCKETS, (size // 200).bit_length()))
    found, totals, frequent, buckets = [], None, None, None
    for m in range(1, longest + 1):
        counted = common.written(_pass(rows, m, longest, bits, frequent, buckets), "phrases")
        counts = counted.filter("chunk IS NULL").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        if m == 1:
            totals = common.written(counted.filter("chunk IS NULL").groupBy("lang").agg(F.sum("n").alias("n")), "totals")
        found.append(common.written(counts.filter(F.col("f") >= least).withColumn("m", F.lit(m)), "frequent"))
        if m < longest:
            frequent, buckets = _frequent_bits(found[-1], m), _bitmap(counted, bits, least)
        common.drop(counted)
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out, totals


def _parts(phrase: str, m: str) -> str:
    """SQL: for each cut of a phrase, its number of words k, side and part."""
    return f"flatten(transform(sequence(1, {m} - 1), k -> array(struct(k, 0 AS side, substring_index({phrase}, ' ', k) AS part), struct(k, 1 AS side, substring_index({phrase}, ' ', k - {m}) AS part))))"


def _within(phrase: str, m: str) -> str:
    """SQL: the shorter phrases of two words or more that lie in a phrase."""
    return f"flatten(transform(sequence(2, {m} - 1), n -> transform(sequence(n, {m}), e -> substring_index(substring_index({phrase}, ' ', e), ' ', -n))))"


def collocations(docs: DataFrame, *, least: int = 100, longest: int = 5, top: int = 2000, closed: int = 100, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first ``top`` phrases."""
    found, totals = frequent_phrases(docs, least=least, longest=longest, text_col=text_col, lang_col=lang_col)
    many = found.filter("m > 1")
    parts = many.select("lang", "phrase", F.col("f").alias("a"), F.expr(f"inline({_parts('phrase', 'm')})"))
    joined = parts.join(found.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    cut = joined.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r")).join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang")
    score = F.expr("cast(1000 AS decimal(4,0)) * cast(a AS decimal(17,0)) * cast(n AS decimal(17,0)) div (cast(l AS decimal(17,0)) * cast(r AS decimal(17,0)))")
    best = cut.withColumn("score", score.cast("long")).groupBy("lang", "phrase", "a", "n").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("x"))
    around = many.filter("m > 2").select("lang", "f", F.explode(F.expr(_within("phrase", "m"))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    kept = best.join(around, ["lang", "phrase"], "left").filter(f"around IS NULL OR 100 * around < {closed} * a").select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
