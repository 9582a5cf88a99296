"""Toxicity by class-conditional Kneser-Ney models (operator 6).

Two bigram models, of toxic and of ordinary labelled texts, with modified
Kneser-Ney discounts.  Both back off to one distribution of continuation counts
over all labelled texts.  A word or bigram met so seldom that one as common in
either class would likely be missing from one of them (see ``enough``) is
discounted wholly, so a rare expression, which says little about either class,
gets nearly the same probability from both; the bound follows from the classes'
shares and not from the size of the input.  A text's evidence is the
difference of its two log-likelihoods per word, over the whole text and over
its best window of ``WINDOW`` words; a logistic curve fitted on labelled rows
kept out of the counts turns it into a score.

All labelled training rows are counted, each expression once a text, so that a
text that repeats itself weighs no more than another.  Counts are keyed by
64-bit hashes of words, in tables that grow with the input.  The model takes
from them what isn't wholly discounted: words and bigrams met often enough, the
latter after contexts met in both classes.  For all other words the classes
differ by a constant, and after contexts without such a bigram by nothing more,
so they need no entry.  The curve is fitted on at most
``CURVE_ROWS`` rows, chosen by a hash of their id.

Defined results: null or wordless text scores as a text of no evidence; without
labelled rows of both classes every score is the share of toxic labels; rows
repeated in ``documents`` are scored each; several labels of one id count each;
empty tables give no rows; columns beyond those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .decontaminate import normal

WINDOW, BOTH = 2, 0.6
#: What a text's first word follows.
START = 0
#: Labelled rows that the curve is fitted on at most, and label rows that may be broadcast.
CURVE_ROWS, BROADCAST_LABELS = 50_000, 1_000_000
CACHE_WORDS = 800_000
#: Folds of crc32(id) modulo 5: held out, and kept for the curve; the others are counted.
FOLDS, HELD, CURVE = 5, 0, 4

_codes: dict[bytes, int] = {}


def enough(share: float) -> int:
    """How often an expression must be met so that, were it as common in either class, it would be met in both with probability ``BOTH``; ``share`` is one class's."""
    if not 0 < share < 1:
        return 1
    n = max(1, int(np.log(1 - BOTH) / np.log1p(-min(share, 1 - share))))
    while 1 - share**n - (1 - share) ** n < BOTH:
        n += 1
    return n


def coded(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's words, as signed longs."""
    from xxhash import xxh64_intdigest

    words = normal(text).split()
    if len(_codes) > CACHE_WORDS:
        _codes.clear()
    for w in set(words):
        if w not in _codes:
            _codes[w] = xxh64_intdigest(w, 7)
    return np.fromiter(map(_codes.__getitem__, words), np.uint64, len(words)).view(np.int64)


def pair(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64-bit hashes of bigrams."""
    h = (context.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ word.view(np.uint64)
    h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ h >> np.uint64(29)).view(np.int64)


def places(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Where ``asked`` are in sorted ``keys``; their number for those that aren't."""
    if not len(keys):
        return np.zeros(len(asked), np.int64)
    at = np.searchsorted(keys, asked)
    return np.where(keys[np.minimum(at, len(keys) - 1)] == asked, at, len(keys))


def discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts of 0, 1, 2 and 3 or more, from counts of counts."""
    n1, n2, n3, n4 = (max(1.0, float(x)) for x in n[:4])
    y = n1 / (n1 + 2 * n2)
    d = np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(d, [0, 0.1, 0.2, 0.3], [0, 0.99, 1.9, 2.9])


class Model:
    """``words``: keys, counts by class and distinct contexts of words that aren't rare; ``all_words``: totals over all words; ``pairs``: keys and counts by class of bigrams that aren't rare; ``spread``: of contexts, keys and by class the count, how much of that is rare followers, and the others that come once, twice and more often; ``seen``: by class, bigrams that come one to four times."""

    def __init__(self, words: tuple, all_words: dict, pairs: tuple, spread: tuple, seen: np.ndarray):
        self.words, count, follows = words
        self.pairs, met = pairs
        self.contexts, spread = spread
        shared = (np.append(follows, 0) + 0.5) / (all_words["follows"] + 0.5 * (all_words["n"] + 1))
        # the last place of each table stands for all other keys
        self.uni = np.zeros((2, len(self.words) + 1))
        self.bi = np.zeros((2, len(self.pairs) + 1))
        self.rest, self.n = np.ones((2, len(self.contexts) + 1)), np.full((2, len(self.contexts) + 1), np.inf)
        for c in (0, 1):
            d = discounts(all_words["seen"][c])
            off = d[np.minimum(count[c], 3).astype(np.int64)]
            total, gone = all_words["total"][c], off.sum() + all_words["rare"][c]
            self.uni[c] = np.append(count[c] - off, 0) / total + gone / total * shared if total else shared
            d = discounts(seen[c])
            self.bi[c, :-1] = met[c] - d[np.minimum(met[c], 3).astype(np.int64)]
            self.rest[c, :-1] = (spread[c, 1] + d[1:] @ spread[c, 2:]) / spread[c, 0]
            self.n[c, :-1] = spread[c, 0]
        self.curve = np.zeros(3)

    def evidence(self, text: str | None) -> tuple[float, float]:
        """Log-likelihood difference per word: of the whole text, and of its best window."""
        w = coded(text)
        if not len(w):
            return 0.0, 0.0
        log, own, v = [], places(self.words, w), places(self.contexts, w[:-1])
        k = np.full(len(v), len(self.pairs))
        told = np.flatnonzero(v < len(self.contexts))
        k[told] = places(self.pairs, pair(w[told], w[told + 1]))
        for c in (0, 1):
            p = self.uni[c][own]
            p[1:] = self.bi[c][k] / self.n[c][v] + self.rest[c][v] * p[1:]
            log.append(np.log(np.maximum(p, 1e-300)))
        d = log[1] - log[0]
        s = np.concatenate([[0.0], np.cumsum(d)])
        k = min(WINDOW, len(d))
        return float(s[-1] / len(d)), float((s[k:] - s[:-k]).max() / WINDOW)

    def score(self, text: str | None) -> float:
        a, b = self.evidence(text)
        z = self.curve[0] + self.curve[1] * a + self.curve[2] * b
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        """The logistic curve, by Newton's method with a small ridge."""
        rate = float(np.clip(y.mean() if len(y) else 0.1, 0.01, 0.99))
        self.curve = np.array([np.log(rate / (1 - rate)), 0.0, 0.0])
        if len(set(y.tolist())) < 2:
            return
        m, s = x.mean(axis=0), x.std(axis=0) + 1e-9
        a = np.column_stack([np.ones(len(x)), (x - m) / s])
        b = np.zeros(3)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a @ b, -40, 40)))
            g = a.T @ (p - y) + 0.1 * np.array([0, *b[1:]])
            h = a.T @ (a * np.maximum(p * (1 - p), 1e-6)[:, None]) + np.diag([1e-9, 0.1, 0.1])
            b -= np.linalg.solve(h, g)
        self.curve = np.array([b[0] - (b[1:] * m / s).sum(), *(b[1:] / s)])


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    spark = docs.sparkSession
    own = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).dropna().filter("_y in (0, 1)").filter(common.fold("_id", FOLDS) != HELD)
    n_labels, n_toxic = own.agg(F.count(F.lit(1)), F.sum("_y")).first()
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    labelled = texts.join(F.broadcast(own) if n_labels <= BROADCAST_LABELS else own, "_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[], [], []]
            for text, y in zip(batch.column("_text"), batch.column("_y").to_pylist()):
                w = coded(text.as_py())
                if len(w):
                    before = np.concatenate([[START], w[:-1]])
                    at = np.unique(pair(before, w), return_index=True)[1]
                    for to, x in zip(found, (before[at], w[at], np.full(len(at), y))):
                        to.append(x)
            if found[0]:
                before, w, y = map(np.concatenate, found)
                _, at, of = np.unique(pair(before, w), return_index=True, return_inverse=True)
                n = [np.bincount(of[y == c], minlength=len(at)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(before[at]), pa.array(w[at]), pa.array(n[0]), pa.array(n[1])], names=["context", "word", "n0", "n1"])

    counted = labelled.filter(common.fold("_id", FOLDS) != CURVE).select("_text", "_y").mapInArrow(count, "context long, word long, n0 long, n1 long")
    bigrams = common.written(counted.groupBy("context", "word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "bigrams")
    model = Model(*_tables(bigrams, enough((n_toxic or 0) / max(1, n_labels))))

    shared = spark.sparkContext.broadcast(model)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = [shared.value.evidence(t.as_py()) for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in e], pa.float64()), pa.array([b for _, b in e], pa.float64()), batch.column("_y")], names=["a", "b", "y"])

    fitted = labelled.filter(common.fold("_id", FOLDS) == CURVE)
    if (n := fitted.select("_id").count()) > CURVE_ROWS:
        fitted = fitted.filter(F.pmod(F.xxhash64("_id"), F.lit(n)) < CURVE_ROWS)
    got = fitted.select("_text", "_y").mapInArrow(evidence, "a double, b double, y int").toArrow()
    model.fit(np.column_stack([got.column("a").to_numpy(), got.column("b").to_numpy()]), got.column("y").to_numpy().astype(float))
    if not n_labels or not n_toxic or n_toxic == n_labels:
        rate = float(np.clip((n_toxic or 0) / max(1, n_labels), 0.01, 0.99))
        model.curve = np.array([np.log(rate / (1 - rate)), 0.0, 0.0])
    return model


def _tables(bigrams: DataFrame, least: int):
    """The model's counts; what was met fewer than ``least`` times is rare."""

    def sorted_(rows: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = rows.toArrow()
        k = got.column("k").to_numpy()
        order = np.argsort(k)
        return k[order], np.array([got.column(n).to_numpy()[order] for n in names], float)

    often = F.col("n0") + F.col("n1") >= least
    times = lambda: [F.count(F.when(F.col(f"n{c}") == k, 1)) for c in (0, 1) for k in (1, 2, 3, 4)]
    words = common.written(bigrams.groupBy(F.col("word").alias("k")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.count(F.lit(1)).alias("f")), "words")
    sums = [F.sum(x) for x in (F.lit(1), "f", "n0", "n1", F.when(~often, F.col("n0")), F.when(~often, F.col("n1")))]
    got = [float(x or 0) for x in words.agg(*sums, *times()).first()]
    all_words = {"n": got[0], "follows": got[1], "total": got[2:4], "rare": got[4:6], "seen": np.array(got[6:]).reshape(2, 4)}
    keys, counts = sorted_(words.filter(often), ["n0", "n1", "f"])

    inner = bigrams.filter(F.col("context") != START)
    kinds = []
    for c in ("n0", "n1"):
        kind = [(F.col(c) == 1), (F.col(c) == 2), (F.col(c) >= 3)]
        kinds += [F.sum(c).alias(c), F.sum(F.when(~often, F.col(c)).otherwise(0)).alias(f"{c}_rare"), *[F.count(F.when(often & x, 1)).alias(f"{c}_{k}") for k, x in enumerate(kind)]]
    names = [f"{c}{x}" for c in ("n0", "n1") for x in ("", "_rare", "_0", "_1", "_2")]
    told = common.written(inner.groupBy(F.col("context").alias("k")).agg(*kinds, F.max(often).alias("told")).filter("n0 > 0 AND n1 > 0 AND told"), "contexts")
    contexts, spread = sorted_(told, names)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(pair(batch.column("context").to_numpy(), batch.column("word").to_numpy())), batch.column("n0"), batch.column("n1")], names=["k", "n0", "n1"])

    pairs = inner.filter(often).join(told.select(F.col("k").alias("context")), "context", "left_semi").select("context", "word", "n0", "n1")
    pairs = sorted_(pairs.mapInArrow(hashed, "k long, n0 long, n1 long"), ["n0", "n1"])
    seen = inner.agg(*times()).first()
    return (keys, counts[:2], counts[2]), all_words, pairs, (contexts, spread.reshape(2, 5, -1)), np.array(seen, float).reshape(2, 4)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([shared.value.score(t.as_py()) for t in batch.column("_text")], pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text")).mapInArrow(run, "doc_id long, score double")
