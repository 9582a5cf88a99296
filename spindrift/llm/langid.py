"""Language identification with spans (operator 2).

Every word gets a score per language from naive Bayes over its character
n-grams, counted over all training rows into a fixed number of buckets.  The
word's script narrows the candidates first: a language that hardly uses the
script is out.  Viterbi over the words, with a penalty for each switch, labels
spans of mixed-language text; a text whose best single language no stretch of
others could beat by the penalty needs no search, which is checked exactly.

Learning takes the text and the language of the training rows and nothing else;
a prediction takes the text alone.

Defined results: null text, and text without a letter, is ``und`` with score 0;
so is all text when nothing was learned; ties go to the first language in
alphabetical order; repeated rows are predicted each; an empty table gives no
rows; columns beyond those named are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BUCKET_BITS, ORDERS, PENALTY = 15, (1, 2, 3, 4), 6.0
BUCKETS = 1 << BUCKET_BITS
#: A language uses a script if so many of its words do.
SCRIPT_SHARE = 0.01
#: Words remembered by a task before it starts afresh; texts and words taken together.
CACHE_WORDS, TEXTS, WORDS = 250_000, 512, 50_000
UNKNOWN = "und"
#: The first code points of Unicode's ranges of scripts, and the scripts.
SCRIPT_STARTS = (0x0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x780, 0x900, 0x980, 0xE00, 0x1000, 0x10A0, 0x1100, 0x1E00, 0x1F00, 0x2000, 0x2E80, 0x3040, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD800, 0xF900, 0xFB00, 0xFB50, 0x20000)
SCRIPTS = ("latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "other", "devanagari", "other", "thai", "other", "georgian", "hangul", "latin", "greek", "other", "han", "kana", "other", "han", "other", "hangul", "other", "han", "latin", "arabic", "han")
SCRIPT_NAMES = tuple(sorted(set(SCRIPTS)))
_SCRIPT_OF = np.array([SCRIPT_NAMES.index(s) for s in SCRIPTS])


def letters(word: str) -> str:
    return word.lower() if word.isalpha() else "".join(c for c in word.lower() if c.isalpha())


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the word, bucket) of each n-gram of ``words`` (letters, none empty), and each word's script."""
    text = "".join(f"\x02{w}\x03" for w in words)
    code = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    starts = np.flatnonzero(code == 2)
    of = np.cumsum(code == 2) - 1
    script = _SCRIPT_OF[np.searchsorted(SCRIPT_STARTS, code[starts + 1].astype(np.int64), "right") - 1]
    places, buckets = [], []
    for n in ORDERS:
        k = len(code) - n + 1
        if k <= 0:
            continue
        h = np.full(k, n * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64)
        for i in range(n):
            h = (h ^ code[i : i + k]) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
        own = of[:k] == of[n - 1 :]
        if n == 1:
            own &= code > 3
        places.append(of[:k][own])
        buckets.append((h[own] >> np.uint64(20)) & np.uint64(BUCKETS - 1))
    return np.concatenate(places), np.concatenate(buckets).astype(np.int64), script


class Model:
    """Log-probabilities of buckets and the scripts of each language."""

    def __init__(self, counts: list[tuple[str, int, int]]):
        self.langs = sorted({c[0] for c in counts})
        at = {k: i for i, k in enumerate(self.langs)}
        n = np.zeros((BUCKETS + len(SCRIPT_NAMES), len(self.langs)))
        for lang, bucket, c in counts:
            n[bucket, at[lang]] += c
        own = n[:BUCKETS] + 0.1
        self.logp = (np.log(own / own.sum(axis=0)) / len(ORDERS)).astype(np.float32) if self.langs else own.astype(np.float32)
        scripts = n[BUCKETS:]
        self.uses = scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(axis=0))
        self.uses |= ~self.uses.any(axis=1, keepdims=True)
        self.known: dict[str, int] = {}
        self.scores, self.used = np.zeros((0, len(self.langs)), np.float32), 0

    def places(self, words: list[str]) -> np.ndarray:
        """Each word's row in ``scores``; -1 where it has no letter."""
        known = self.known
        miss = [w for w in dict.fromkeys(words) if w not in known]
        if miss:
            real = [x for x in map(letters, miss)]
            some = [i for i, x in enumerate(real) if x]
            known.update(dict.fromkeys(miss, -1))
            if some:
                place, bucket, script = grams([real[i] for i in some])
                new = np.zeros((len(some), len(self.langs)), np.float32)
                for k in range(len(self.langs)):
                    new[:, k] = np.bincount(place, self.logp[bucket, k], len(some))
                new = np.where(self.uses[script], new - new.max(axis=1, keepdims=True), np.float32(-1e6))
                known.update((miss[i], self.used + j) for j, i in enumerate(some))
                if self.used + len(new) > len(self.scores):
                    self.scores = np.concatenate([self.scores, np.zeros((len(self.scores) + len(new), len(self.langs)), np.float32)])
                self.scores[self.used : self.used + len(new)] = new
                self.used += len(new)
        out = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        return out

    def all_places(self, texts: pa.Array) -> list[np.ndarray]:
        """The places of each text's words; distinct words are looked up once."""
        if not self.langs:
            return [np.full(0, -1)] * len(texts)
        lists = pc.utf8_split_whitespace(texts.fill_null(""))
        coded = lists.flatten().dictionary_encode()
        at = self.places(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        off = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
        return [at[a:b] for a, b in zip(off, off[1:])]

    def forget(self, most: int = CACHE_WORDS) -> None:
        if len(self.known) > most or not most:
            self.known, self.used = {}, 0
            self.scores = self.scores[:0].copy()

    def label(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """The best languages of each text's words, given their scores."""
        out: list = [None] * len(scores)
        hard = []
        for i, s in enumerate(scores):
            best = int(s.sum(axis=0).argmax())
            if s.shape[1] == 1:
                out[i] = np.zeros(len(s), np.int64)
                continue
            gain = np.cumsum(np.delete(s, best, axis=1).max(axis=1) - s[:, best])
            low = np.minimum.accumulate(np.concatenate([[0], gain[:-1]]))
            if (gain - low).max() < PENALTY:
                out[i] = np.full(len(s), best)
            else:
                hard.append(i)
        hard.sort(key=lambda i: -len(scores[i]))
        for i, path in zip(hard, viterbi([scores[i] for i in hard], PENALTY)):
            out[i] = path
        return out


def viterbi(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """Best paths of many sequences side by side; they come longest first."""
    if not scores:
        return []
    size = np.array([len(s) for s in scores])
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    flat = np.concatenate(scores).astype(np.float64)
    active = np.searchsorted(-size, -np.arange(size[0]), "left")  # how many have a word at each step
    stay = np.ones(flat.shape, bool)
    came = np.zeros(len(flat), np.int16)
    v = flat[start].copy()
    for t in range(1, size[0]):
        n = active[t]
        at, own = start[:n] + t, v[:n]
        best = own.argmax(axis=1)
        top = own[np.arange(n), best][:, None] - penalty
        keep = own >= top
        stay[at], came[at] = keep, best
        v[:n] = np.where(keep, own, top) + flat[at]
    path = np.zeros(len(flat), np.int64)
    now = v.argmax(axis=1)
    for t in range(size[0] - 1, -1, -1):
        n = active[t]
        at = start[:n] + t
        path[at] = now[:n]
        now[:n] = np.where(stay[at, now[:n]], now[:n], came[at])
    return [path[a : a + n] for a, n in zip(start, size)]


def learn(train: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts over all rows with a language; collects languages x (buckets + scripts) rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                texts, langs = batch.column(0).slice(at, TEXTS), batch.column(1).slice(at, TEXTS)
                for lang in pc.unique(langs).to_pylist():
                    counted = pc.value_counts(pc.utf8_split_whitespace(texts.filter(pc.equal(langs, lang))).flatten())
                    own: Counter = Counter()
                    for w, n in zip(counted.field(0).to_pylist(), counted.field(1).to_pylist()):
                        own[letters(w)] += n
                    own.pop("", None)
                    kinds = list(own.items())
                    for i in range(0, len(kinds), WORDS):
                        names, n = zip(*kinds[i : i + WORDS])
                        place, bucket, script = grams(list(names))
                        n = np.array(n, np.float64)
                        all_ = np.concatenate([np.bincount(bucket, n[place], BUCKETS), np.bincount(script, n, len(SCRIPT_NAMES))])
                        total[lang] = total[lang] + all_ if lang in total else all_
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at].astype(np.int64))], names=["lang", "bucket", "n"])

    rows = train.select(F.col(text_col), F.col(lang_col)).dropna()
    counts = rows.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    return Model(list(zip(*(counts.column(k).to_pylist() for k in ("lang", "bucket", "n")))))


OUT = "doc_id long, lang_pred string, score double"
_SPANS = "array<struct<start:int,end:int,lang:string>>"


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_spans: bool = True) -> DataFrame:
    """(doc_id, lang_pred, score[, spans]) of every row, after the columns ``keep`` in a struct ``row`` if any.

    The score is the share of words labelled with the predicted language, up to
    half less as its posterior over the whole text is less than 1; spans are stretches of blank-delimited
    words with one label, end exclusive.
    """
    spark = docs.sparkSession
    model.known, model.scores, model.used = {}, model.scores[:0], 0
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.trim()
        m = shared.value
        for batch in batches:
            found: list[tuple] = []
            texts = batch.column("row").field(text_col) if text_col in keep else batch.column("_text")
            for i in range(0, batch.num_rows, TEXTS):
                m.forget()
                some = m.all_places(texts.slice(i, TEXTS))
                real = [np.flatnonzero(p >= 0) for p in some]
                scores = [m.scores[p[r]] for p, r in zip(some, real)]
                full = [k for k, r in enumerate(real) if len(r)]
                paths = dict(zip(full, m.label([scores[k] for k in full])))
                for k in range(len(some)):
                    if k not in paths:
                        found.append((UNKNOWN, 0.0, []))
                        continue
                    share = np.bincount(paths[k], minlength=len(m.langs))
                    best = int(share.argmax())
                    total = scores[k].sum(axis=0, dtype=np.float64)
                    post = 1 / np.exp(np.minimum(700, total - total[best])).sum()
                    spans = []
                    if with_spans:
                        turn = np.flatnonzero(np.diff(paths[k])) + 1
                        ends = [0, *real[k][turn].tolist(), len(some[k])]
                        spans = [{"start": a, "end": b, "lang": m.langs[paths[k][j]]} for a, b, j in zip(ends, ends[1:], [0, *turn.tolist()])]
                    found.append((m.langs[best], float(share[best] / len(paths[k]) * (0.5 + 0.5 * post)), spans))
            cols = [list(c) for c in zip(*found)] or [[], [], []]
            arrays = [batch.column(n) for n in batch.schema.names if n != "_text"] + [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64())]
            names = [n for n in batch.schema.names if n != "_text"] + ["lang_pred", "score"]
            if with_spans:
                arrays.append(pa.array(cols[2], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(arrays, names=names)
        m.forget(0)  # workers outlive their tasks, and the model with them
        common.trim()

    rows = docs.select(*([F.struct(*keep).alias("row")] if keep else []), F.col(id_col).cast("long").alias("doc_id"), *([] if text_col in keep else [F.col(text_col).alias("_text")]))
    row = f"row {rows.schema['row'].dataType.simpleString()}, " if keep else ""
    return rows.mapInArrow(run, row + OUT + (f", spans {_SPANS}" if with_spans else ""))


def trained_on(docs: DataFrame, of: int = 3, held: int = 1, id_col: str = "doc_id") -> DataFrame:
    """The training rows: those whose crc32 of the id isn't ``held`` modulo ``of``."""
    return docs.filter(common.fold(id_col, of) != held)
