"""Substring dedup, phrase mining and divergence audit against plain versions of themselves."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from spindrift.llm import divergence, phrases, substrings, words

SCHEMA = "doc_id long, text string, lang string, source string, k long, hits string, content string, term string, anchor string, n long"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "h", "c", "t", "a", 2) for r in rows], SCHEMA).repartition(3)


def documents():
    rng = random.Random(9)
    few = ["a", "b", "c", "Dé", "e,"]
    text = lambda n, own=few: " ".join(rng.choice(own) for _ in range(n))
    many = [f"w{i}" for i in range(4000)]
    passage = text(30, many)
    rows = [(i, text(rng.randrange(40)), rng.choice(["en", "de", None]), rng.choice(["s", "t", None, ""])) for i in range(20)]
    rows += [(100 + i, f"{text(6, many)} {passage} {text(9, many)}", "en", "s") for i in range(40)]  # one passage, other words around it
    rows += [(200 + i, passage, "en", "t") for i in range(10)] + [(200, passage, "en", "t")]  # copies, and one row twice
    rows += [(None, passage, "en", "s"), (300, None, "en", "s"), (301, "", None, None), (302, " \n\t", "xx", "only"), (303, text(4000, few), "fr", "s"), (304, "la " * 3000, "fr", "t"), (305, "la " * 10 + "x\x1cy. LA\x0bla;\tlo", "fr", "u")]
    rng.shuffle(rows)
    return rows


def brute_substrings(rows, window):
    split = [(d, [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]) for d, t, *_ in rows]
    first = {}
    for d, w in split:
        if d is not None:
            for i in range(len(w) - window + 1):
                g = tuple(w[i : i + window])
                first[g] = min(d, first.get(g, d))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1) if d is not None else ():
            if first[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window,gram,shard_words", [(8, 3, 200_000), (8, 4, 60), (5, 9, 30)])
def test_substrings(spark, window, gram, shard_words):
    rows = documents()
    got = substrings.dedup(table(spark, rows), window=window, gram=gram, shard_words=shard_words, with_text=True).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.clean) for r in got), key=repr) == brute_substrings(rows, window)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed and all(a.end < b.start for a, b in zip(r.spans, r.spans[1:])) for r in got)


def test_substrings_of_nothing(spark):
    assert substrings.dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(i, f"every text is its own number {i}", "en", "s") for i in range(5)]
    assert all(r.n_removed == 0 for r in substrings.dedup(table(spark, rows), window=4).collect() if r.doc_id == 0)


def test_first_ids_of_a_shard():
    rng = random.Random(2)
    own, first = substrings.Shard(4), {}
    for d in range(60):
        w = [rng.choice([b"x", b"y", b"z"]) for _ in range(rng.randrange(4, 30))]
        for i in range(len(w) - 3):
            first.setdefault(tuple(w[i : i + 4]), d)
        spread = [x["first"] for x in own.firsts(w, d) for _ in range(x["b"] - x["a"])]
        assert spread == [first[tuple(w[i : i + 4])] for i in range(len(w) - 3)]


def test_hashes_of_sequences():
    h = np.random.default_rng(0).integers(0, 1 << 63, 60, dtype=np.uint64)
    h[30:50] = h[5:25]
    for k in (1, 2, 7, 16, 20):
        g = words.grams(h, k)
        assert len(g) == 61 - k and (g[30 : 51 - k] == g[5 : 26 - k]).all() and len(set(g.tolist())) == 61 - k - (21 - k)
        assert (words.lows(g, 9) == np.lib.stride_tricks.sliding_window_view(g, 9).min(axis=1)).all()


def brute_phrases(rows, least, longest, top, closed=100):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    found = defaultdict(list)
    often = {k: v for k, v in f.items() if v >= least and len(k[1]) > 1}
    around = {}
    for (lang, g), v in often.items():
        for size in range(2, len(g)):
            for i in range(len(g) - size + 1):
                key = lang, g[i : i + size]
                around[key] = max(v, around.get(key, 0))
    for (lang, g), a in often.items():
        score, k = min((1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g)))
        if 100 * around.get((lang, g), 0) < closed * a:
            found[lang].append((-score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]], n[lang]))
    return sorted((lang, i, p.decode(), -a, l, r, t, -s) for lang, own in found.items() for i, (s, a, p, l, r, t) in enumerate(sorted(own)[:top], 1))


@pytest.mark.parametrize("least,longest,top,together", [(3, 5, 2000, 3_000_000), (2, 4, 15, 50), (4, 2, 2000, 500)])
def test_phrases(spark, monkeypatch, least, longest, top, together):
    monkeypatch.setattr(phrases, "TOGETHER", together)
    rows = documents()
    own = phrases.Counter(1, 5, 16, None, None)
    own.add("x", "en")
    assert own.full is (together <= 1)
    got = phrases.collocations(table(spark, rows), least=least, longest=longest, top=top)
    assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == brute_phrases(rows, least, longest, top)


def test_phrases_beyond_64_bits(spark):
    """Counts whose products pass 64 bits."""
    a, n, l, r = 10**13, 10**15, 2 * 10**13, 3 * 10**13
    got = spark.range(1).selectExpr(f"cast(1000 AS decimal(4,0)) * cast({a}L AS decimal(17,0)) * cast({n}L AS decimal(17,0)) div (cast({l}L AS decimal(17,0)) * cast({r}L AS decimal(17,0))) AS s").first()
    assert got.s == 1000 * a * n // (l * r)


def test_phrases_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert phrases.collocations(table(spark, [(1, None, None, None), (2, "", "en", "s")]), least=1).count() == 0


def brute_audit(rows, least, top, c=5):
    split = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source in rows]
    df, counts, out = Counter(), defaultdict(Counter), []
    for lang, source, w in split:
        df.update((lang, t) for t in set(w))
        counts[lang, source].update(w)
    for lang in {x for x, _ in counts}:
        kept = [t for (x, t), n in df.items() if x == lang and n >= least]
        groups = {s: {t: own[t] for t in kept} for (x, s), own in counts.items() if x == lang}
        whole = {t: sum(g[t] for g in groups.values()) for t in kept}
        share = lambda g: {t: 1 + 10**9 * (x + c) // (sum(g.values()) + c * len(kept)) for t, x in g.items()}
        p, q = {s: share(g) for s, g in groups.items()}, share(whole)
        for s in groups:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in groups if o != s)
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if groups[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, o.decode(), -v, i) for part, own in (("pair", pairs), ("term", terms)) for i, (v, o) in enumerate(own, 1)]
    return sorted(out)


@pytest.mark.parametrize("least,top,shard", [(3, 50, 400_000), (2, 4, 10), (10_000, 5, 10)])
def test_audit(spark, monkeypatch, least, top, shard):
    monkeypatch.setattr(divergence, "SHARD", shard)
    monkeypatch.setattr(divergence, "TOGETHER", shard)
    rows = documents()
    got = divergence.audit(table(spark, rows), least=least, top=top)
    assert sorted(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == brute_audit(rows, least, top)


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    got = divergence.audit(table(spark, [(1, None, None, "a"), (2, "", None, "b")])).collect()
    assert sorted((r.lang, r.source, r.item, r.value, r["rank"]) for r in got) == [("", "a", "b", 0, 1), ("", "b", "a", 0, 1)]
