"""Models against plain versions of themselves, the pipeline stage by stage, recall and very long texts."""

import collections
import itertools
import math
import random
import re
import string
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from spindrift.llm import common, components, decontaminate, langid, lines, near, packing, quality, rans, secrets, simhash, tokens, toxicity, urls

SF = "/root/testdata/sf0.01"
M64 = (1 << 64) - 1
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# --- language identification, one n-gram at a time
def grams(word):
    code = [2, *map(ord, word), 3]
    for n in langid.ORDERS:
        for i in range(len(code) - n + 1):
            if n == 1 and code[i] <= 3:
                continue
            h = n * 0x9E3779B97F4A7C15 & M64
            for c in code[i : i + n]:
                h = (h ^ c) * 0xFF51AFD7ED558CCD & M64
                h ^= h >> 32
            yield h >> 20 & langid.BUCKETS - 1


def plain_words(text):
    return [x for x in ("".join(c for c in w.lower() if c.isalpha()) for w in text.split()) if x]


def test_language_scores_against_a_plain_model(spark):
    rng = random.Random(1)
    vocabulary = {"en": ["the", "house", "water", "and"], "fr": ["les", "maison", "l'eau", "été"], "ru": ["дом", "вода"]}
    rows = [(i, " ".join(rng.choice(vocabulary[k]) for _ in range(6)), k) for i, k in enumerate(["en", "fr", "ru"] * 8)]
    asked = ["the water", "les maison les", "дом the", "house les дом", "42", "", None, "xyz", "the the the les les les les les"]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    langs = sorted(vocabulary)
    n = {k: collections.Counter() for k in langs}
    scripts = {k: collections.Counter() for k in langs}
    kind = lambda w: "cyrillic" if w[0] >= "Ѐ" else "latin"
    for _, text, k in rows:
        for w in plain_words(text):
            n[k].update(grams(w))
            scripts[k][kind(w)] += 1
    total = {k: sum(n[k].values()) + 0.1 * langid.BUCKETS for k in langs}

    def word_scores(w):
        s = [sum(math.log((n[k][b] + 0.1) / total[k]) for b in grams(w)) / len(langid.ORDERS) for k in langs]
        uses = [scripts[k][kind(w)] >= langid.SCRIPT_SHARE * sum(scripts[k].values()) for k in langs]
        return [x - max(s) if u else -1e6 for x, u in zip(s, uses)]

    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model, with_spans=False).collect()}
    for i, text in enumerate(asked):
        words = [word_scores(w) for w in plain_words(text or "")]
        if not words:
            assert got[i] == ("und", 0.0)
            continue
        path = max(itertools.product(range(3), repeat=len(words)), key=lambda p: sum(w[k] for w, k in zip(words, p)) - langid.PENALTY * sum(a != b for a, b in zip(p, p[1:])))
        best = max(range(3), key=lambda k: (path.count(k), -k))
        whole = [sum(w[k] for w in words) for k in range(3)]
        post = 1 / sum(math.exp(min(700, x - whole[best])) for x in whole)
        assert got[i][0] == langs[best] and abs(got[i][1] - path.count(best) / len(words) * (0.5 + 0.5 * post)) < 1e-4, text


# --- Kneser-Ney, one word at a time
def test_toxicity_against_a_plain_model(spark):
    rng = random.Random(3)
    bad, good, shared = ["vile", "scum", "rot"], ["kind", "calm", "mild"], [f"w{i}" for i in range(30)]
    rows, labels = [], []
    for i in range(1500):
        y = i % 2
        rows.append((i, " ".join(rng.choice((bad if y else good) + shared) for _ in range(25))))
        labels.append((i, y))
    model = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    two = collections.defaultdict(lambda: [0, 0])
    for (i, text), (_, y) in zip(rows, labels):
        if zlib.crc32(str(i).encode()) % 5 not in (toxicity.HELD, toxicity.CURVE):
            w = text.split()
            for pair in set(zip([None, *w], w)):
                two[pair][y] += 1
    one, follows = collections.defaultdict(lambda: [0, 0]), collections.Counter()
    for (v, w), c in two.items():
        follows[w] += 1
        for k in (0, 1):
            one[w][k] += c[k]
    inner = {p: c for p, c in two.items() if p[0] is not None}

    def off(counts, k):
        seen = [max(1.0, float(sum(c[k] == j for c in counts))) for j in (1, 2, 3, 4)]
        y = seen[0] / (seen[0] + 2 * seen[1])
        d = [1 - 2 * y * seen[1] / seen[0], 2 - 3 * y * seen[2] / seen[1], 3 - 4 * y * seen[3] / seen[2]]
        return [0.0, *(min(max(x, a), b) for x, a, b in zip(d, (0.1, 0.2, 0.3), (0.99, 1.9, 2.9)))]

    kept = [y for i, y in labels if zlib.crc32(str(i).encode()) % 5 != toxicity.HELD]
    share = sum(kept) / len(kept)
    least = next(n for n in itertools.count(1) if 1 - share**n - (1 - share) ** n >= toxicity.BOTH)
    assert least > 1
    often = lambda c: sum(c) >= least
    d1, d2 = ([off(t.values(), k) for k in (0, 1)] for t in (one, inner))
    met = collections.defaultdict(lambda: [0, 0])
    for (v, _), c in inner.items():
        for k in (0, 1):
            met[v][k] += c[k]

    def chance(k, v, w):
        total = sum(c[k] for c in one.values())
        gone = sum(d1[k][min(c[k], 3)] if often(c) else c[k] for c in one.values())
        base = ((follows[w] if w in one and often(one[w]) else 0) + 0.5) / (sum(follows.values()) + 0.5 * (len(one) + 1))
        p = gone / total * base + ((one[w][k] - d1[k][min(one[w][k], 3)]) / total if w in one and often(one[w]) else 0)
        if v is None or v not in met or not min(met[v]):
            return p
        rest = sum(d2[k][min(c[k], 3)] if often(c) else c[k] for (x, _), c in inner.items() if x == v) / met[v][k]
        c = inner.get((v, w), [0, 0])
        return ((c[k] - d2[k][min(c[k], 3)]) / met[v][k] if often(c) else 0) + rest * p

    for text in ("vile w1 w2", "w3 kind calm w4", "unheard of words", "w1 w2 w3 vile scum rot w4 w5", "mild"):
        w = text.split()
        d = [math.log(chance(1, v, x)) - math.log(chance(0, v, x)) for v, x in zip([None, *w], w)]
        k = min(toxicity.WINDOW, len(d))
        want = sum(d) / len(d), max(sum(d[i : i + k]) for i in range(len(d) - k + 1)) / toxicity.WINDOW
        assert np.allclose(model.evidence(text), want, atol=1e-9), text


def test_rare_expressions():
    """The bound is the least count of its definition, whatever the classes' shares."""
    for share in (0.0001, 0.01, 0.0863, 0.1128, 0.3, 0.5, 0.7, 0.999):
        n, both = toxicity.enough(share), lambda n, s=share: 1 - s**n - (1 - s) ** n
        assert both(n) >= toxicity.BOTH > both(n - 1) and n == toxicity.enough(1 - share)
    assert toxicity.enough(0.0) == toxicity.enough(1.0) == 1


# --- lines
def edit_distance(a, b):
    row = np.arange(len(b) + 1)
    codes = np.frombuffer(b.encode("utf-32-le"), "<u4")
    place = np.arange(len(b) + 1)
    for i, c in enumerate(a, 1):
        new = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (codes != ord(c)))])
        row = np.minimum.accumulate(new - place) + place
    return int(row[-1])


def similar_pairs(own, least=0.8):
    """Pairs of lines with an edit similarity of ``least`` or more, among those that share three tenths of their words' weight."""
    words = [set(x.split()) for x in own]
    df = collections.Counter(w for x in words for w in x)
    weight = {w: math.log(len(own) / c) + 0.01 for w, c in df.items()}
    where = collections.defaultdict(list)
    for i, x in enumerate(words):
        for w in x:
            where[w].append(i)
    for i, x in enumerate(words):
        shared = collections.Counter()
        for w in x:
            if df[w] <= 300:
                for j in where[w]:
                    shared[j] += weight[w] * (j > i)
        whole = sum(weight[w] for w in x)
        for j, s in shared.items():
            n = max(len(own[i]), len(own[j]))
            if j > i and s >= 0.3 * whole and abs(len(own[i]) - len(own[j])) <= (1 - least) * n and edit_distance(own[i], own[j]) <= int((1 - least) * n + 1e-9):
                yield i, j


def normal(line):
    return " ".join(line.lower().split())


def test_line_recall_on_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [r.text or "" for r in docs.select("text").collect()]
    own = sorted({n for t in texts for n in map(normal, t.split("\n")) if len(n.split()) >= lines.MIN_WORDS and len(n) <= 1200})
    kept = {normal(x) for r in lines.dedup(docs).select("clean").collect() for x in (r.clean or "").split("\n")}
    pairs = list(similar_pairs(own))
    missed = [(i, j) for i, j in pairs if own[i] in kept and own[j] in kept]
    assert len(pairs) > 150 and len(missed) <= 0.1 * len(pairs), (len(missed), len(pairs))
    short = [n for t in texts for n in map(normal, t.split("\n")) if n and re.search(r"\w", n) and len(n.split()) < lines.MIN_WORDS and len(n) < lines.MIN_CHARS]
    left = collections.Counter(normal(x) for r in lines.dedup(docs).select("clean").collect() for x in (r.clean or "").split("\n"))
    assert all(left[n] == 1 for n in set(short))  # repeated short lines go exactly


def first_lines(rows):
    """What ``lines.dedup`` leaves of (doc_id, text), by comparing all pairs."""
    seen = [(i, n, normal(x)) for i, t in rows for n, x in enumerate(t.split("\n")) if re.search(r"\w", x)]
    long = lambda x: len(x.split()) >= lines.MIN_WORDS or len(x) >= lines.MIN_CHARS
    root = list(range(len(seen)))
    for a in range(len(seen)):
        for b in range(a):
            x, y = seen[a][2], seen[b][2]
            if x == y or long(x) and long(y) and edit_distance(x, y) <= int(0.2 * max(len(x), len(y)) + 1e-9):
                root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    gone = {seen[k][:2] for k, r in enumerate(root) if root.index(r) != k}
    return {i: "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in rows}


# --- the pipeline
@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    words = {k: ["".join(rng.choice(a) for _ in range(rng.randrange(3, 9))) for _ in range(400)] for k, a in (("en", "abcdefgh"), ("de", "mnopqrst"))}
    text = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    rows = [(i, "\n".join(text("en" if i % 2 else "de", 30) for _ in range(4)), "en" if i % 2 else "de") for i in range(24)]
    item = text("en", 25)
    base = rows[1][1].replace("\n", " ")
    own = base.split()
    own[40] = "changed"
    passage = text("de", 60)
    rows += [
        (100, base, "en"), (101, " ".join(own), "en"), (102, rows[2][1], "de"), (103, None, None), (104, "", "en"), (105, "12 34 !!", "de"), (106, text("en", 80) + " " + item + " " + text("en", 10), "en"), (107, item, "en"),
        (108, passage + "\n" + text("de", 20), "de"), (109, text("de", 20) + "\n" + passage, "de"), (None, text("en", 50), "en"), (110, text("en", 900), "en"), (111, "short\n" + text("en", 30), "en"), (112, "Short\n" + text("en", 30), "en"),
    ]
    at = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame([(i, t, k, "s", len(t or "")) for i, t, k in rows], DOCS)
    docs.coalesce(2).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, item), (2, "never met at all " * 4)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), item


def table_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_pipeline_stages_against_brute_force(spark, corpus):
    sf, item = corpus
    docs = common.table(spark, sf, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "near_dedup", "benchmark_decontamination", "pack"]

    told = common.written(stages["language_id"](spark, docs, sf), "t")
    assert told.columns == docs.columns
    assert table_of(told) == table_of(docs.filter("doc_id IS NULL OR doc_id NOT IN (103, 104, 105)"))  # the rest is in one language each

    left = common.written(stages["line_dedup"](spark, told, sf), "t")
    rows = sorted(((r.doc_id, r.text) for r in told.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    want = first_lines(rows)
    got = {r.doc_id: r.text for r in left.collect()}
    assert got == {i: t for i, t in want.items() if t.strip() or not any(i == j and t != u for j, u in rows)}
    assert left.filter(F.length("text") != F.col("n_chars")).count() == 0 and left.columns == docs.columns
    assert sum("\n" not in (got.get(i) or "") for i in (108, 109)) >= 1  # the repeated passage went once

    kept = common.written(stages["near_dedup"](spark, told, sf), "t")  # of all texts, near copies among them
    shingles = {}
    for i, t in rows:
        w = (t or "").lower().split()
        shingles[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    names = [i for i, _ in rows]
    root = {i: i for i in names}
    order = sorted(names, key=lambda i: (i is None, i or 0))
    for a, b in itertools.combinations(order, 2):
        x, y = shingles[a], shingles[b]
        if 5 * len(x & y) >= 4 * len(x | y):
            old, new = sorted((root[a], root[b]), key=order.index)[::-1]
            root = {k: new if v == old else v for k, v in root.items()}
    assert {r.doc_id for r in kept.collect()} == {i for i in names if root[i] == i} and 101 not in {r.doc_id for r in kept.collect()}

    clean = common.written(stages["benchmark_decontamination"](spark, told, sf), "t")
    found = {r.doc_id: r.text for r in clean.collect()}
    assert 107 not in found and item not in found[106] and all(found[i] == t for i, t in rows if i not in (106, 107))

    pieces = stages["pack"](spark, clean, sf).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, text in found.items():
        own = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        assert [x for p in own for x in struct.unpack(f"<{p.length}I", p.ids)] == [*t.encode(text, add_special_tokens=False).ids, 0]


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_runs_through(spark, corpus):
    out = corpus_pipeline.run(spark, corpus[0])
    assert out.count() > 0 and out.filter("doc_id IN (103, 104, 105)").count() == 0


# --- blocks
def test_decoding_from_any_checkpoint():
    ids = np.random.default_rng(4).integers(0, 300, 700_000) ** 2 // 300
    tokens, counts = np.unique(ids, return_counts=True)
    table = rans.Table(tokens, rans.scaled(tokens, counts))
    payload = rans.encode(ids, table)
    n = rans.checkpoints(payload)
    step = rans.CHECK_STEPS * min(rans.MAX_LANES, len(ids) // 64)
    assert n > 2
    for a in range(n):
        assert (rans.decode(payload, table, a, a + 1) == ids[a * step : (a + 1) * step]).all()
    assert (rans.decode(payload, table, 1) == ids[step:]).all()


# --- discovery control
def test_share_of_false_reports(spark):
    """Of strings reported as random, few are built from words, however many of those there are."""
    rng = random.Random(21)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    syllables = ["ing", "tion", "user", "data", "set", "get", "name", "value", "index", "file"]
    drawn = ["x1" + "".join(rng.choice(letters) for _ in range(rng.choice((24, 40, 64)))) for _ in range(300)]
    built = ["_".join(rng.choice(syllables) for _ in range(rng.choice((6, 9, 14)))) + str(rng.randrange(10)) for _ in range(900)]
    rows = spark.createDataFrame([(i, f"see {t} there") for i, t in enumerate(drawn + built)], "doc_id long, text string")
    found = {r.doc_id for r in secrets.scan(rows).collect() if "random:" in r.spans}
    right, wrong = sum(i < 300 for i in found), sum(i >= 300 for i in found)
    assert right >= 250 and wrong <= 0.15 * len(found), (right, wrong)


# --- very long texts
def test_very_long_texts(spark):
    rng = random.Random(7)
    word = "".join(rng.choice("abcdefghijklmnop") for _ in range(600_000))
    line = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(80_000))
    many = "\n".join(f"line {i} of a text with very many lines" for i in range(30_000))
    rows = spark.createDataFrame([(1, word, "en", "s", 0), (2, line, "en", "s", 0), (3, many, "en", "s", 0), (4, line, "en", "s", 0), (5, "a few words only", "en", "s", 0)], DOCS)
    prints = {r.doc_id: r for r in simhash.near_duplicates(rows).collect()}
    assert prints[2].component_id == prints[4].component_id == 2 and prints[1].component_id == 1
    assert langid.predict(rows, langid.learn(rows)).filter("lang_pred = 'en'").count() == 5
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = t.encode(line, add_special_tokens=False).ids
    assert packing.pack(rows.filter("doc_id = 2"), public_tokenizers.path("byte_bpe_50k.json")).agg(F.sum("length")).first()[0] == len(ids) + 1
    assert quality.judge(rows).filter("doc_id = 3 AND n_words = 270000").count() == 1
    bench = spark.createDataFrame([(1, " ".join(line.split()[70_000:70_020]))], "item_id long, text string")
    assert {(r.doc_id, r.n_hit) for r in decontaminate.decontaminate(rows, bench).collect()} >= {(2, 20), (4, 20), (1, 0)}
    assert {r.doc_id: r.n_removed for r in lines.dedup(rows.filter("doc_id <> 3")).collect()} == {1: 0, 2: 0, 4: 1, 5: 0}
    assert near.first_of_each(rows).count() == 4
    assert secrets.scan(rows).count() == 5
    assert urls.judge(spark.createDataFrame([(1, "http://x.net/" + word)], "page_id long, url string"), [("block", "net/")]).first().verdict == "block"
    model = toxicity.learn(rows, spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int"))
    assert toxicity.score(rows, model).filter("score BETWEEN 0 AND 1").count() == 5


def test_ties(spark):
    """Equal evidence goes to the first language; equal lengths of rules can't meet; even toxicity is scored alike."""
    rows = spark.createDataFrame([(1, "aa", "b"), (2, "aa", "a")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.predict(rows, langid.learn(rows)).collect()} == {"a"}
    model = toxicity.learn(spark.createDataFrame([(i, "same words here") for i in range(40)], "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int"))
    assert abs(model.score("same words here") - model.score("other ones")) < 0.2
    pages = spark.createDataFrame([(1, "http://a.net/x"), (2, "http://a.net/x")], "page_id long, url string")
    assert {r.rule for r in urls.judge(pages, [("block", "net/"), ("allow", "a.net/")]).collect()} == {"a.net/"}


def test_bloom_false_positives_are_joined_away(spark, monkeypatch):
    """A filter that lets everything through changes nothing."""
    pages = spark.createDataFrame([(i, f"http://h{i}.x/p{i}") for i in range(300)], "page_id long, url string")
    listed = spark.createDataFrame([(f"h{i}.x/p{i}",) for i in range(0, 300, 3)], "url string")
    want = {i: "block" if i % 3 == 0 else "allow" for i in range(300)}
    for blocks in (1 << 16, 1):
        monkeypatch.setattr(urls, "blocks_for", lambda keys, n=blocks: n)
        assert {r.page_id: r.verdict for r in urls.judge(pages, [("allow", "no.such/")], listed).collect()} == want


def test_components_with_hubs(spark, monkeypatch):
    """Hubs that are broadcast change nothing."""
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(140)] + [(500, i) for i in range(501, 620)] + [(i, i + 1) for i in range(900, 920)] + [(1, 1), (900, 555)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    monkeypatch.setattr(components, "HUBS", 10)
    monkeypatch.setattr(components, "LEAST_ENDS", 3)
    want = {(x, find(x)) for x in root if find(x) != x}
    for parts in 1, 48:  # contracted at once, and in rounds
        got = {(r.node, r.root) for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(parts)).collect()}
        assert got == want
    a, b = components.forest(*np.array(edges).T)
    assert set(zip(a.tolist(), b.tolist())) == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("name,blanks", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_ids_of_odd_texts(name, blanks):
    """Random texts of letters whose case or composition changes, marks and blanks, against the library."""
    rng = random.Random(17)
    odd = ["İ", "ı", "ß", "ẞ", "Ǆ", "ﬁ", "é", "e\u0301", "\u0958", "\u0301", "\u0307", "Ω", "\u2126", "K", "ά", "ͅ", "\u0344", "\u037e", "שּׁ", "ç", "Ç", "L", "a", "B", "7", "²", "½", "漢", "🙂", "'s", "’t", "'LL", "_"]
    ends = [", ", ". ", ",", ".", " ", "  ", "\n", "!, ", "-", ",. ", " ,", "\t", "\u00a0"]
    texts = ["İ, a", "ÇİLİ, x"] + ["".join(rng.choice(ends if rng.random() < 0.4 else odd) for _ in range(rng.randrange(12))) for _ in range(12_000)]
    own, off = tokens.Coder(public_tokenizers.path(name), blanks).encode(pa.array(texts))
    t = Tokenizer.from_file(public_tokenizers.path(name))
    for text, a, b, e in zip(texts, off, off[1:], t.encode_batch(texts, add_special_tokens=False)):
        assert own[a:b].tolist() == e.ids, text


def test_battery_by_hand(spark):
    """Candidates' p-values, and the strings that are reported, computed afresh from the tests' definitions."""
    rng = random.Random(31)
    names = (string.ascii_letters + string.digits + "+/", string.digits + "abcdef", string.ascii_uppercase + "234567", string.digits + string.ascii_lowercase)
    texts = ["".join(rng.choice(a) for _ in range(rng.choice((20, 24, 31, 48, 90)))) for a in names for _ in range(60)]
    texts += ["ab12" * rng.choice((5, 9, 20)) for _ in range(20)] + ["a1" + "b" * 30, "A" * 25 + "1", "1a" * 12, "x" + "19" * 15]
    texts += ["user-name_" + "-".join(rng.choice(("alpha", "beta2", "gamma", "delta")) for _ in range(5)) for _ in range(80)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)

    def upper(z):
        return math.erfc(z / math.sqrt(2)) / 2

    def p_value(m):
        w = m.rstrip("=").replace("-", "+").replace("_", "/")
        alphabet = next(a for _, pattern, a in secrets.ALPHABETS if re.fullmatch(pattern, w))
        v = [alphabet.index(c) for c in (w if alphabet == secrets.ALPHABETS[-1][2] else w.lower())]
        n, size = len(v), len(alphabet)
        met = collections.Counter(v)
        chi = sum((met[i] - n / size) ** 2 / (n / size) for i in range(size))
        df = size - 1
        z_chi = ((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
        high = [2 * x >= size for x in v]
        k, runs = sum(high), 1 + sum(a != b for a, b in itertools.pairwise(high))
        mu = 2 * k * (n - k) / n + 1
        z_runs = 40 if mu <= 2 else (runs - mu) / math.sqrt((mu - 1) * (mu - 2) / (n - 1))
        mean = sum(v) / n
        var = sum((x - mean) ** 2 for x in v)
        z_serial = 40 if not var else math.sqrt(n) * sum((a - mean) * (b - mean) for a, b in itertools.pairwise(v)) / var
        p = min(1, upper(z_chi), 2 * upper(abs(z_runs)), 2 * upper(abs(z_serial)))
        return 1 - (1 - p) ** 3 if p >= 1e-6 else 3 * p

    want, edge = {}, 0
    base = re.compile(r"AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}")
    for i, t in enumerate(texts):
        bases = [m.span() for m in base.finditer(t)]
        for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}={0,2}", t):
            if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and not any(a < m.end() and m.start() < b for a, b in bases):
                want[i, m.start(), m.end()] = -10 * math.log10(max(p_value(m[0]), 1e-300))
    tested = secrets.candidates(rows).select("doc_id", F.inline("tested")).collect()
    got = {(r.doc_id, r.s, r.e): r.bin for r in tested}
    assert got.keys() == want.keys() and len(want) > 250
    for k, x in want.items():
        assert got[k] == min(secrets.BINS, math.floor(x)) or abs(x - round(x)) < 0.01, (texts[k[0]], got[k], x)
    assert all(r.len == math.floor(math.log2(r.e - r.s)) for r in tested)

    upto = {}
    for size in {r.len for r in tested}:
        bins = [r.bin for r in tested if r.len == size]
        sure = sum(b < secrets.SURE for b in bins)
        for b in sorted(set(bins)):
            reported = sum(x <= b for x in bins)
            drawn = sure * (1 - 10 ** (-(b + 1) / 10)) / (1 - 10 ** (-secrets.SURE / 10))
            if b >= secrets.SURE and reported - drawn <= secrets.RATE * reported:
                upto[size] = b
    most = {(r.doc_id, r.s, r.e) for r in tested if r.bin <= upto.get(r.len, secrets.SURE - 1)}
    spans = {(r.doc_id, *map(int, x.split(":")[1:])) for r in secrets.scan(rows).collect() for x in r.spans.split(",") if x.startswith("random:")}
    assert spans == most and 100 < len(spans) < len(tested)
