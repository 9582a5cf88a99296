"""Folding over all scripts against the library's normal forms."""

import re
import unicodedata

from pyspark.sql import functions as F

from spindrift.functions import text as T


def _fold(value):
    return "".join(c for c in unicodedata.normalize("NFKD", value.lower()) if not unicodedata.combining(c))


def test_every_letter_and_mixed_texts(spark):
    steady = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Lu", "Lt")]
    blocks = ["".join(steady[i : i + 997]) for i in range(0, len(steady), 997) if "".join(steady[i : i + 997]).lower() == "".join(steady[i : i + 997])]
    mixed = ["", "plain", "Ünïcode", "ﬁne ½ ＡＢＣ", "한국어 텍스트", "ÇİLİ Σίσυφος", "e\u0301\u0323", "\U000f0000 ﬁ \U000f0001é", "ﬃ" * 3000, "Ǆ ǅ ǆ ŉ", "a\nb ﷺ"]
    texts = [*mixed, *blocks]
    assert len(blocks) > 100
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "id long, text string")
    got = {r.id: r for r in df.select("id", T.accent_fold(F.col("text")).alias("f"), T.tokens(F.col("text")).alias("t"), T.slug(F.col("text")).alias("s")).collect()}
    assert got[-1].f is None and got[-1].t == [] and got[-1].s == "unknown"
    wrong = [t[:20] for i, t in enumerate(texts) if got[i].f != _fold(t)]
    assert not wrong
    for i, t in enumerate(texts):
        runs = re.findall("[a-z0-9]+", _fold(t))
        assert got[i].t == sorted({w for w in runs if len(w) > 2} - set(T.STOP_SEARCH))
        assert got[i].s == ("_".join(runs) or "unknown")
    assert "Python" not in df.select(T.accent_fold(F.col("text")))._jdf.queryExecution().executedPlan().toString()
