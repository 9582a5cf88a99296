"""Order statistics by narrowing brackets, and what is built on them."""

import hashlib
import random
import statistics

from pyspark.sql import functions as F

from spindrift.operators import metrics, selection


def rows(spark):
    rng = random.Random(4)
    own = [("same", 7.0)] * 3000 + [("same", 9.0), ("same", -1.0)]  # one value fills nearly all
    own += [("wide", rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300)) for _ in range(2501)]
    own += [(None, float(rng.randrange(50))) for _ in range(900)] + [("one", 3.5), ("none", None), ("two", 1.0), ("two", 2.0)]
    rng.shuffle(own)
    return own, spark.createDataFrame(own, "key string, v double").repartition(5)


def test_selected_places(spark):
    own, table = rows(spark)
    names = {"first": lambda n: F.lit(0), "last": lambda n: n - 1, "p90": lambda n: F.rint(0.9 * (n - 1))}
    got = {(r.k, r.place): (r.n, r.value) for r in selection.selected(table, "v", names, "key").collect()}
    want = {}
    for k in {k for k, v in own if v is not None}:
        x = sorted(v for n, v in own if n == k and v is not None)
        for name, at in (("first", 0), ("last", len(x) - 1), ("p90", round(0.9 * (len(x) - 1)))):
            want[k, name] = (len(x), x[at])
    assert got == want
    assert selection.selected(table.limit(0), "v", names, "key").count() == 0
    assert {r.k: r.median for r in selection.median(table, "v", "key").collect()} == {k: statistics.median(v for n, v in own if n == k and v is not None) for k, _ in want}
    whole = sorted(v for _, v in own if v is not None)
    assert [r.value for r in metrics.nearest_rank(table, "v", [0.5]).collect()] == [whole[round(0.5 * (len(whole) - 1))]]
    plan = metrics.nearest_rank(table, "v", [0.5], "key")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_split_of_one_large_class(spark):
    own = [(i, "big") for i in range(4000)] + [(9000 + i, "small") for i in range(3)] + [(9500, None)] + [(5, "big")] * 3
    got = metrics.stratified_split(spark.createDataFrame(own, "id long, label string"), "label", "id", 0.2)
    found = sorted((r.label or "", r.id, r.split) for r in got.collect())
    want = []
    for label in {c for _, c in own}:
        ids = sorted((hashlib.md5(f"42:{i}".encode()).hexdigest(), i) for i, c in own if c == label)
        n = max(1, round(len(ids) * 0.2))
        want += [(label or "", i, "val" if at < n else "train") for at, (_, i) in enumerate(ids)]
    assert found == sorted(want)
