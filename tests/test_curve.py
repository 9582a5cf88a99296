"""The recall curve against searches with each number of probes."""

from pyspark.sql import functions as F

from spindrift.operators import metrics, search, shards

SF = "/root/testdata/sf0.01"


def test_curve_equals_searches(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    asked = rows.filter("vec_id % 25 = 0")
    index = shards.Ivf.build(rows.filter("vec_id % 3 <> 0"), cells=8).save(f"{tmp_path}/ivf")
    index = index.extend(rows.filter("vec_id % 3 = 0")).split(90)
    curve = {r.probes: (r.recall, r.read) for r in index.curve(asked, 5).collect()}
    assert sorted(curve) == list(range(1, index.open_cells + 1)) and curve[index.open_cells] == (1.0, 1.0)
    exact = search.topk(rows, asked, 5)
    some = [1, 2, index.open_cells // 2]
    direct = {r.setting: r.recall for r in metrics.sweep(exact, lambda n: index.search(asked, 5, n), some).collect()}
    assert all(abs(direct[n] - curve[n][0]) < 1e-5 for n in some)
    assert [curve[n] for n in sorted(curve)] == sorted(curve.values())


def test_curve_of_nothing(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    index = shards.Ivf.by_key(rows, "label")
    assert index.curve(rows.limit(0), 5).count() == 0
    lone = rows.withColumn("label", F.lit(None).cast("int"))
    assert shards.Ivf.by_key(lone.withColumn("label", F.when(F.col("vec_id") < 9, 1)), "label").assigned.count() == 9
