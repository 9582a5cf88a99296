"""Streaming counters: totals over restarts, replays, and windows of event time."""

import datetime as dt

from pyspark.sql import functions as F

from spindrift.plans import fixtures as fx
from spindrift.plans.engine import Engine, Symbolic, Verify
from spindrift.streaming.counters import Counters, counters, windows

SCHEMA = "id long, at timestamp, kind string, v double, kind2 string"


def _rows(spark, rows):
    day = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, None if m is None else day + dt.timedelta(minutes=m), k, v, "x") for i, m, k, v in rows], SCHEMA)


def _got(df):
    return {(r.kind, r.n, r.total, r.last_id) for r in df.collect()}


def test_totals_go_on_after_a_restart(spark, tmp_path):
    first = [(1, 5, "a", 1.0), (2, 5, "a", 2.0), (3, 1, "b", None), (4, None, None, 1.0), (1, 5, "a", 1.0)]
    _rows(spark, first).write.parquet(f"{tmp_path}/in/one")
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/*")
    kept = Counters(spark, f"{tmp_path}/kept")
    assert kept.totals().count() == 0
    run = lambda: Counters(spark, f"{tmp_path}/kept").follow(stream(), f"{tmp_path}/cp", "kind", "at", "id", "v").awaitTermination()
    run()
    assert _got(kept.totals()) == {("a", 3, 4.0, 2), ("b", 1, 0.0, 3), (None, 1, 1.0, None)}
    version = kept.last_batch()
    run()
    assert kept.last_batch() == version and _got(kept.totals()) == {("a", 3, 4.0, 2), ("b", 1, 0.0, 3), (None, 1, 1.0, None)}  # nothing new, nothing twice
    second = [(9, 2, "a", 5.0), (7, 0, "c", 1.0)]  # older than what came before: counted, not the last
    _rows(spark, second).write.parquet(f"{tmp_path}/in/two")
    run()
    assert _got(kept.totals()) == {("a", 4, 9.0, 2), ("b", 1, 0.0, 3), ("c", 1, 1.0, 7), (None, 1, 1.0, None)}
    assert _got(kept.totals()) == _got(counters(_rows(spark, first + second), "kind", "at", "id", "v"))


def test_a_batch_is_added_once(spark, tmp_path):
    kept = Counters(spark, f"{tmp_path}/kept")
    one = counters(_rows(spark, [(1, 1, "a", 1.0)]), "kind", "at", "id", "v")
    for batch in (0, 0, 1, 0):
        kept.add(one, batch)
    assert _got(kept.totals()) == {("a", 2, 2.0, 1)}
    kept.add(counters(_rows(spark, []), "kind", "at", "id", "v"), 2)
    assert _got(kept.totals()) == {("a", 2, 2.0, 1)}


def test_windows_close_behind_the_watermark(spark, tmp_path):
    out, seen = [], f"{tmp_path}/in"
    told = windows(spark.readStream.schema(SCHEMA).parquet(f"{seen}/*"), "kind", "at", "id", "v", "10 minutes", "5 minutes")
    add = lambda rows, _: out.extend((r.start.minute, r.kind, r.n, r.total, r.last_id) for r in rows.withColumn("start", F.col("start")).collect())
    for name, rows in (("one", [(1, 1, "a", 1.0), (2, 9, "a", 2.0), (3, None, "a", 9.0), (4, 12, "b", 4.0)]), ("two", [(5, 3, "a", 1.0), (6, 26, "b", 1.0)]), ("three", [(7, 2, "a", 1.0), (8, 27, "b", 1.0)])):
        _rows(spark, rows).coalesce(1).write.parquet(f"{seen}/{name}")
        told.writeStream.outputMode("append").foreachBatch(add).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    # 5 came late, but before its window was given; 7 came after; the window of 26 and 27 is open
    assert sorted(out) == [(0, "a", 3, 4.0, 2), (10, "b", 1, 4.0, 4)]
    batch = windows(_rows(spark, [(1, 1, "a", 1.0), (2, 9, "a", 2.0), (3, None, "a", 9.0)]), "kind", "at", "id", "v", "10 minutes", "5 minutes")
    assert _got(batch) == {("a", 2, 3.0, 2)}


def test_engine_adds_its_counters_up(spark, tmp_path):
    schema = "query_id long, text string"
    kept = Counters(spark, f"{tmp_path}/kept")

    def failing(rows, batch):
        raise OSError("the sink is gone")

    run = lambda sink: Engine().register(Verify()).process_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/q/*"), sink, f"{tmp_path}/cp", kept=kept)
    fx.questions(spark).coalesce(1).write.parquet(f"{tmp_path}/q/one")
    try:
        run(failing).awaitTermination()
        raise AssertionError("the sink's failure must show")
    except Exception as e:
        assert "the sink is gone" in str(e)
    n = len(fx.QUESTIONS)
    assert kept.totals().agg(F.sum("n")).first()[0] == n  # counted though the sink failed
    run(lambda rows, batch: None).awaitTermination()  # the same batch again
    assert kept.totals().agg(F.sum("n")).first()[0] == n
    fx.questions(spark).coalesce(1).write.parquet(f"{tmp_path}/q/two")
    run(lambda rows, batch: None).awaitTermination()
    assert kept.totals().agg(F.sum("n")).first()[0] == 2 * n


def test_a_graph_that_cannot_be_read_is_remembered(spark, tmp_path):
    path = f"{tmp_path}/none"
    assert Symbolic.lazy(spark, path) is None and path in Symbolic.failed and Symbolic.lazy(spark, path) is None
    Symbolic.forget(path)
    assert path not in Symbolic.failed
