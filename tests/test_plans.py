"""Batches, encoding, streaming, joins, and every query against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from turnweave.operators import dialog, joins
from turnweave.plans import batch, dialog_text, registry
from turnweave.runtime import cut, hot_keys, lookup
from turnweave.streaming import clips as streaming

DATA = os.environ.get("TURNWEAVE_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    plain = lambda x: None if x is None or x is pd.NA or x != x else round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted(([plain(x.item() if hasattr(x, "item") and not hasattr(x, "__len__") else x) for x in r] for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, DATA).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns)
        return
    want = duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_plans_have_no_nested_loops(spark, duck):
    for name in ("merge_consecutive_turns", "clip_vad_window", "activity_history", "ipu_ends", "utterance_word_join", "p3_found"):
        plan = registry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_batches(spark):
    df = spark.createDataFrame([(i, list(range(i)), [0] * i) for i in range(1, 8)], "id int, input_ids array<int>, speaker_ids array<int>")
    got = batch.text_batches(df, ["id"], 3, 4).orderBy("batch_id").collect()
    assert [r["length"] for r in got] == [[1, 2, 3], [4, 4, 4], [4]]
    assert got[0]["input_ids"] == [[0, 0, 0], [0, 1, 0], [0, 1, 2]]
    sp = spark.createDataFrame([("a", [1.0], [2.0, 3.0]), ("b", [1.0, 2.0], [])], "id string, waveform array<double>, f0 array<double>")
    r = batch.speech_batches(sp, ["id"], 2, ("waveform", "f0")).first()
    assert r["waveform"] == [[1.0, 0.0], [1.0, 2.0]] and r["f0"] == [[2.0, 3.0], [0.0, 0.0]] and r["f0_length"] == [2, 0]
    c = spark.createDataFrame([(1, "hold", [1, 2, 3], [0.5])], "id int, label string, input_ids array<int>, waveform array<double>")
    r = batch.classification_batches(c, ["id"], 2, 2, 3).first()
    assert (r["label"], r["input_ids"], r["waveform"]) == ([2], [[2, 3]], [[0.0, 0.0, 0.5]])
    assert [r["batch_id"] for r in batch.iterate(batch.collate(batch.number_batches(spark.range(7), ["id"], 2), ["id"]))] == [0, 1, 2, 3]
    assert sorted(r["id"] for r in batch.shuffle(spark.range(9), F.col("id")).collect()) == list(range(9))


def test_encode(spark, tmp_path):
    df = spark.createDataFrame([(["a b", "c"], "train"), (["", "x"], "train"), ([], "test")], "dialog array<string>, split string")
    e = dialog_text.encode(df, lambda t: [len(w) for w in t.split()]).collect()
    assert e[0]["input_ids"] == [1, 1, 1] and e[0]["speaker_ids"] == [0, 0, 1]
    assert dialog.keep_full(df).count() == 2
    p = dialog_text.prepare(spark, {"daily_dialog": df}, ["daily_dialog"], str(tmp_path / "t"))
    assert p.count() == 2 and set(p.columns) == {"dialog", "dataset_name", "input_ids", "speaker_ids", "split"}


def test_joins(spark):
    a = spark.createDataFrame([("x",), ("y",), (None,)], "k string")
    b = spark.createDataFrame([("x",), ("x",)], "k string")
    assert [r["k"] for r in joins.only(a, b, "k").collect()] == ["x"]
    assert {r["k"] for r in joins.without(a, b, "k").collect()} == {"y", None}
    m = joins.long_means(spark.createDataFrame([("s", [1.0, 2.0])], "session string, means array<double>")).collect()
    assert [tuple(r) for r in m] == [("s", 0, 1.0), ("s", 1, 2.0)]


def test_salted_lookup(spark):
    big = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"), "id").unionByName(spark.createDataFrame([(None, -1)], "k long, id long"))
    small = spark.range(0, 5000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).unionByName(spark.createDataFrame([(1, 99)], "k long, v long"))
    assert [r["k"] for r in hot_keys(big, "k").collect()] == [1]
    got, want = lookup(big, small, "k"), big.join(small, "k", "left")
    assert sorted(map(str, got.select("k", "id", "v").collect())) == sorted(map(str, want.select("k", "id", "v").collect()))
    assert cut(spark.createDataFrame([], "a int, b array<string>")).schema.names == ["a", "b"]


def test_streaming(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("s", 0, 1.0), ("s", 1, 2.0), ("s", 30, 4.0)], "k string, t int, sec double").select("k", F.timestamp_seconds("t").alias("ts"), "sec").write.parquet(src)
    stream = spark.readStream.schema("k string, ts timestamp, sec double").parquet(src)
    for i, df in enumerate((streaming.sliding_activity(stream, "ts", "sec", ["k"]), streaming.units(stream, "ts", ["k"], "2 seconds"))):
        q = df.writeStream.format("memory").queryName(f"q{i}").outputMode("complete" if i == 0 else "append").trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert spark.table("q0").agg(F.max("speech")).first()[0] == 4.0
