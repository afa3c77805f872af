"""Runs, merges and inter-pausal units against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from turnweave.operators import islands


def turns(spark, rows):
    return spark.createDataFrame([("d", i, s, t) for i, (s, t) in enumerate(rows)], "d string, turn int, speaker string, text string")


@pytest.mark.parametrize(
    "rows,want",
    [
        ([("A", "a"), ("A", "b"), ("B", "c"), ("A", "d")], ["a b", "c", "d"]),
        ([("A", "x")], ["x"]),
        ([("A", "x"), ("A", "y"), ("A", "z")], ["x y z"]),
        ([(None, "x"), (None, None), ("A", "")], ["x", ""]),
        ([], []),
    ],
)
def test_merge_turns(spark, rows, want):
    got = islands.merge_turns(turns(spark, rows), ["d"]).orderBy("turn").collect()
    assert [r["text"] for r in got] == want


def test_runs_across_buckets(spark):
    rnd = random.Random(3)
    rows = [(k, i, rnd.choice("ab")) for k in range(5) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, i int, v string")
    want = []
    for k in range(5):
        run = None
        for _, i, v in [r for r in rows if r[0] == k]:
            if run and run[1] == v:
                run[3] += 1
            else:
                run = [k, v, i, 1]
                want.append(run)
    for width in (1, 3, 50, 1000):
        got = islands.run_lengths(df, ["k"], ["i"], "v", F.floor(F.col("i") / width)).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)), width


def test_utterances_keep_the_last_end(spark):
    df = spark.createDataFrame([("f", 0, 0, 1.0, 9.0, "a"), ("f", 1, 0, 2.0, 3.0, "b"), ("f", 2, 1, 4.0, 5.0, "c")], "file string, n int, ch int, start double, end double, text string")
    got = islands.merge_utterances(df, ["file"], "n", "ch").orderBy("n").collect()
    assert [(r["start"], r["end"], r["text"]) for r in got] == [(1.0, 3.0, "a b"), (4.0, 5.0, "c")]


def test_word_gaps(spark):
    words = [(0.0, 1.0), (1.04, 2.0), (2.06, 3.0), (2.5, 2.7), (2.76, 4.0)]
    df = spark.createDataFrame([("u", i, a, b) for i, (a, b) in enumerate(words)], "u string, i int, start double, end double")
    got = islands.word_gap_segments(df, ["u"], "i").orderBy("start").collect()
    assert [(r["start"], r["end"]) for r in got] == [(0.0, 2.0), (2.06, 2.7), (2.76, 4.0)]


def by_frames(spans, n, pause, least, duration, context):
    x = [0] * n
    for a, b in spans:
        x[a:b] = [1] * (min(b, n) - a)

    def runs(x):
        out = []
        for i, v in enumerate(x):
            if out and out[-1][2] == v:
                out[-1][1] = i + 1
            else:
                out.append([i, i + 1, v])
        return out

    for a, b, v in runs(x):
        if v == 0 and b - a < pause:
            x[a:b] = [1] * (b - a)
    return sorted(b for a, b, v in runs(x) if v and b - a >= least and (context <= 0 or b >= context) and b < n - (duration - context))


def test_ipu_ends(spark):
    rnd = random.Random(5)
    rows, want = [], []
    for k in range(400):
        n, spans = rnd.randint(1, 40), []
        for _ in range(rnd.randint(0, 5)):
            a = rnd.randint(0, n)
            spans.append((a, min(n, a + rnd.randint(0, 9))))
        rows += [(k, 0, a, b, n) for a, b in spans] or [(k, 0, 0, 0, n)]
        want += [(k, e) for e in by_frames(spans, n, 4, 3, 10, 6)]
    df = spark.createDataFrame(rows, "k int, ch int, sf int, ef int, total int")
    got = islands.ipu_ends(df, ["k"], "ch", "sf", "ef", "total", 4, 3, 10, 6).collect()
    assert sorted((r["k"], r["ef"]) for r in got) == sorted(want)
    assert want


def test_null_keys_are_a_group(spark):
    rows = [(k, i, float(i), i + 0.9) for k in (None, 1) for i in range(9) if i != 4]
    df = spark.createDataFrame(rows, "k int, i int, start double, end double")
    got = islands.word_gap_segments(df, ["k"], "i", min_gap=0.5, bucket=F.floor(F.col("i") / 3))
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame([(k, a, b) for k in (None, 1) for a, b in ((0.0, 3.9), (5.0, 8.9))], "k int, start double, end double").collect()))
    f = spark.createDataFrame([(None, 0, 2, 5, 30), (None, 0, 7, 9, 30), (None, 0, 20, 25, 30)], "k int, ch int, sf int, ef int, total int")
    assert [(r["sf"], r["ef"]) for r in islands.ipu_units(f, ["k"], "ch", "sf", "ef", "total", 4).orderBy("sf").collect()] == [(0, 9), (20, 25)]
