"""Frames, histories and clips against loops in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from turnweave.functions import timing as M
from turnweave.operators import vad as V
from turnweave.operators import windows as W
from turnweave.plans import registry
from turnweave.plans.dialog_audio import DialogAudio


def test_truncation(spark):
    got = spark.createDataFrame([(0.29,), (1.15,), (8.0,), (-0.5,)], "t double").select(M.time_to_frames(F.col("t"), 0.01)).collect()
    assert [r[0] for r in got] == [28, 114, 800, -50]


@pytest.mark.parametrize("duration,n", [(9.9, 0), (10.0, 1), (17.999, 1), (18.0, 2), (26.0, 3), (1.0, 0), (0.0, 0)])
def test_sliding(spark, duration, n):
    got = W.sliding_clips(spark.createDataFrame([("s", duration)], "s string, duration double"), ["s"]).orderBy("clip").collect()
    assert [(r["start"], r["end"]) for r in got] == [(8.0 * i, 8.0 * i + 10) for i in range(n)]


def test_sliding_with_much_overlap(spark):
    df = spark.createDataFrame([("s", 8.0)], "s string, duration double")
    assert W.sliding_clips(df, ["s"], clip=10.0, overlap=9.0).count() == 0
    with pytest.raises(ValueError):
        W.sliding_clips(df, ["s"], clip=10.0, overlap=10.0)


def signal(rnd, n):
    return [[(a, min(n, a + rnd.randint(0, 8))) for a in (rnd.randint(0, n) for _ in range(4))] for _ in (0, 1)]


def test_one_hot_windows_history(spark):
    rnd = random.Random(2)
    rows, hot = [], {}
    for s in range(6):
        n = rnd.randint(5, 60)
        spans = signal(rnd, n)
        rows += [(s, c, a, b, n) for c in (0, 1) for a, b in spans[c]]
        hot[s] = [[int(any(a <= f < b for a, b in spans[c])) for c in (0, 1)] for f in range(n)]
    df = spark.createDataFrame(rows, "s int, channel int, sf int, ef int, total int")
    total = df.groupBy("s").agg(F.max("total").alias("total"))
    one = V.one_hot(df, total, ["s"])
    got = {(r["s"], r["frame"]): [r["v0"], r["v1"]] for r in one.collect()}
    assert got == {(s, f): v for s, x in hot.items() for f, v in enumerate(x)}

    edges = [10, 4, 1]
    for r in V.activity_history(df, total, ["s"], edges).collect():
        for i, (far, near) in enumerate(zip([None, *edges], [*edges, 0])):
            lo = 0 if far is None else max(0, r["frame"] - far + 1)
            part = hot[r["s"]][lo : max(r["frame"] - near + 1, 0)]
            a, b = (sum(x[c] for x in part) for c in (0, 1))
            assert abs(r[f"h{i}"] - (a / (a + b) if a + b else 0.5)) < 1e-12

    clips = spark.createDataFrame([(s, 0, len(x) - 3, len(x) + 2) for s, x in hot.items()], "s int, clip int, start_frame int, end_frame int")
    for r in V.clip_windows(clips, V.blocks(df, ["s"]), ["s"], 2).collect():
        x, f = hot[r["s"]], len(hot[r["s"]]) - 3 + r["offset"]
        assert [r["v0"], r["v1"]] == (x[f] if f < len(x) else [0, 0])
    assert V.flip(one).where("s = 0 and frame = 0").collect()[0]["v0"] == hot[0][0][1]


def test_dialog_audio(spark):
    ses = spark.createDataFrame([("a", 20.0), ("b", 3.0)], "session string, duration double")
    seg = spark.createDataFrame([("a", 0, 0.5, 4.0), ("a", 1, 5.0, 12.0), ("b", 0, 0.0, 1.0)], "session string, channel int, start double, end double")
    wav = spark.createDataFrame([("a", 10, [[float(i) for i in range(200)], [0.0] * 200])], "session string, sample_rate int, waveform array<array<double>>")
    flow = DialogAudio(hz=10, history_times=[5.0, 1.0])
    got = flow.samples(ses, seg, wav).orderBy("clip").collect()
    assert [(r["session"], r["clip"], r["start"]) for r in got] == [("a", 0, 0.0), ("a", 1, 8.0)]
    assert [len(r["vad"]) for r in got] == [120, 120] and [len(r["history"]) for r in got] == [100, 100]
    assert got[0]["vad"][10] == [1, 0] and got[0]["vad"][60] == [0, 1] and got[1]["vad"][100:] == [[0, 0]] * 20
    assert got[1]["waveform"][0][0] == 80.0 and len(got[1]["waveform"][0]) == 100
    flipped = DialogAudio(hz=10, flip_share=1.0, history_times=[5.0]).samples(ses, seg, wav, train=True).where("clip = 0").collect()[0]
    assert flipped["vad"][10] == [0, 1] and flipped["waveform"][1][5] == 5.0
    ipu = DialogAudio(kind="ipu", hz=10, duration=10.0, context=4.0, pause=0.5, least=0.5).clips(ses, seg).collect()
    assert [(round(r["start"], 6), round(r["end"], 6)) for r in ipu] == [(0.0, 10.0), (8.0, 18.0)]
    whole = {r["session"]: r for r in flow.dialogs(ses, seg, wav, flip=True).collect()}
    assert set(whole) == {"a"} and len(whole["a"]["vad"]) == 220 and whole["a"]["vad"][10] == [0, 1] and whole["a"]["waveform"][1][5] == 5.0
    assert len(flow.dialogs(ses, seg).where("session = 'b'").first()["history"]) == 30


def test_response_offsets(spark):
    off, n = W.response_offsets(F.col("t"), 10, 5.0)
    got = spark.createDataFrame([(1.0,), (5.0,), (7.5,)], "t double").select(off, n).collect()
    assert [tuple(r) for r in got] == [(0, 10), (0, 50), (25, 50)]


def broadcast_arrays(df):
    """The nodes that make arrays below a broadcast, in the plan before it runs and as it ran."""
    found = []
    for _ in range(2):
        above = None
        for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
            depth = len(line) - len(line.lstrip(" :+-*"))
            above = None if above is not None and depth <= above else above
            above = depth if above is None and "BroadcastExchange" in line else above
            found += [line.strip()] * (above is not None and "MapInArrow" in line)
        df.collect()
    return found


def small_reels(spark, tmp_path):
    """A table whose file is far below the threshold of broadcasts."""
    rows = [(i, "sw", i, "s", [[[float(t), t + 0.5] for t in range(j, 120, 3)] for j in (0, 1)]) for i in range(3)]
    spark.createDataFrame(rows, "list_id long, session string, reel int, time_unit string, vad array<array<array<double>>>").write.parquet(str(tmp_path / "vad_lists.parquet"))
    return str(tmp_path)


def test_clip_windows_broadcast_no_arrays(spark, tmp_path):
    assert not broadcast_arrays(registry.queries()["reel_clip_vad_window"](spark, small_reels(spark, tmp_path)))


def test_response_counts_equal_arrays(spark):
    rnd = random.Random(4)
    f = spark.createDataFrame([(k, c, a, a + rnd.randint(0, 40), 5000) for k in ("a", "b") for c in (0, 1) for a in (rnd.randint(0, 4900) for _ in range(60))], "s string, channel int, sf int, ef int, total int")
    r = f.select("s", F.concat_ws("-", "channel", "sf").alias("response"), F.col("channel").alias("speaker"), F.col("sf").alias("frame")).distinct()
    r = r.unionByName(spark.createDataFrame([("a", "early", 0, 3), ("b", "late", 1, 9000), ("c", "none", 0, 50)], r.schema))
    b = V.blocks(f, ["s"])
    for frames, ahead in ((800, 200), (3000, 0), (5, 2)):
        want = {(x["s"], x["response"]): (sum(x["own"]), sum(x["other"]), len(x["own"])) for x in V.response_arrays(r, b, ["s"], frames, ahead).collect()}
        got = {(x["s"], x["response"]): (x["own"], x["other"], x["frames"]) for x in V.response_counts(r, b, ["s"], frames, ahead).collect()}
        assert got == want and len(want) == r.count()


def test_response_windows_broadcast_no_arrays(spark, tmp_path):
    assert not broadcast_arrays(registry.queries()["reel_response_window"](spark, small_reels(spark, tmp_path)))


def test_samples_broadcast_no_arrays(spark, tmp_path):
    assert not broadcast_arrays(registry.queries()["reel_dialog_audio_samples"](spark, small_reels(spark, tmp_path)))


def test_clip_histories_equal_slices(spark):
    rnd = random.Random(6)
    f = spark.createDataFrame([(k, c, a, min(a + rnd.randint(0, 90), n), n) for k, n in (("a", 5000), ("b", 2048), ("c", 700)) for c in (0, 1) for a in (rnd.randint(0, n - 1) for _ in range(50))], "s string, channel int, sf int, ef int, total int")
    total = f.groupBy("s").agg(F.max("total").alias("total"))
    starts = [(k, i, a) for k in ("a", "b", "c") for i, a in enumerate([-30, 0, 1, 699, 1000, 2047, 2048, 4900, 9000] * 9)]
    clips = spark.createDataFrame([(k, i, a + i // 9) for k, i, a in starts], "s string, clip int, start_frame int")
    blocks = V.blocks(f, ["s"], total)
    for edges, n, ahead in (([3000, 1000, 7], 1000, 200), ([40], 2500, 0)):
        hs = [f"h{i}" for i in range(len(edges) + 1)]
        c = clips.withColumn("end_frame", F.col("start_frame") + n + ahead)
        fill = {"v0": F.lit(0), "v1": F.lit(0)} | {h: F.lit(0.5) for h in hs}
        want = {(r["s"], r["clip"]): r for r in V.slices(c, V.history_blocks(blocks, ["s"], edges), ["s"], fill).collect()}
        got = V.clip_histories(clips, blocks, ["s"], edges, n, ahead).collect()
        assert len(got) == len(want) == len(starts)
        for r in got:
            w = want[r["s"], r["clip"]]
            assert r["vad"] == [list(x) for x in zip(w["v0"], w["v1"])]
            assert r["history"] == [list(x) for x in zip(*(w[h][:n] for h in hs))]
