"""Queries that do the whole job: nothing is left out before the operators see it."""

import numpy as np

from turnweave.functions import features as N
from turnweave.plans import registry


def run(spark, name, path):
    return registry.queries()[name](spark, str(path))


def test_every_path_is_joined(spark, tmp_path):
    rec = [(1, "sw/audio/00001/sw0000001_0.sph"), (1, "sw/audio/00001/sw0000001_0.sph"), (2, "reels/d4e9.wav"), (3, "fe_0000002_1.wav"), (4, None)]
    spark.createDataFrame(rec, "rec_id long, audio_path string").write.parquet(str(tmp_path / "recordings.parquet"))
    t = [(i, s, r, i, "A:", 0.0, 1.0, "hi", None, None) for i, (s, r) in enumerate([("sw0000001", 0), ("sw0000001", 0), ("fe_0000002", 1), ("fe_0000002", 0)])]
    schema = "line_id long, session string, reel int, line_no int, speaker string, start double, end double, text string, words array<string>, loaded_at timestamp"
    spark.createDataFrame(t, schema).write.parquet(str(tmp_path / "transcripts.parquet"))
    got = sorted((r["rec_id"], r["session"], r["lines"]) for r in run(spark, "left_transcript_join", tmp_path).collect())
    assert got == [(1, "sw0000001", 2), (2, None, None), (3, "fe_0000002", 1)]


def test_every_channel_has_features(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = {(1, 0): rng.standard_normal(300), (1, 1): rng.standard_normal(250), (2, 0): rng.standard_normal(120), (3, 0): rng.standard_normal(1), (4, 1): rng.standard_normal(210)}
    x = {k: v.astype("float32").astype(float) for k, v in x.items()}
    clips = [(1, [x[1, 0].tolist(), x[1, 1].tolist()]), (1, [x[1, 0].tolist(), x[1, 1].tolist()]), (2, [x[2, 0].tolist()]), (3, [x[3, 0].tolist()]), (4, [[], x[4, 1].tolist()]), (5, None), (6, [])]
    spark.createDataFrame(clips, "clip_id long, waveform array<array<float>>").write.parquet(str(tmp_path / "clips.parquet"))
    want = {"lpc": lambda v: N.lpc(v, 2, 40, 20), "mfcc": lambda v: N.mfcc(v, 100, 64, 32), "prosody": lambda v: N.prosody(v, 800), "bandpass": lambda v: N.bandpass(v, 4000), "resample": lambda v: N.resample(v, 100, 80)}
    want |= {"nlfer": lambda v: N.nlfer(N.magnitude(v, 70, 20, 256), 2000, 256), "shc": lambda v: N.shc(N.magnitude(v, 70, 20, 256), 2000, 256), "nccf": lambda v: N.nccf(v, 2000, 70, 20)}
    for name, f in want.items():
        got = {(r["clip_id"], r["channel"], r["frame"], r["i"] if "i" in r else 0): np.nan if r["v"] is None else r["v"] for r in run(spark, name, tmp_path).collect()}
        full = {(*k, i, j): y for k, w in x.items() for i, v in enumerate(f(w)) for j, y in enumerate(np.atleast_1d(v))}
        assert got.keys() == full.keys() and {k[:2] for k in got} == x.keys(), name
        assert np.allclose([got[k] for k in full], list(full.values()), atol=1e-6, equal_nan=True), name
    got = {(r["clip_id"], r["channel"]): r for r in run(spark, "peak_normalize", tmp_path).collect()}
    assert {k for k, r in got.items() if r["n"]} == x.keys() and (got[4, 0]["n"], got[4, 0]["peak"]) == (0, None)
    assert all(abs(got[k]["peak"] - np.abs(v).max()) < 1e-5 for k, v in x.items())
    for name in ("zero_crossings", "time_slice"):
        assert {(r["clip_id"], r["channel"]) for r in run(spark, name, tmp_path).collect()} == got.keys()


def test_reels_at_the_flows_rate(spark, tmp_path):
    """Frame queries on vad_lists at 100 Hz against loops over plain arrays."""
    rng = np.random.default_rng(5)
    segs = {}
    for r in range(2):
        at = [np.sort(rng.integers(0, 900, 40)) / 10 for _ in range(2)]
        segs[f"sw/{r}"] = [[[float(a), round(float(a) + 0.05 * (1 + k % 60), 2)] for k, a in enumerate(ch)] for ch in at]
    segs["sw/0"][0].append([91.0, 91.01])  # one frame of 0.01 s
    rows = [(i, "sw", int(k[3:]), "s", v) for i, (k, v) in enumerate(segs.items())]
    spark.createDataFrame(rows, "list_id long, session string, reel int, time_unit string, vad array<array<array<double>>>").write.parquet(str(tmp_path / "vad_lists.parquet"))
    hot, units, starts = {}, set(), {}
    for k, chs in segs.items():
        dur = max(e for ch in chs for _, e in ch)
        n = int(dur / 0.01)
        v = np.zeros((n, 2), int)
        starts[k] = set()
        for c, ch in enumerate(chs):
            for a, b in ch:
                v[min(int(a / 0.01), n) : min(int(b / 0.01), n), c] = 1
                starts[k].add((c, min(int(a / 0.01), n)))
            w = v[:, c].copy()
            edge = [0, *(np.flatnonzero(np.diff(w)) + 1), n]
            for a, b in zip(edge, edge[1:]):
                if w[a] == 0 and b - a < 20:
                    w[a:b] = 1
            edge = [0, *(np.flatnonzero(np.diff(w)) + 1), n]
            units |= {(k, c, int(b)) for a, b in zip(edge, edge[1:]) if w[a] and b - a >= 100 and b >= 800 and b < n - 200}
        hot[k] = (v, dur)

    def part(v, far, near):
        a = v[max(far, 0) : max(near, 0)].sum(axis=0)
        return a[0] / a.sum() if a.sum() else 0.5

    def history(v, t):
        e = t + 1
        return [part(v, a, b) for a, b in ((0, e - 6000), (e - 6000, e - 3000), (e - 3000, e - 1000), (e - 1000, e - 500), (e - 500, e))]

    got = {(r["session"], r["frame"]): (r["v0"], r["v1"]) for r in run(spark, "reel_vad_onehot", tmp_path).collect()}
    assert got == {(k, t): tuple(x) for k, (v, _) in hot.items() for t, x in enumerate(v.tolist())}
    assert {(r["session"], r["frame"]): (r["v1"], r["v0"]) for r in run(spark, "reel_channel_flip", tmp_path).collect()} == got
    assert {tuple(r) for r in run(spark, "reel_ipu_ends", tmp_path).collect()} == units and units
    assert {(r["session"], r["channel"], r["start_frame"] + 800, r["end_frame"] - 200) for r in run(spark, "reel_ipu_clips", tmp_path).collect()} == {(*u, u[2]) for u in units}
    clips = {(k, i): i * 800 for k, (_, dur) in hot.items() for i in range(int((dur - 10) / 8 + 1))}
    padded = {k: np.concatenate((v, np.zeros((2000, 2), int))) for k, (v, _) in hot.items()}
    got = {(r["session"], r["clip"], r["offset"]): [r["v0"], r["v1"]] for r in run(spark, "reel_clip_vad_window", tmp_path).collect()}
    assert got == {(*k, o): padded[k[0]][a + o].tolist() for k, a in clips.items() for o in range(1200)}
    h = {(r["session"], r["frame"]): [r[f"h{i}"] for i in range(5)] for r in run(spark, "reel_activity_history", tmp_path).collect()}
    assert len(h) == sum(len(v) for v, _ in hot.values())
    assert all(np.allclose(h[k, t], history(v, t), atol=1e-6) for k, (v, _) in hot.items() for t in range(0, len(v), 7))
    got = {(r["session"], r["response"]): (r["own"], r["other"], r["frames"]) for r in run(spark, "reel_response_window", tmp_path).collect()}
    want = {(k, f"{c}-{t}"): (*(padded[k][max(t - 800, 0) : t + 200, x].sum() for x in (c, 1 - c)), 1000) for k in hot for c, t in starts[k]}
    assert got == want
    for r in run(spark, "reel_dialog_audio_samples", tmp_path).collect():
        a = clips.pop((r["session"], r["clip"]))
        v = hot[r["session"]][0]
        assert r["vad"] == padded[r["session"]][a : a + 1200].tolist() and len(r["history"]) == 1000
        assert all(np.allclose(r["history"][t], history(v, a + t), atol=1e-6) for t in range(0, 1000, 13) if a + t < len(v))
    assert not clips
