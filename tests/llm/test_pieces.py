"""Problem 2 against a search over all ways to cut."""

import random
from functools import lru_cache

import numpy as np
import pytest

from turnweave.llm import pieces as P

CLIP = "clip_id long, dataset_name string, sample_rate int, vad array<array<array<double>>>, loaded_at timestamp, waveform array<array<float>>, piece int, kind string"
LIMIT = "dataset_name string, max_seconds double, overlap_seconds double, default_rate int"


def can_pause(pause, n, most, overlap):
    """Whether any cutting through pauses exists, by trying all."""

    @lru_cache(None)
    def ok(last):
        start = 0 if last == 0 else last - overlap
        if n - start <= most:
            return True
        return any(pause[c] and ok(c) for c in range(max(last + 1, overlap), min(start + most, n) + 1))

    return ok(0)


def test_greedy_finds_a_way():
    rnd = random.Random(1)
    seen = set()
    for _ in range(600):
        n, most, overlap = rnd.randint(1, 60), rnd.randint(5, 15), rnd.randint(0, 4)
        s = np.array([P.LOUD_LEVELS + 1 if rnd.random() < 0.25 else rnd.randint(0, 9) for _ in range(n + 1)], np.uint8)
        out, paused = P.cut_points(s, most, overlap)
        assert paused == can_pause(tuple(s > P.LOUD_LEVELS), n, most, overlap)
        assert out[0][0] == 0 and out[-1][1] == n and all(0 < e - b <= most for b, e, _ in out)
        assert all(b2 == e1 - overlap for (_, e1, _), (b2, _, _) in zip(out, out[1:]))
        seen.add((paused, len(out) > 2))
    assert len(seen) == 4


def test_overlap_as_long_as_the_limit():
    out, paused = P.cut_points(np.full(31, P.LOUD_LEVELS + 1, np.uint8), 10, 10)
    assert not paused and out[-1][1] == 30 and all(e - b <= 10 for b, e, _ in out)


def test_sparse_table():
    rnd = np.random.default_rng(0)
    s = rnd.integers(0, 5, 500).astype(np.uint8)
    t = P.StrongestCut(s, 20)
    for lo in range(0, 480):
        hi = lo + int(rnd.integers(0, 20))
        part = s[lo : hi + 1]
        best = lo + len(part) - 1 - int(part[::-1].argmax())
        assert t.query(lo, hi) == (best, s[best])


def test_strengths():
    x = np.array([0.5] * 10 + [0.0] * 5 + [0.005, 0.5] + [0.001] * 2, np.float32)
    s = P.strengths([x], None, 20.0)  # 0.2 s are 4 samples
    assert [i for i, v in enumerate(s) if v > P.LOUD_LEVELS] == list(range(10, 17))
    v = P.strengths([np.zeros(40, np.float32)], [[[1.0, 0.5], [0.5, 1.0], [None, 3.0], [1.0]], None, [[1.1, 1.4]]], 20.0)
    assert [i for i, q in enumerate(v) if q > P.LOUD_LEVELS] == [*range(0, 11), *range(28, 41)]
    assert (P.strengths([np.zeros(5, np.float32)], [], 10.0) > P.LOUD_LEVELS).all()


def run(spark, rows, limits=(("d", 1.0, 0.2, 10), ("e", 1.0, 0.0, None))):
    c, l = spark.createDataFrame([(*r, 0, "x") for r in rows], CLIP), spark.createDataFrame(list(limits), LIMIT)
    return P.pieces(c, l, with_samples=True).orderBy("clip_id", "piece").collect()


@pytest.fixture
def day():
    from datetime import datetime

    return lambda n: datetime(2024, 1, n)


def test_clips(spark, day):
    loud, quiet = [0.5] * 8, [0.0] * 4
    rows = [
        (1, "d", 10, None, day(1), [loud + quiet + loud]),  # 20 samples, limit 10, overlap 2
        (2, "d", None, [[[0.0, 9.0]]], day(1), [[0.0] * 15, [0.0] * 3]),
        (3, "d", 10, None, day(1), [[0.0] * 10]),
        (4, "d", 10, None, day(1), None), (5, "d", 10, None, day(1), []), (6, "d", 10, None, day(1), [None, [0.0] * 11]), (7, "zz", 10, None, day(1), [[0.0] * 99]), (8, None, 10, None, day(1), [[0.0] * 99]),
        (9, "e", None, None, day(1), [[0.0] * 99]), (None, "d", 10, None, day(1), [[0.0] * 99]),
        (10, "d", 10, None, day(1), [[0.0] * 30]), (10, "d", 10, None, day(2), [[0.0] * 5]),
        (11, "d", 10, None, day(1), [[None] * 12]), (11, "d", 10, None, day(1), [[None] * 12]), (12, "d", 10, None, None, [[0.0] * 12]),
    ]
    got = run(spark, rows)
    assert {(r["clip_id"], r["kind"]) for r in got} == {(1, "pause"), (2, "forced"), (6, "pause"), (11, "forced"), (12, "pause")}
    one = [r for r in got if r["clip_id"] == 1]
    assert [(r["start_sample"], r["end_sample"], r["cut"]) for r in one] == [(0, 10, "pause"), (8, 12, "pause"), (10, 20, "end")]
    assert one[0]["samples"][0] == (loud + quiet + loud)[: one[0]["end_sample"]]
    two = [r for r in got if r["clip_id"] == 2]
    assert [len(ch) for ch in two[-1]["samples"]] == [two[-1]["end_sample"] - two[-1]["start_sample"], 0] and two[-1]["end_sample"] == 15
    assert run(spark, []) == [] and run(spark, rows, ()) == []
    assert P.found(spark.createDataFrame([(*rows[0], 0, "x")] * 2, CLIP), spark.createDataFrame([("d", 1.0, 0.2, 10)], LIMIT)).collect() == [(1, "pause")]


def test_long_clip():
    rnd = np.random.default_rng(1)
    n = 400_000
    out, _ = P.cut_points(np.where(rnd.random(n + 1) < 0.01, P.LOUD_LEVELS + 1, 3).astype(np.uint8), 2000, 200)
    assert out[-1][1] == n and max(e - b for b, e, _ in out) <= 2000
