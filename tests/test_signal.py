"""Array expressions and numpy features against independent formulas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnweave.functions import arrays as A
from turnweave.functions import features as N
from turnweave.functions import signal as S
from turnweave.operators import normalize


@pytest.fixture(scope="module")
def waves():
    rng = np.random.default_rng(4)
    return [rng.standard_normal(64).tolist(), (np.sin(np.arange(50) / 3) * 0.02).tolist(), [0.0] * 40]


def run(spark, waves, f):
    df = spark.createDataFrame([(i, w) for i, w in enumerate(waves)], "i int, x array<double>")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_expressions_equal_numpy(spark, waves):
    for got, w in zip(run(spark, waves, lambda x: S.rms(x, 16, 8)), waves):
        assert np.allclose(got, N.rms(np.array(w), 16, 8))
    for got, w in zip(run(spark, waves, lambda x: S.zero_crossing_rate(x, 16, 8)), waves):
        assert np.allclose(got, N.crossing_rate(np.array(w), 16, 8))
    for got, w in zip(run(spark, waves, lambda x: S.peak_normalize(x)), waves):
        p = np.abs(w).max()
        assert np.allclose(got, np.array(w) / p if p > 0.05 else w)
    assert run(spark, [[1.0] * 5], lambda x: S.frames(x, 8, 4)) == [[]]
    assert run(spark, [[1.0, 2.0, 3.0, 4.0]], lambda x: S.time_slice(x, F.lit(1.0), F.lit(9.0), F.lit(2))) == [[3.0, 4.0]]
    assert np.allclose(run(spark, waves, lambda x: S.weighted(F.slice(x, 1, 16), S.hann(16)))[0], (np.array(waves[0][:16]) - np.mean(waves[0][:16])) * N.hann(16))
    assert run(spark, [[1.0, -1.0, -0.5, 2.0]], S.zero_crossings) == [[False, True, False, True]]


def test_mono_of_unequal_channels(spark):
    df = spark.createDataFrame([([1.0, 1.0], [3.0])], "a array<double>, b array<double>")
    assert df.select(S.to_mono(F.col("a"), F.col("b"))).first()[0] == [2.0, 0.5]


def naive_burg(y, order):
    """Textbook recursion, one frame, no vectors."""
    f, b = list(y[1:]), list(y[:-1])
    a = [1.0] + [0.0] * order
    den = sum(v * v for v in f) + sum(v * v for v in b)
    for i in range(order):
        k = -2 * sum(p * q for p, q in zip(b, f)) / den
        a = [a[j] + k * a[i - j + 1] if 1 <= j <= i + 1 else a[j] for j in range(order + 1)]
        f, b = [p + k * q for p, q in zip(f, b)], [q + k * p for p, q in zip(f, b)]
        den = (1 - k * k) * den - b[-1] ** 2 - f[0] ** 2
        f, b = f[1:], b[:-1]
    return a


def test_lpc():
    rng = np.random.default_rng(1)
    frames = rng.standard_normal((7, 320))
    assert np.abs(N.burg(frames, 5) - np.array([naive_burg(f, 5) for f in frames])).max() < 1e-9
    sine = np.sin(2 * np.pi * 0.1 * np.arange(4000))
    assert np.allclose(N.burg(sine[None], 2)[0], [1, -2 * np.cos(2 * np.pi * 0.1), 1], atol=1e-3)
    assert N.lpc(sine, 2, 640, 160).shape == (4000 // 160 + 1, 3)
    assert np.isnan(N.burg(np.zeros((1, 50)), 2)).all()
    with pytest.raises(ValueError):
        N.lpc(np.zeros(900), 2, strict=True)


@pytest.mark.parametrize("rate", [16000, 8000])
def test_prosody_shape(rate):
    x = np.random.default_rng(0).standard_normal(2 * rate)
    assert N.prosody(x, rate).shape == (201, 22) and len(N.PROSODY) == 22


def test_pitch_parts():
    rate = 4000
    x = np.sin(2 * np.pi * 100 * np.arange(rate) / rate)
    c = N.nccf(x, rate, 200, 100)
    assert c.shape == (40, 67) and c[5].argmax() + 1 == 40  # 100 Hz is 40 samples
    spec = N.magnitude(x + 0.5 * np.sin(2 * np.pi * 200 * np.arange(rate) / rate) + 0.5 * np.sin(2 * np.pi * 300 * np.arange(rate) / rate), 400, 100, 4000)
    best = N.shc(spec, rate, 4000)[10].argmax() + 60
    assert abs(best - 100) <= 20
    assert abs(N.nlfer(spec, rate, 4000).mean() - 1) < 1e-9
    assert (N.nlfer(np.zeros((3, 101)), rate, 200) == 0).all()
    y = N.bandpass(np.sin(2 * np.pi * 1900 * np.arange(rate) / rate), rate)
    assert np.abs(y[400:]).max() < 0.05
    assert len(N.bandpass(x, rate, every=2)) == rate // 2
    assert N.find_peaks(np.array([[0, 2.0, 0], [0, 0, 3.0], [0, 0, 0]]), 1.0).tolist() == [[1, 2]]
    assert N.fit_frames(np.array([1.0, 2.0]), 1000, 250, True).tolist() == [1, 2, 2, 2]


def test_mfcc_by_definition():
    x = np.random.default_rng(3).standard_normal(500)
    got = N.mfcc(x, 8000, 128, 64, 5, 12)
    frame = np.pad(x, 64, mode="reflect")[64 * 3 : 64 * 3 + 128] * N.hann(128)
    power = np.array([abs(sum(frame[t] * np.exp(-2j * np.pi * k * t / 128) for t in range(128))) ** 2 for k in range(65)])
    mel = 10 * np.log10(power @ N.mel_matrix(8000, 128, 12))
    want = [(np.sqrt(1 / 12) if c == 0 else np.sqrt(2 / 12)) * sum(mel[m] * np.cos(np.pi * c * (m + 0.5) / 12) for m in range(12)) for c in range(5)]
    assert got.shape == (8, 5) and np.allclose(got[3], want)
    assert N.feature_index(("a", "b")) == ({"a": 0, "b": 1}, {0: "a", 1: "b"})


def test_resample():
    t = np.arange(8000) / 8000
    x = np.sin(2 * np.pi * 440 * t)
    y = N.resample(x, 8000, 16000)
    assert len(y) == 16000 and np.abs(y - np.sin(2 * np.pi * 440 * np.arange(16000) / 16000))[400:-400].max() < 0.01
    assert N.resample(x, 8000, 8000) is x


def test_arrays(spark):
    x = [3.0, -1.0, 3.0, 0.5]
    f = lambda e: run(spark, [x], lambda c: e(c))[0]
    assert f(A.argmax) == 0 and f(lambda c: A.thin(c, 3)) == [3.0, 0.5] and f(lambda c: A.tail(c, 2)) == [3.0, 0.5] and f(lambda c: A.tail(c, 9)) == x and f(lambda c: A.head(c, 1)) == [3.0]
    assert f(lambda c: A.pad_left(c, 6, F.lit(0.0))) == [0.0, 0.0, *x] and f(lambda c: A.pad_right(c, 2, F.lit(0.0))) == x
    assert f(A.running_sum) == [3.0, 2.0, 5.0, 5.5] and f(A.changes) == [True, True, True] and f(lambda c: A.indices_where(c, lambda v: v > 1)) == [0, 2]
    assert f(lambda c: A.repeat_last(c, F.lit(6))) == [*x, 0.5, 0.5] and run(spark, [[]], lambda c: A.repeat_last(c, F.lit(2))) == [[0.0, 0.0]]


def test_z_norm(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 2.0), ("a", 4.0), ("b", 7.0), ("c", 5.0), ("c", 5.0)], "k string, x double")
    got = [tuple(r) for r in normalize.z_norm(df, ["k"], ["x"]).orderBy("k", "x").collect()]
    assert got == [("a", -1.0), ("a", 0.0), ("a", 1.0), ("b", None), ("c", None), ("c", None)]
    nz = [r["x"] for r in normalize.z_norm_nonzero(df.where("k = 'a'"), ["x"]).orderBy("x").collect()]
    assert nz[1] == 0.0 and abs(nz[0] + nz[2]) < 1e-12


def test_log_mel():
    x = np.random.default_rng(3).standard_normal(3000)
    got = N.log_mel(x, 8000, 256, 128, 20)
    assert got.shape[1] == 20 and np.allclose(np.exp(got), N.spectrogram(x, 256, 128, 256) @ N.mel_matrix(8000, 256, 20), rtol=1e-9)
    assert (N.log_mel(np.zeros(600), 8000, 256, 128, 20) == np.log(1e-10)).all()


@pytest.mark.parametrize("hz", [80.0, 123.0, 200.0, 310.0])
def test_f0_of_sines(hz):
    t = np.arange(16000) / 16000
    x = np.sin(2 * np.pi * hz * t) + 0.5 * np.sin(4 * np.pi * hz * t) + 0.3 * np.sin(6 * np.pi * hz * t)
    f = N.f0_track(x, 16000, size=800, hop=200)
    assert f.shape == (80, 2) and f[2:-6, 1].all()
    assert np.abs(f[2:-6, 0] / hz - 1).max() < 0.01


def test_f0_follows_and_rests():
    rng = np.random.default_rng(7)
    t = np.arange(8000) / 16000
    parts = [np.sin(2 * np.pi * 110 * t), np.zeros(8000), np.sin(2 * np.pi * 220 * t), 0.5 * rng.standard_normal(8000)]
    f = N.f0_track(np.concatenate(parts), 16000, size=800, hop=200)
    q = [f[i * 40 + 5 : i * 40 + 33] for i in range(4)]
    assert np.abs(q[0][:, 0] / 110 - 1).max() < 0.02 and np.abs(q[2][:, 0] / 220 - 1).max() < 0.02
    assert not q[1][:, 1].any() and q[3][:, 1].mean() < 0.3
    g = N.f0_track(np.concatenate(parts), 16000, size=800, hop=200, interpolated=True)
    assert (g[:, 0] > 0).all() and np.array_equal(g[:, 1], f[:, 1])
    assert N.f0_track(np.zeros(0), 16000).shape == (0, 2) and not N.f0_track(np.zeros(500), 16000)[:, 1].any() and N.f0_track(np.ones(3), 16000).shape == (1, 2)


def test_applied_functions_keep_nulls(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, []), (4, [float("nan")])], "i int, x array<double>")
    one = {r["i"]: r["v"] for r in df.select("i", N.apply_1d(F.col("x"), lambda v: 2 * v).alias("v")).collect()}
    assert one == {1: [2.0, 4.0], 2: None, 3: [], 4: [None]}
    two = {r["i"]: r["v"] for r in df.select("i", N.apply_2d(F.col("x"), lambda v: np.stack((v, v), axis=1)).alias("v")).collect()}
    assert two == {1: [[1.0, 1.0], [2.0, 2.0]], 2: None, 3: [], 4: [[None, None]]}


def test_z_norm_of_a_hot_and_a_null_key(spark):
    df = spark.createDataFrame([(None if i % 5 == 0 else 1, float(i * i % 7)) for i in range(60)], "k int, x double")
    got = sorted(((r["k"] or 0), round(r["x"], 9)) for r in normalize.z_norm(df, ["k"], ["x"]).collect())
    want = []
    for k in (None, 1):
        v = np.array([r["x"] for r in df.collect() if r["k"] == k])
        want += [((k or 0), round(z, 9)) for z in (v - v.mean()) / v.std(ddof=1)]
    assert np.allclose(got, sorted(want))
