"""Queries over waveforms: framing, levels, normalization and features."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.functions import arrays as A
from turnweave.functions import features as N
from turnweave.functions import signal as S
from turnweave.functions import timing as M
from turnweave.operators import normalize, windows
from turnweave.plans import tables
from turnweave.plans.tables import CLIP_CHANNELS, CLIP_WAVES, WAVES
from turnweave.runtime import table

SIZE, HOP = 16, 8
R6 = lambda c: F.round(c, 6)


def framed(s: SparkSession, d: str, what, name: str) -> DataFrame:
    w = tables.waves(s, d).select("vec_id", F.posexplode(what(F.col("x"))).alias("frame", name))
    return w.select("vec_id", "frame", R6(name).alias(name))


def frames(s: SparkSession, d: str) -> DataFrame:
    w = tables.waves(s, d).select("vec_id", F.posexplode(S.frames(F.col("x"), SIZE, HOP)).alias("frame", "f"))
    return w.select("vec_id", "frame", F.size("f").alias("n"), R6(F.col("f")[0]).alias("first"), R6(F.element_at("f", -1)).alias("last"))


def normalized(s: SparkSession, d: str) -> DataFrame:
    x = F.col("x")
    return tables.clip_channels(s, d).select("clip_id", "channel", R6(S.peak(x)).alias("peak"), R6(S.total(S.peak_normalize(x))).alias("total"), F.size(x).alias("n"))


def mono(s: SparkSession, d: str) -> DataFrame:
    m = S.to_mono(F.col("a"), F.col("b"))
    return tables.clip_waves(s, d).select("clip_id", F.size(m).alias("n"), R6(S.total(m)).alias("total"), R6(S.peak(m)).alias("peak"))


def crossings(s: SparkSession, d: str) -> DataFrame:
    return tables.clip_channels(s, d).select("clip_id", "channel", F.size(F.filter(S.zero_crossings(F.col("x")), lambda v: v)).alias("crossings"))


def sliced(s: SparkSession, d: str) -> DataFrame:
    x = S.time_slice(F.col("x"), F.lit(1.0), F.lit(2.5), F.lit(100))
    return tables.clip_channels(s, d).select("clip_id", "channel", F.size(x).alias("n"), R6(S.total(x)).alias("total"))


def rows(s: SparkSession, d: str) -> DataFrame:
    w = table(s, d, "embeddings").select("vec_id", "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    return w.withColumn("x", F.when(F.col("i") % 5 == 0, 0.0).otherwise(F.col("x")))


def z_norm(s: SparkSession, d: str) -> DataFrame:
    return normalize.z_norm(rows(s, d), ["vec_id"], ["x"]).select("vec_id", "i", R6("x").alias("x"))


def z_norm_nonzero(s: SparkSession, d: str) -> DataFrame:
    return normalize.z_norm_nonzero(rows(s, d), ["x"]).select("vec_id", "i", R6("x").alias("x"))


def value_range(s: SparkSession, d: str) -> DataFrame:
    return normalize.nonzero_range(rows(s, d), "x", ["label"]).select("label", R6("low").alias("low"), R6("high").alias("high"))


def peaks(s: SparkSession, d: str) -> DataFrame:
    x = F.transform("x", lambda v, i: F.when(i % 5 == 0, 0.0).otherwise(v))
    at = N.apply_2d(F.col("x"), lambda v: N.find_peaks(v, 0.1)[:, 1:])
    p = tables.waves(s, d).select("vec_id", x.alias("x")).select("vec_id", "x", F.explode(F.flatten(at)).alias("i"))
    return p.select("vec_id", F.col("i").cast("int").alias("i"), R6(F.get("x", F.col("i").cast("int"))).alias("x"))


def cuts(s: SparkSession, d: str) -> DataFrame:
    b = windows.batches(tables.waves(s, d), ["vec_id"], "x", 20, 10, 2)
    return b.select("vec_id", "batch_id", "item", R6(S.total(F.col("samples"))).alias("total"))


def array_functions(s: SparkSession, d: str) -> DataFrame:
    x = F.col("x")
    return tables.waves(s, d).select(
        "vec_id", A.argmax(x).alias("argmax"), F.size(A.thin(x, 3)).alias("thinned"), R6(S.total(A.thin(x, 3))).alias("thin_total"), R6(F.element_at(A.running_sum(x), -1)).alias("running"),
        F.size(A.indices_where(x, lambda v: v > 0.1)).alias("above"), R6(S.total(A.set_where(x, lambda v: v < 0, F.lit(0.0)))).alias("positive"), R6(F.reverse(x)[0]).alias("reversed_first"),
        F.size(F.filter(A.changes(F.transform(x, lambda v: v > 0)), lambda v: v)).alias("turns"), F.size(A.repeat_last(x, F.lit(70))).alias("filled"), R6(F.element_at(A.repeat_last(x, F.lit(70)), -1)).alias("fill"),
    )


def time_math(s: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return table(s, d, "events").select(
        "event_id", M.samples_to_frames(v * 100, 160).alias("frames"), F.round(M.sample_to_time(v, 16000), 9).alias("time"), M.time_to_frames(v, 0.01).alias("time_frames"), M.time_to_frames_samples(v, 16000, 160).alias("sample_frames"),
        M.time_to_samples(v, 8000).alias("samples"), M.frame_count(v, 7).alias("ceil_frames"), R6(M.inverse(v)).alias("inverse"), R6(M.frames_to_time(F.floor(v), 0.25)).alias("frame_time"),
    )


def features(f: Callable[[np.ndarray], np.ndarray], two: bool) -> Callable[[SparkSession, str], DataFrame]:
    """(clip_id, channel, frame, v), with several values a frame also their number i, of every channel of each clip; one
    without samples has no frame."""

    def run(s: SparkSession, d: str) -> DataFrame:
        w = tables.clip_channels(s, d).where(F.size("x") > 0)
        e = w.select("clip_id", "channel", F.posexplode((N.apply_2d if two else N.apply_1d)(F.col("x"), f)).alias("frame", "v"))
        if two:
            return e.select("clip_id", "channel", "frame", F.posexplode("v").alias("i", "v")).withColumn("v", R6("v"))
        return e.select("clip_id", "channel", "frame", R6("v").alias("v"))

    return run


QUERIES = {
    "frame_signal": frames,
    "rms": lambda s, d: framed(s, d, lambda x: S.rms(x, SIZE, HOP), "rms"),
    "zcr": lambda s, d: framed(s, d, lambda x: S.zero_crossing_rate(x, SIZE, HOP), "zcr"),
    "weighted_frames": lambda s, d: framed(s, d, lambda x: F.transform(S.frames(S.pad_zero(x, SIZE), SIZE, HOP), lambda f: S.total(F.transform(S.weighted(f, S.hann(SIZE)), lambda v: v * v))), "energy"),
    "peak_normalize": normalized,
    "mono_mix": mono,
    "zero_crossings": crossings,
    "time_slice": sliced,
    "z_norm": z_norm,
    "z_norm_nonzero": z_norm_nonzero,
    "value_range": value_range,
    "neighbour_max_peaks": peaks,
    "dialog_to_batch": cuts,
    "array_functions": array_functions,
    "time_frame_math": time_math,
    "lpc": features(lambda x: N.lpc(x, 2, 40, 20), True),
    "mfcc": features(lambda x: N.mfcc(x, 100, 64, 32), True),
    "prosody": features(lambda x: N.prosody(x, 800), True),
    "bandpass": features(lambda x: N.bandpass(x, 4000), False),
    "resample": features(lambda x: N.resample(x, 100, 80), False),
    "nlfer": features(lambda x: N.nlfer(N.magnitude(x, 70, 20, 256), 2000, 256), False),
    "shc": features(lambda x: N.shc(N.magnitude(x, 70, 20, 256), 2000, 256), True),
    "nccf": features(lambda x: N.nccf(x, 2000, 70, 20), True),
    "log_mel": features(lambda x: N.log_mel(x, 100, 64, 32, 20), True),
    "f0_track": features(lambda x: N.f0_track(x, 2000, size=70, hop=20), True),
}

_MIRROR = "list_concat(list_reverse(x[2:9]), x, list_reverse(x[len(x) - 8:len(x) - 1])) AS x"
_ZEROS = "list_concat(list_transform(range(8), lambda i: CAST(0 AS DOUBLE)), x, list_transform(range(8), lambda i: CAST(0 AS DOUBLE))) AS x"


def _frames(pad: str = "x", left: str = "") -> str:
    return f"WITH {WAVES}, p AS (SELECT vec_id, {pad} FROM wav), f AS (SELECT vec_id, unnest(range((len(x) - {SIZE}) // {HOP} + 1)) AS frame, x FROM p), g AS (SELECT vec_id, CAST(frame AS INT) AS frame, x[frame * {HOP} + 1:frame * {HOP} + {SIZE}] AS f FROM f)"


_X = f"WITH {CLIP_CHANNELS}, x AS (SELECT clip_id, channel, x, len(x) AS n FROM cch WHERE len(x) > 0)"
#: Hann-windowed frames of 40 samples every 20, without their mean, 40 zeros in front.
_LPC_FRAMES = f"""{_X}, p AS (SELECT clip_id, channel, list_concat(list_transform(range(40), lambda i: CAST(0 AS DOUBLE)), x) AS x FROM x), f AS (SELECT clip_id, channel, x, unnest(range((len(x) - 40) // 20 + 1)) AS frame FROM p),
g AS (SELECT clip_id, channel, CAST(frame AS INT) AS frame, x[frame * 20 + 1:frame * 20 + 40] AS f FROM f), m AS (SELECT clip_id, channel, frame, list_transform(range(1, 41), lambda i: (f[i] - list_sum(f) / 40) * (0.5 - 0.5 * cos(2 * pi() * (i - 1) / 40))) AS f FROM g)"""
#: Burg's method written out for two steps, on the sums of products of shifted frames.
_BURG = f"""{_LPC_FRAMES},
s1 AS (SELECT *, list_sum(list_transform(range(2, 41), lambda i: f[i] * f[i - 1])) AS c, list_sum(list_transform(range(2, 41), lambda i: f[i] * f[i] + f[i - 1] * f[i - 1])) AS e FROM m),
k1 AS (SELECT *, -2 * c / CASE WHEN e > 0 THEN e END AS k FROM s1),
er AS (SELECT *, list_transform(range(2, 41), lambda i: f[i] + k * f[i - 1]) AS u, list_transform(range(2, 41), lambda i: f[i - 1] + k * f[i]) AS w FROM k1),
s2 AS (SELECT *, list_sum(list_transform(range(2, 40), lambda i: u[i] * w[i - 1])) AS c2, list_sum(list_transform(range(2, 40), lambda i: u[i] * u[i] + w[i - 1] * w[i - 1])) AS e2 FROM er),
co AS (SELECT clip_id, channel, frame, k, -2 * c2 / CASE WHEN e2 > 0 THEN e2 END AS q FROM s2),
li AS (SELECT clip_id, channel, frame, CASE WHEN k IS NULL OR q IS NULL THEN [NULL, NULL, NULL]::DOUBLE[] ELSE [1.0, k + q * k, q] END AS v FROM co)
SELECT clip_id, channel, frame, CAST(unnest(range(3)) AS INT) AS i, round(unnest(v), 6) AS v FROM li"""


def _convolved(taps: list[float]) -> str:
    h = f"CAST([{', '.join(repr(float(t)) for t in taps)}] AS DOUBLE[])"
    return f"""{_X}, h AS (SELECT {h} AS h), i AS (SELECT clip_id, channel, x, h, unnest(range(n)) AS i FROM x, h)
SELECT clip_id, channel, CAST(i AS INT) AS frame, round(greatest(least(list_sum(list_transform(range(greatest(i - {len(taps) - 1}, 0), i + 1), lambda j: x[j + 1] * h[i - j + 1])), 1), -1), 6) AS v FROM i"""


def _bandpass_taps(rate: int, order: int = 150, low: float = 50.0, high: float = 1500.0) -> list[float]:
    """The difference of two windowed sinc filters, scaled to gain 1 in the middle of the band."""
    n = np.arange(order + 1) - order / 2
    h = sum(sign * np.sin(np.pi * c * n + (n == 0)) / (np.pi * n + (n == 0)) * (n != 0) + sign * c * (n == 0) for sign, c in ((1, 2 * high / rate), (-1, 2 * low / rate)))
    h = h * (0.54 - 0.46 * np.cos(2 * np.pi * np.arange(order + 1) / order))
    return list(h / abs((h * np.exp(-1j * np.pi * (low + high) / rate * n)).sum()))


#: Sinc interpolation from 100 to 80 samples a second: 39.6 Hz of band, six zero crossings, a squared cosine as window.
_RESAMPLED = f"""{_X}, o AS (SELECT clip_id, channel, x, n, unnest(range(CAST(ceil(n * 80 / 100.0) AS BIGINT))) AS i FROM x), t AS (SELECT *, i * 1.25 AS t FROM o)
SELECT clip_id, channel, CAST(i AS INT) AS frame, round(0.792 * coalesce(list_sum(list_transform(range(greatest(CAST(floor(t) AS BIGINT) - 8, 0), least(CAST(floor(t) AS BIGINT) + 9, n)),
lambda j: x[j + 1] * CASE WHEN abs(t - j) * 0.792 < 6 THEN pow(cos(pi() * (t - j) * 0.792 / 12), 2) ELSE 0 END * CASE WHEN t = j THEN 1 ELSE sin(pi() * (t - j) * 0.792) / (pi() * CASE WHEN t = j THEN 1 ELSE t - j END * 0.792) END)), 0), 6) AS v FROM t"""
_NCCF = f"""{_X}, p AS (SELECT clip_id, channel, n, list_concat(x, list_transform(range(104), lambda i: CAST(0 AS DOUBLE))) AS x FROM x), f AS (SELECT clip_id, channel, x, unnest(range(CAST(ceil(n / 20.0) AS BIGINT))) AS frame FROM p),
s AS (SELECT clip_id, channel, frame, x[frame * 20 + 1:frame * 20 + 104] AS y FROM f), e AS (SELECT *, list_sum(list_transform(range(1, 71), lambda i: y[i] * y[i])) AS e0, unnest(range(1, 35)) AS lag FROM s)
SELECT clip_id, channel, CAST(frame AS INT) AS frame, CAST(lag - 1 AS INT) AS i, round(list_sum(list_transform(range(1, 71), lambda i: y[i] * y[i + lag])) / (1e-9 + sqrt(e0 * list_sum(list_transform(range(1, 71), lambda i: y[i + lag] * y[i + lag])))), 6) AS v FROM e"""
_ROWS = "WITH e AS (SELECT vec_id, label, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS y FROM embeddings), r AS (SELECT vec_id, label, CAST(i AS INT) AS i, CASE WHEN i % 5 = 0 THEN 0.0 ELSE y END AS x FROM e)"
_SUM = "coalesce(list_sum({}), 0)"

SQL = {
    "frame_signal": f"{_frames()} SELECT vec_id, frame, CAST(len(f) AS INT) AS n, round(f[1], 6) AS first, round(f[len(f)], 6) AS last FROM g",
    "rms": f"{_frames(_MIRROR)} SELECT vec_id, frame, round(sqrt(list_sum(list_transform(f, lambda v: v * v)) / {SIZE}), 6) AS rms FROM g",
    "zcr": f"{_frames(_ZEROS)} SELECT vec_id, frame, round(len(list_filter(range(2, {SIZE + 1}), lambda i: (f[i] < 0) <> (f[i - 1] < 0))) / {float(SIZE)}, 6) AS zcr FROM g",
    "weighted_frames": f"""{_frames("list_concat(list_transform(range(16), lambda i: CAST(0 AS DOUBLE)), x) AS x")}
SELECT vec_id, frame, round(list_sum(list_transform(range(1, {SIZE + 1}), lambda i: pow((f[i] - list_avg(f)) * (0.5 - 0.5 * cos(2 * pi() * (i - 1) / {SIZE})), 2))), 6) AS energy FROM g""",
    "mono_mix": f"""WITH {CLIP_WAVES}, m AS (SELECT clip_id, list_transform(range(1, greatest(len(a), len(b)) + 1), lambda i: (coalesce(a[i], 0) + coalesce(b[i], 0)) / 2) AS m FROM cwv)
SELECT clip_id, CAST(len(m) AS INT) AS n, round({_SUM.format("m")}, 6) AS total, round(list_max(list_transform(m, lambda v: abs(v))), 6) AS peak FROM m""",
    "peak_normalize": f"""WITH {CLIP_CHANNELS}, p AS (SELECT clip_id, channel, x, list_max(list_transform(x, lambda v: abs(v))) AS peak FROM cch)
SELECT clip_id, channel, round(peak, 6) AS peak, round({_SUM.format("list_transform(x, lambda v: CASE WHEN peak > 0.05 THEN v / peak ELSE v END)")}, 6) AS total, CAST(len(x) AS INT) AS n FROM p""",
    "zero_crossings": f"WITH {CLIP_CHANNELS} SELECT clip_id, channel, CAST(len(list_filter(range(2, len(x) + 1), lambda i: (x[i] < 0) <> (x[i - 1] < 0))) AS INT) AS crossings FROM cch",
    "time_slice": f"WITH {CLIP_CHANNELS} SELECT clip_id, channel, CAST(len(x[101:250]) AS INT) AS n, round({_SUM.format('x[101:250]')}, 6) AS total FROM cch",
    "z_norm": f"{_ROWS} SELECT vec_id, i, round((x - avg(x) OVER w) / stddev_samp(x) OVER w, 6) AS x FROM r WINDOW w AS (PARTITION BY vec_id)",
    "z_norm_nonzero": f"{_ROWS}, t AS (SELECT avg(x) FILTER (x <> 0) AS m, stddev_samp(x) FILTER (x <> 0) AS sd FROM r) SELECT vec_id, i, round(CASE WHEN x = 0 THEN 0 ELSE (x - m) / sd END, 6) AS x FROM r, t",
    "value_range": f"{_ROWS} SELECT label, round(min(x) FILTER (x <> 0), 6) AS low, round(max(x), 6) AS high FROM r GROUP BY label",
    "neighbour_max_peaks": f"{_ROWS}, m AS (SELECT *, max(x) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM r) SELECT vec_id, i, round(x, 6) AS x FROM m WHERE x = m AND x > 0.1",
    "dialog_to_batch": f"""WITH {WAVES}, i AS (SELECT vec_id, x, unnest(range((len(x) - 20) // 10 + 1)) AS i FROM wav)
SELECT vec_id, CAST(i // 2 AS INT) AS batch_id, CAST(i % 2 AS INT) AS item, round(list_sum(x[i * 10 + 1:i * 10 + 20]), 6) AS total FROM i""",
    "array_functions": f"""WITH {WAVES}, t AS (SELECT vec_id, x, list_transform(list_filter(range(len(x)), lambda i: i % 3 = 0), lambda i: x[i + 1]) AS th FROM wav)
SELECT vec_id, CAST(list_position(x, list_max(x)) - 1 AS BIGINT) AS argmax, CAST(len(th) AS INT) AS thinned, round(list_sum(th), 6) AS thin_total, round(list_sum(x), 6) AS running, CAST(len(list_filter(x, lambda v: v > 0.1)) AS INT) AS above,
round(list_sum(list_transform(x, lambda v: CASE WHEN v < 0 THEN 0 ELSE v END)), 6) AS positive, round(x[len(x)], 6) AS reversed_first,
CAST(len(list_filter(range(2, len(x) + 1), lambda i: (x[i] > 0) <> (x[i - 1] > 0))) AS INT) AS turns, CAST(greatest(len(x), 70) AS INT) AS filled, round(x[len(x)], 6) AS fill FROM t""",
    "time_frame_math": """SELECT event_id, CAST(trunc(value * 100 / 160) AS INT) AS frames, round(value / 16000, 9) AS time, CAST(trunc(value / 0.01) AS INT) AS time_frames, CAST(trunc(value * 16000 / 160) AS INT) AS sample_frames,
CAST(trunc(value * 8000) AS INT) AS samples, CAST(ceil(value / 7) AS BIGINT) AS ceil_frames, round(1.0 / (value + 1e-9), 6) AS inverse, round(floor(value) * 0.25, 6) AS frame_time FROM events""",
    "lpc": _BURG,
    "bandpass": _convolved(_bandpass_taps(4000)),
    "resample": _RESAMPLED,
    "nccf": _NCCF,
}
