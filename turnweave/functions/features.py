"""Per-frame signal features in numpy, and the vectorized functions that apply them to array columns.

Everything works on one signal at a time in double precision; the wrappers take whole Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from turnweave.runtime import ship

EPS = 1e-9


def unfold(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """(frames, size); the incomplete tail is dropped."""
    if len(x) < size:
        return np.zeros((0, size))
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop]


def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def rms(x: np.ndarray, size: int, hop: int, center: bool = True) -> np.ndarray:
    if center:
        x = np.pad(x, size // 2, mode="reflect") if len(x) > size // 2 else np.pad(x, size // 2)
    return np.sqrt(np.mean(unfold(x, size, hop) ** 2, axis=1))


def crossing_rate(x: np.ndarray, size: int, hop: int, center: bool = True) -> np.ndarray:
    """The first sample of the signal never counts, so the denominator is the frame length."""
    if center:
        x = np.pad(x, size // 2)
    f = np.signbit(unfold(x, size, hop))
    return (f[:, 1:] != f[:, :-1]).sum(axis=1) / size


def burg(frames: np.ndarray, order: int) -> np.ndarray:
    """(frames, order + 1) prediction coefficients by Burg's method, the first 1; null (NaN) for ill-conditioned frames
    such as all zeros.

    Each step takes the reflection coefficient that leaves least forward and backward error energy,
    -2 <f, b> / (<f, f> + <b, b>), adds the predictor's mirror image to it by that much, and updates both errors.
    """
    dot = lambda x, y: np.einsum("ij,ij->i", x, y)
    a = np.zeros((len(frames), order + 1))
    a[:, 0] = 1.0
    whole = np.asarray(frames, float)
    f, b = whole[:, 1:], whole[:, :-1]
    bad = np.zeros(len(frames), bool)
    for m in range(order):
        energy = dot(f, f) + dot(b, b)
        bad |= ~(energy > 0)
        k = (-2.0 * dot(f, b) / np.where(energy > 0, energy, 1.0))[:, None]
        a[:, 1 : m + 2] = a[:, 1 : m + 2] + k * a[:, m::-1]
        f, b = (f + k * b)[:, 1:], (b + k * f)[:, :-1]
    a[bad] = np.nan
    return a


def lpc(x: np.ndarray, order: int = 2, size: int = 640, hop: int = 160, padding: bool = True, window: Callable[[int], np.ndarray] | None = hann, strict: bool = False) -> np.ndarray:
    """Prediction coefficients of each frame. Frames end where they stand: all padding is on the left."""
    if padding:
        x = np.concatenate((np.zeros(size), x))
    f = unfold(x, size, hop)
    f = f - f.mean(axis=1, keepdims=True)
    if window is not None:
        f = f * window(size)
    out = burg(f, order)
    if strict and np.isnan(out).any():
        raise ValueError("ill-conditioned frame")
    return out


def mel_matrix(rate: int, n_fft: int, n_mels: int, low: float = 0.0, high: float | None = None) -> np.ndarray:
    """(bins, mels) triangular filters on the HTK mel scale."""
    mel = lambda f: 2595.0 * np.log10(1.0 + f / 700.0)
    edges = 700.0 * (10.0 ** (np.linspace(mel(low), mel(high or rate / 2), n_mels + 2) / 2595.0) - 1.0)
    freqs = np.linspace(0, rate / 2, n_fft // 2 + 1)
    up = (freqs[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - freqs[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0.0, np.minimum(up, down))


def spectrogram(x: np.ndarray, size: int, hop: int, n_fft: int, power: float = 2.0, center: bool = True) -> np.ndarray:
    """(frames, bins) of windowed frames."""
    if center:
        pad = n_fft // 2
        x = np.pad(x, pad, mode="reflect") if len(x) > pad else np.pad(x, pad)
    w = np.zeros(n_fft)
    left = (n_fft - size) // 2
    w[left : left + size] = hann(size)
    return np.abs(np.fft.rfft(unfold(x, n_fft, hop) * w, axis=1)) ** power


def log_mel(x: np.ndarray, rate: int, size: int, hop: int, n_mels: int = 80, n_fft: int | None = None, floor: float = 1e-10) -> np.ndarray:
    """(frames, n_mels): natural logarithm of the mel spectrum, ``floor`` at least."""
    n_fft = n_fft or size
    return np.log(np.maximum(spectrogram(x, size, hop, n_fft) @ mel_matrix(rate, n_fft, n_mels), floor))


def mfcc(x: np.ndarray, rate: int, size: int, hop: int, n_mfcc: int = 13, n_mels: int = 26, n_fft: int | None = None) -> np.ndarray:
    """(frames, n_mfcc): orthonormal DCT-II of the mel spectrum in decibels, 80 below its greatest value at least."""
    n_fft = n_fft or size
    mel = spectrogram(x, size, hop, n_fft) @ mel_matrix(rate, n_fft, n_mels)
    db = 10.0 * np.log10(np.maximum(mel, 1e-10))
    db = np.maximum(db, db.max() - 80.0) if db.size else db
    n = np.arange(n_mels)
    dct = np.cos(np.pi / n_mels * (n[:, None] + 0.5) * np.arange(n_mfcc))
    dct *= np.sqrt(2.0 / n_mels)
    dct[:, 0] *= np.sqrt(0.5)
    return db @ dct


PROSODY = ("rms", "zcr", *(f"mfcc_{i}" for i in range(1, 13)), *(f"lpc_{i}" for i in range(8)))


def prosody(x: np.ndarray, rate: int, frame_time: float = 0.05, hop_time: float = 0.01) -> np.ndarray:
    """(frames, 22): RMS, zero crossings, MFCC 1 to 12 and LPC 0 to 7; frames cut to the fewest of the four."""
    size, hop = int(frame_time * rate), int(hop_time * rate)
    parts = [rms(x, size, hop)[:, None], crossing_rate(x, size, hop)[:, None], mfcc(x, rate, size, hop)[:, 1:13], lpc(x, 7, size, hop)]
    n = min(map(len, parts))
    return np.concatenate([p[:n] for p in parts], axis=1)


def lowpass_taps(order: int, cutoff: float) -> np.ndarray:
    """Hamming-windowed sinc; ``cutoff`` as a share of half the rate."""
    n = np.arange(order + 1) - order / 2
    return cutoff * np.sinc(cutoff * n) * np.hamming(order + 1)


def bandpass(x: np.ndarray, rate: int, order: int = 150, low: float = 50.0, high: float = 1500.0, every: int = 1) -> np.ndarray:
    """FIR band pass, clamped to [-1, 1], then every ``every``-th sample."""
    h = lowpass_taps(order, min(high / (rate / 2), 1.0)) - lowpass_taps(order, low / (rate / 2))
    mid = (low + high) / 2 / (rate / 2) * np.pi
    gain = abs((h * np.exp(-1j * mid * (np.arange(order + 1) - order / 2))).sum())
    y = np.convolve(x, h / gain)[: len(x)]
    return np.clip(y, -1.0, 1.0)[::every]


def resample(x: np.ndarray, old: int, new: int, width: int = 6, rolloff: float = 0.99) -> np.ndarray:
    """Sinc interpolation with a Hann-shaped window, ceil(n * new / old) samples."""
    if old == new or not len(x):
        return x
    base = min(old, new) * rolloff / 2
    reach = width * old / (2 * base)
    out = np.arange(-(-len(x) * new // old)) * (old / new)
    k = np.arange(-int(np.ceil(reach)), int(np.ceil(reach)) + 1)
    at = np.floor(out).astype(int)[:, None] + k
    t = (out[:, None] - at) * (2 * base / old)
    w = np.cos(np.pi * np.clip(t / width, -1, 1) / 2) ** 2
    inside = (at >= 0) & (at < len(x))
    return (np.where(inside, x[np.clip(at, 0, len(x) - 1)], 0.0) * np.sinc(t) * w).sum(axis=1) * (2 * base / old)


def magnitude(x: np.ndarray, size: int, hop: int, n_fft: int) -> np.ndarray:
    return spectrogram(x, size, hop, n_fft, power=1.0)


def nlfer(spec: np.ndarray, rate: int, n_fft: int, f_min: float = 60.0, f_max: float = 400.0) -> np.ndarray:
    """Energy between twice the lowest and the highest pitch in each frame, by its mean over frames."""
    a, b = round(2 * f_min * n_fft / rate), round(f_max * n_fft / rate)
    e = spec[:, a:b].sum(axis=1)
    m = e.mean() if len(e) else 0.0
    return e / m if m > 0 else np.zeros_like(e)


def shc(spec: np.ndarray, rate: int, n_fft: int, f_min: float = 60.0, f_max: float = 400.0, harmonics: int = 3, window: float = 40.0) -> np.ndarray:
    """Spectral harmonics correlation (frames, pitch bins), by the greatest of each frame; 0 beyond the spectrum."""
    h = round(n_fft * (window // 2) / rate)
    f = np.arange(round(n_fft * f_min / rate), round(n_fft * f_max / rate))
    out = np.zeros((len(spec), len(f)))
    padded = np.concatenate((np.zeros((len(spec), h)), spec, np.zeros((len(spec), max(0, harmonics * (int(f[-1]) + 1 if len(f) else 0) + h + 1 - spec.shape[1])))), axis=1)
    for d in range(-h, h):
        prod = np.ones_like(out)
        for r in range(1, harmonics + 1):
            prod *= padded[:, r * f + d + h]
        out += prod
    top = out.max(axis=1, keepdims=True) if len(f) else 1.0
    return np.divide(out, top, out=np.zeros_like(out), where=top > 0)


def nccf(x: np.ndarray, rate: int, size: int, hop: int, f_low: float = 60.0, flip: bool = False) -> np.ndarray:
    """Normalized cross-correlation (frames, lags 1 … ceil(rate / f_low)); ``flip`` reverses the lags."""
    n = -(-len(x) // hop)
    lags = int(np.ceil(rate / f_low))
    p = np.concatenate((x, np.zeros(max(0, lags + n * size - len(x)))))
    starts = np.arange(n) * hop
    idx = starts[:, None] + np.arange(size)
    s = p[idx] if n else np.zeros((0, size))
    e0 = (s**2).sum(axis=1)
    out = np.zeros((n, lags))
    for m in range(1, lags + 1):
        t = p[np.minimum(idx + m, len(p) - 1)] * (idx + m < len(p)) if n else s
        out[:, m - 1] = (s * t).sum(axis=1) / (EPS + np.sqrt(e0 * (t**2).sum(axis=1)))
    return out[:, ::-1] if flip else out


def pitch_parts(x: np.ndarray, rate: int, size: int = 700, hop: int = 200, n_fft: int = 8192) -> dict[str, np.ndarray]:
    """What pitch tracking starts from: nlfer, voicing (nlfer > 0.75), shc of the squared signal, nccf of both."""
    a, b = bandpass(x, rate), bandpass(x**2, rate)
    low = nlfer(magnitude(a, size, hop, n_fft), rate, n_fft)
    return {"nlfer": low, "vuv": low > 0.75, "shc": shc(magnitude(b, size, hop, n_fft), rate, n_fft), "nccf": nccf(a, rate, size, hop, flip=True), "nccf_nonlinear": nccf(b, rate, size, hop, flip=True)}


def pitch_candidates(x: np.ndarray, rate: int, size: int, hop: int, f_min: float, f_max: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(frequency, merit) of each frame's best local maxima of the normalized cross-correlation between the lags of
    ``f_max`` and ``f_min``, each placed on the parabola through its neighbours; missing ones have frequency and merit 0.

    A maximum loses a little with its lag, so that of two equal ones the higher frequency is preferred.
    """
    c = nccf(x, rate, size, hop, f_min)
    n, lags = c.shape
    lo = max(1, int(np.ceil(rate / f_max)) - 1)
    left, mid, right = c[:, lo - 1 : lags - 2], c[:, lo : lags - 1], c[:, lo + 1 :]
    top = (mid > left) & (mid >= right) & (mid > 0)
    bend = left - 2 * mid + right
    shift = np.where(top & (bend < 0), 0.5 * (left - right) / np.where(bend < 0, bend, -1.0), 0.0)
    lag = np.arange(lo, lags - 1)[None, :] + 1 + shift
    merit = np.where(top, np.clip(mid - 0.25 * (left - right) * shift, 0, 1) - 0.05 * lag / lags, -1.0)
    if merit.shape[1] < most:
        merit, lag = (np.pad(v, ((0, 0), (0, most - merit.shape[1])), constant_values=w) for v, w in ((merit, -1.0), (lag, 1.0)))
    best = np.argsort(-merit, axis=1, kind="stable")[:, :most]
    merit, lag = np.take_along_axis(merit, best, 1), np.take_along_axis(lag, best, 1)
    return np.where(merit > 0, rate / np.maximum(lag, 1e-9), 0.0), np.maximum(merit, 0.0)


def f0_track(x: np.ndarray, rate: int, f_min: float = 60.0, f_max: float = 400.0, size: int = 400, hop: int = 200, interpolated: bool = False, most: int = 4, threshold: float = 0.5, octave: float = 0.6, switch: float = 0.25) -> np.ndarray:
    """(ceil(n / hop), 2): fundamental frequency, 0 where unvoiced, and whether the frame is voiced.

    Candidates of :func:`pitch_candidates` and one for no voice, of merit ``threshold``, compete along the cheapest
    path: a frame costs 1 - merit, a step ``octave`` for each octave between frequencies and ``switch`` for a change of
    voicing. Frames with a thousandth of the mean energy or less have no voice. ``interpolated`` draws lines through
    unvoiced stretches; beyond the last voiced frame its value is kept.
    """
    n = -(-len(x) // hop)
    if not n:
        return np.zeros((0, 2))
    x = np.asarray(x, float) - np.mean(x)
    freq, merit = pitch_candidates(x, rate, size, hop, f_min, f_max, most)
    padded = np.concatenate((x, np.zeros(size)))
    energy = np.array([(padded[i * hop : i * hop + size] ** 2).mean() for i in range(n)])
    merit = np.where((energy > 1e-3 * energy.mean())[:, None], merit, 0.0)
    freq = np.concatenate((freq, np.zeros((n, 1))), axis=1)
    cost = 1.0 - np.concatenate((np.where(freq[:, :-1] > 0, merit, -1.0), np.full((n, 1), threshold)), axis=1)
    total, back = cost[0], np.zeros((n, most + 1), int)
    for i in range(1, n):
        a, b = freq[i - 1][:, None], freq[i][None, :]
        both = (a > 0) & (b > 0)
        step = np.where(both, octave * np.abs(np.log2(np.where(both, b, 1.0) / np.where(both, a, 1.0))), np.where((a > 0) != (b > 0), switch, 0.0))
        ways = total[:, None] + step
        back[i] = ways.argmin(axis=0)
        total = ways.min(axis=0) + cost[i]
    at = np.empty(n, int)
    at[-1] = total.argmin()
    for i in range(n - 1, 0, -1):
        at[i - 1] = back[i, at[i]]
    f0 = freq[np.arange(n), at]
    voiced = f0 > 0
    if interpolated and voiced.any():
        f0 = np.interp(np.arange(n), np.flatnonzero(voiced), f0[voiced])
    return np.stack((fit_frames(f0, len(x), hop, interpolated), voiced.astype(float)), axis=1)


def find_peaks(x: np.ndarray, threshold: float, box: int = 3) -> np.ndarray:
    """(row, column) of values above ``threshold`` that are the greatest of the box around them."""
    x = np.atleast_2d(x)
    r = box // 2
    p = np.pad(x, r, constant_values=-np.inf)
    top = np.lib.stride_tricks.sliding_window_view(p, (2 * r + 1, 2 * r + 1)).max(axis=(2, 3))
    return np.argwhere((x == top) & (x > threshold))


def fit_frames(f0: np.ndarray, n_samples: int, hop: int, interpolated: bool = False) -> np.ndarray:
    """f0 padded to ceil(n / hop) frames, with its last value if interpolated, else with 0."""
    want = -(-n_samples // hop)
    fill = f0[-1] if interpolated and len(f0) else 0.0
    return np.concatenate((f0, np.full(max(0, want - len(f0)), fill)))[:want]


def feature_index(names: tuple[str, ...]) -> tuple[dict[str, int], dict[int, str]]:
    """Position of each feature by name, and name by position."""
    return {n: i for i, n in enumerate(names)}, dict(enumerate(names))


def apply_1d(x: Column, f: Callable[[np.ndarray], np.ndarray]) -> Column:
    """``f`` (signal -> one value a frame) on an array column; null stays null, NaN becomes null."""
    return _apply(x, lambda v: np.asarray(f(v), float), "array<double>")


def apply_2d(x: Column, f: Callable[[np.ndarray], np.ndarray]) -> Column:
    """``f`` (signal -> frames by values) on an array column; null stays null, NaN becomes null."""
    return _apply(x, lambda v: np.asarray(f(v), float), "array<array<double>>")


def _apply(x: Column, f: Callable[[np.ndarray], np.ndarray], kind: str) -> Column:
    """Signals as views of the Arrow batch in, the results of a batch as one Arrow list array out."""
    import pyarrow as pa

    ship(SparkSession.active())
    deep = kind.count("array") == 2

    def run(s):
        s = s.combine_chunks() if isinstance(s, pa.ChunkedArray) else s
        got = [f(np.asarray(v.values.to_numpy(zero_copy_only=False), float)) if v.is_valid else None for v in s]
        ends = lambda n: pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
        flat = np.concatenate([g.ravel() for g in got if g is not None] or [np.zeros(0)])
        out = pa.array(flat, mask=np.isnan(flat))
        rows = [0 if g is None else len(g) for g in got]
        if deep:
            widths = np.concatenate([np.full(len(g), g.shape[1]) for g in got if g is not None] or [np.zeros(0, int)])
            out = pa.ListArray.from_arrays(ends(widths), out)
        return pa.ListArray.from_arrays(ends(rows), out, mask=pa.array([g is None for g in got]))

    run.__annotations__ = {"s": pa.Array, "return": pa.Array}  # pa is known here only
    return F.arrow_udf(run, kind)(x)
