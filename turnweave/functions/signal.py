"""Waveforms as arrays: framing, levels and normalization, in higher-order functions inside the JVM.

Frames are arrays of their own here, which suits short arrays; for long signals the same levels are in ``features``, on
views of Arrow batches.
"""

from __future__ import annotations

from math import cos, pi

from pyspark.sql import Column
from pyspark.sql import functions as F

NORMALIZE_ABOVE = 0.05


def frames(x: Column, size: int, hop: int) -> Column:
    """Frames of ``size`` every ``hop`` samples, the incomplete tail dropped; none for a shorter signal."""
    last = F.size(x) - size
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last, F.lit(hop)), lambda i: F.slice(x, i + 1, size))).otherwise(F.array().cast("array<array<double>>"))


def pad_reflect(x: Column, pad: int) -> Column:
    """``pad`` samples mirrored at both ends, the end sample itself not repeated; needs more than ``pad`` samples."""
    return F.concat(F.reverse(F.slice(x, 2, pad)), x, F.reverse(F.slice(x, F.size(x) - pad, pad)))


def pad_zero(x: Column, left: int, right: int = 0) -> Column:
    z = lambda n: F.array_repeat(F.lit(0.0), n)
    return F.concat(z(left), x, z(right))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def root_mean_square(frame: Column) -> Column:
    return F.sqrt(F.aggregate(frame, F.lit(0.0), lambda a, v: a + v * v) / F.size(frame))


def rms(x: Column, size: int, hop: int, center: bool = True) -> Column:
    """RMS of each frame, mirrored at the ends if centred."""
    return F.transform(frames(pad_reflect(x, size // 2) if center else x, size, hop), root_mean_square)


def zero_crossings(x: Column) -> Column:
    """Whether the sign bit changes at each sample; never at the first. The sign of -0.0 counts as plus."""
    return F.transform(x, lambda v, i: (i > 0) & ((v < 0) != (F.get(x, i - 1) < 0)))


def crossing_rate(frame: Column) -> Column:
    n = F.size(frame)
    crossed = F.zip_with(F.slice(frame, 2, F.greatest(n - 1, F.lit(0))), F.slice(frame, 1, F.greatest(n - 1, F.lit(0))), lambda b, a: F.when((b < 0) != (a < 0), 1.0).otherwise(0.0))
    return total(crossed) / n


def zero_crossing_rate(x: Column, size: int, hop: int, center: bool = True) -> Column:
    """Share of sign changes in each frame, zeros at the ends if centred."""
    return F.transform(frames(pad_zero(x, size // 2, size // 2) if center else x, size, hop), crossing_rate)


def peak(x: Column) -> Column:
    return F.array_max(F.transform(x, F.abs))


def peak_normalize(x: Column, above: float = NORMALIZE_ABOVE) -> Column:
    """Divided by the greatest size if that exceeds ``above``."""
    p = peak(x)
    return F.when(p > above, F.zip_with(x, _each(p, x), lambda v, q: v / q)).otherwise(x)


def _each(value: Column, x: Column) -> Column:
    """``value`` once for each element of x: inside a lambda it would be computed again for every element."""
    return F.array_repeat(value, F.size(x))


def to_mono(a: Column, b: Column, normalize: bool = False) -> Column:
    """Mean of two channels; the shorter one counts as 0 beyond its end."""
    m = F.zip_with(a, b, lambda x, y: (F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0))) / 2)
    return peak_normalize(m) if normalize else m


def time_slice(x: Column, start: Column, end: Column, rate: Column) -> Column:
    """Samples of [start, end) seconds, offsets truncated; what lies past the end is missing."""
    a, b = (start * rate).cast("int"), (end * rate).cast("int")
    return F.slice(x, F.greatest(a, F.lit(0)) + 1, F.greatest(b - F.greatest(a, F.lit(0)), F.lit(0)))


def hann(n: int) -> list[float]:
    """Periodic Hann window."""
    return [0.5 - 0.5 * cos(2 * pi * i / n) for i in range(n)]


def weighted(frame: Column, window: list[float]) -> Column:
    """The frame less its mean, times the window."""
    level = F.zip_with(frame, _each(total(frame) / F.size(frame), frame), lambda v, m: v - m)
    return F.zip_with(level, F.array(*map(F.lit, window)), lambda v, w: v * w)
