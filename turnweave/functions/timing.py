"""Time, sample and frame arithmetic. All conversions to whole numbers truncate toward zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def samples_to_frames(samples: Column, hop: Column | int) -> Column:
    return (samples / hop).cast("int")


def sample_to_time(n: Column, rate: Column | int) -> Column:
    return n / rate


def frames_to_time(frames: Column, hop_time: Column | float) -> Column:
    return frames * hop_time


def time_to_frames(t: Column, hop_time: Column | float) -> Column:
    return (t / hop_time).cast("int")


def time_to_frames_samples(t: Column, rate: Column | int, hop: Column | int) -> Column:
    return (t * rate / hop).cast("int")


def time_to_samples(t: Column, rate: Column | int) -> Column:
    return (t * rate).cast("int")


def frame_count(samples: Column, hop: Column | int) -> Column:
    return F.ceil(samples / hop)


def inverse(x: Column, eps: float = 1e-9) -> Column:
    return 1.0 / (x + eps)


def epoch_seconds(ts: Column) -> Column:
    """Seconds of a timestamp with or without zone, as a double; the session's zone should be UTC."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6
