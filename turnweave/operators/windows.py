"""Clips: sliding, anchored at pauses, overlapping batches, windows before a response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnweave.functions.signal import frames as unfold


def sliding_clips(sessions: DataFrame, keys: list[str], duration: str = "duration", clip: float = 10.0, overlap: float = 2.0) -> DataFrame:
    """(keys, clip, start, end): clips of ``clip`` seconds every ``clip - overlap``, the last incomplete one dropped."""
    if overlap >= clip:
        raise ValueError("the overlap must be shorter than the clip")
    step = clip - overlap
    n = ((F.col(duration) - clip) / step + 1).cast("int")
    c = sessions.withColumn("_n", n).where("_n > 0").select(*keys, F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("clip"))
    return c.select(*keys, "clip", (F.col("clip") * step).alias("start"), (F.col("clip") * step + clip).alias("end"))


def ipu_clips(ends: DataFrame, keys: list[str], channel: str, end: str, context: int, duration: int) -> DataFrame:
    """(keys, channel, start_frame, end_frame) of clips of ``duration`` frames whose context ends at a unit's end."""
    return ends.select(*keys, channel, (F.col(end) - context).alias("start_frame"), (F.col(end) - context + duration).alias("end_frame"))


def batches(signals: DataFrame, keys: list[str], samples: str, size: int, hop: int, batch: int = 16) -> DataFrame:
    """(keys, batch_id, item, samples): overlapping cuts of each signal, numbered in batches of ``batch``."""
    e = signals.select(*keys, F.posexplode(unfold(F.col(samples), size, hop)).alias("_i", "samples"))
    return e.select(*keys, F.floor(F.col("_i") / batch).cast("int").alias("batch_id"), (F.col("_i") % batch).alias("item"), "samples")


def response_offsets(end: Column, rate: int, seconds: float, lead: int = 0) -> tuple[Column, Column]:
    """(offset, length) in samples of the audio before a response: clamped at 0 and shortened by what was cut off."""
    want = int(seconds * rate)
    raw = (end * rate).cast("int") - want - lead
    return F.greatest(raw, F.lit(0)), F.when(raw < 0, F.greatest(F.lit(want) + raw, F.lit(0))).otherwise(F.lit(want))


def random_segment(key: Column, length: Column, want: float, seed: int = 1234) -> Column:
    """A start in [0, length - want) drawn from a hash of ``key``, 0 for shorter items."""
    unit = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) / float(1 << 30)
    return F.greatest((length - want) * unit, F.lit(0.0))
