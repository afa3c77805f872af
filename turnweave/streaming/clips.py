"""Structured Streaming variants, an extension: windows and pauses over utterances as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sliding_activity(utterances: DataFrame, time: str, seconds: str, keys: list[str], duration: str = "10 seconds", step: str = "8 seconds", late: str = "1 minute") -> DataFrame:
    """Speech seconds and utterances of each sliding window; rows later than ``late`` are left out."""
    w = F.window(time, duration, step)
    return utterances.withWatermark(time, late).groupBy(*keys, w).agg(F.sum(seconds).alias("speech"), F.count(F.lit(1)).alias("utterances")).select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "speech", "utterances")


def units(utterances: DataFrame, time: str, keys: list[str], pause: str = "200 milliseconds", late: str = "1 minute") -> DataFrame:
    """Stretches of utterances that follow each other within ``pause``, as session windows."""
    w = F.session_window(time, pause)
    return utterances.withWatermark(time, late).groupBy(*keys, w).agg(F.count(F.lit(1)).alias("utterances")).select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "utterances")
