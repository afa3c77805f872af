"""Continuous periods and gaps from overlapping, nested or repeated intervals (sweep line).

Every interval becomes a plus event at its start and a minus event at its end; events of one moment are summed
before the shuffle, a prefix sum over time gives the number of open intervals, and the moments at which it leaves or
reaches zero bound the periods and the gaps.

The sweep is split by time: a key's events are cut into buckets of ``bucket_us`` microseconds, each swept on its own,
and the number of intervals still open is carried from bucket to bucket through a table with one row for each
bucket. A key that holds a third of all rows is therefore spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnweave.runtime import carry_over_buckets, null_safe_join

#: One hour of time to a bucket.
BUCKET_US = 3_600_000_000
#: The last moment, in microseconds; as a double it is a whole number below the greatest long.
LAST_US = 9.2e18


def vad_segments(vad_lists: DataFrame) -> DataFrame:
    """(session, reel, channel, start_us, end_us) of the valid segments of ``vad[channel][segment]``.

    Valid is a pair of two finite numbers, its ends in either order. Time before 0 is cut off, as is time past the
    last microsecond that a long holds (LAST_US, 290,000 years); what has no length then is left out, as is anything
    malformed: null lists, channels and segments, other lengths, NaN and infinity. ``time_unit`` ``ms``
    (read without regard to case and blanks) gives milliseconds, anything else seconds. Times are taken to whole
    microseconds. Null sessions and reels are keys like any other.
    """
    scale = F.when(F.lower(F.trim("time_unit")) == "ms", F.lit(1e3)).otherwise(F.lit(1e6))
    flat = (
        vad_lists.select("session", "reel", scale.alias("scale"), F.posexplode("vad").alias("channel", "segs"))
        .select("session", "reel", "channel", "scale", F.explode("segs").alias("seg"))
    )
    us = lambda c: F.least(F.round(F.col(c) * F.col("scale")), F.lit(LAST_US)).cast("long")
    return valid_pairs(flat, "seg").select("session", "reel", "channel", us("start").alias("start_us"), us("end").alias("end_us")).where("start_us < end_us")


def valid_pairs(df: DataFrame, pair: str) -> DataFrame:
    """Rows whose ``pair`` is one of two finite numbers in either order, with ``start`` and ``end`` in place of it: time
    before 0 is cut off, and what has no length then is left out."""
    a, b = (F.get(pair, F.lit(i)) for i in (0, 1))
    finite = lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))  # noqa: E731  NaN is above infinity
    ok = df.where((F.size(pair) == 2) & finite(a) & finite(b))
    return ok.withColumns({"start": F.greatest(F.least(a, b), F.lit(0.0)), "end": F.greatest(a, b)}).drop(pair).where("start < end")


def sweep(segments: DataFrame, keys: list[str], start: str, end: str, bucket_us: int = BUCKET_US) -> DataFrame:
    """(keys, kind, start, end): kind ``period`` for each maximal union of overlapping or touching intervals, ``gap``
    for each stretch between two neighbouring periods of a key.

    Intervals without a length, with a null end or with ends in the wrong order count as none; repeated ones change
    nothing; an empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    names = {k: f"_k{i}" for i, k in enumerate(keys)}
    ks = list(names.values())
    seg = segments.select(*(F.col(k).alias(n) for k, n in names.items()), F.col(start).alias("_s"), F.col(end).alias("_e")).where("_s < _e")
    ends = F.array(F.struct(F.col("_s").alias("t"), F.lit(1).alias("d")), F.struct(F.col("_e").alias("t"), F.lit(-1).alias("d")))
    events = (
        seg.select(*ks, F.inline(ends))
        .groupBy(*ks, "t").agg(F.sum("d").alias("d"))
        .withColumn("b", F.floor(F.col("t") / F.lit(bucket_us)))
    )
    open_before = carry_over_buckets(events.groupBy(*ks, "b").agg(F.sum("d").alias("net")), ks, "b", {"open0": (F.col("net"), "before")})
    w = Window.partitionBy(*ks, "b").orderBy("t")
    edges = (
        null_safe_join(events, open_before, ks + ["b"])
        .withColumn("now", F.col("open0") + F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("was", F.col("now") - F.col("d"))
        .where("(was = 0) <> (now = 0)")
        .select(*ks, "b", "t", (F.col("now") > 0).alias("opens"))
    )
    first = carry_over_buckets(edges.groupBy(*ks, "b").agg(F.min("t").alias("t0")), ks, "b", {"later": (F.col("t0"), "first_after")})
    out = (
        null_safe_join(edges.withColumn("next", F.lead("t").over(w)), first, ks + ["b"])
        .withColumn("next", F.coalesce("next", "later"))
        .where("next is not null")
    )
    return out.select(*(F.col(n).alias(k) for k, n in names.items()), F.when(F.col("opens"), "period").otherwise("gap").alias("kind"), F.col("t").alias(start), F.col("next").alias(end))


def periods_and_gaps(vad_lists: DataFrame, bucket_us: int = BUCKET_US) -> DataFrame:
    """(session, reel, channel, kind, start_ms, end_ms) of ``vad_lists``, in whole milliseconds, rounded."""
    out = sweep(vad_segments(vad_lists), ["session", "reel", "channel"], "start_us", "end_us", bucket_us)
    return out.select("session", "reel", "channel", "kind", *(F.round(F.col(f"{x}_us") / 1000).cast("long").alias(f"{x}_ms") for x in ("start", "end")))
