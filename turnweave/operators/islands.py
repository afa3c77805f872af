"""Gaps and islands: runs of equal neighbours, merged in order.

Each operator sorts a key's rows by time or position. Where a key may be hot, its rows are cut into buckets of the
order, runs are built in each bucket, and only the first and last run of a bucket (at most two rows) are looked at
again to join runs across a bucket's edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnweave.runtime import carry_over_buckets, null_safe_join

#: Frames of a bucket in which units are built, an hour at 100 Hz.
BUCKET_FRAMES = 360_000


def _partial(kind: str, col: str, order: list[str]) -> Column:
    if kind == "text":
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(col).alias("_text")))), lambda x: x["_text"]), " ")
    return getattr(F, kind)(col)


def merge_runs(df: DataFrame, keys: list[str], order: list[str], value: str, bucket: Column, aggs: dict[str, tuple[str, str]]) -> DataFrame:
    """One row for each maximal run of equal ``value`` in ``order`` within ``keys``: keys, value and ``aggs``.

    ``aggs``: name -> (``min``, ``max``, ``sum`` or ``text``, column); ``text`` joins strings by a blank in order.
    ``bucket`` must not decrease along ``order``. ``order`` should tell rows apart; nulls in it come first. Null keys
    and null values are equal to each other.
    """
    b = df.withColumn("_b", bucket)
    w = Window.partitionBy(*keys, "_b").orderBy(*order)
    changed = (F.row_number().over(w) == 1) | ~F.lag(value).over(w).eqNullSafe(F.col(value))
    runs = (
        b.withColumn("_new", changed.cast("int"))
        .withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_b", "_run")
        .agg(F.min(value).alias(value), *(_partial(kind, col, order).alias(name) for name, (kind, col) in aggs.items()))
        .withColumn("_last", F.max("_run").over(Window.partitionBy(*keys, "_b")))
    )
    inner = runs.where("_run > 1 and _run < _last").select(*keys, value, *aggs)
    w2 = Window.partitionBy(*keys).orderBy("_b", "_run")
    apart = (F.row_number().over(w2) == 1) | ~F.lag(value).over(w2).eqNullSafe(F.col(value)) | F.lag("_b").over(w2).eqNullSafe(F.col("_b"))
    edge = (
        runs.where("_run = 1 or _run = _last")
        .withColumn("_new", apart.cast("int"))
        .withColumn("_chain", F.sum("_new").over(w2.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_chain")
        .agg(F.min(value).alias(value), *(_partial(kind, name, ["_b", "_run"]).alias(name) for name, (kind, _) in aggs.items()))
        .select(*keys, value, *aggs)
    )
    return inner.unionByName(edge)


def run_lengths(df: DataFrame, keys: list[str], order: list[str], value: str, bucket: Column) -> DataFrame:
    """(keys, value, start, length): maximal runs of equal neighbours; ``start`` is the first value of ``order[0]``."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    return merge_runs(one, keys, order, value, bucket, {"start": ("min", order[0]), "length": ("sum", "_one")})


def merge_turns(turns: DataFrame, keys: list[str], turn: str = "turn", speaker: str = "speaker", text: str = "text") -> DataFrame:
    """(keys, speaker, turn, text): consecutive turns of one speaker joined by a blank; ``turn`` is the first's number.

    A null text adds nothing to its turn.
    """
    return merge_runs(turns, keys, [turn], speaker, F.floor(F.col(turn) / 4096), {"_t": ("min", turn), "_x": ("text", text)}).select(*keys, speaker, F.col("_t").alias(turn), F.col("_x").alias(text))


def merge_utterances(utts: DataFrame, keys: list[str], order: str, speaker: str = "speaker", start: str = "start", end: str = "end", text: str = "text") -> DataFrame:
    """As :func:`merge_turns` with times: the first start and the **last** row's end, which need not be the greatest."""
    at = lambda c, n: F.struct(F.col(order).alias("o"), F.col(c).alias("x")).alias(n)
    both = utts.select("*", at(start, "_begin"), at(end, "_stop"))
    m = merge_runs(both, keys, [order], speaker, F.floor(F.col(order) / 4096), {"_o": ("min", order), "_s": ("min", "_begin"), "_e": ("max", "_stop"), "_x": ("text", text)})
    return m.select(*keys, speaker, F.col("_o").alias(order), F.col("_s.x").alias(start), F.col("_e.x").alias(end), F.col("_x").alias(text))


def word_gap_segments(words: DataFrame, keys: list[str], order: str, start: str = "start", end: str = "end", min_gap: float = 0.05, bucket: Column | None = None) -> DataFrame:
    """(keys, start, end): words of an utterance (``keys``) joined while the next starts less than ``min_gap`` after
    the end of the **previous** word; the end is the last word's.

    ``bucket`` must not decrease along ``order``; without it, 4096 steps of ``order`` are one. The end of the word
    before a bucket and the number of earlier segments are carried into it.
    """
    b = words.withColumn("_b", bucket if bucket is not None else F.floor(F.col(order) / 4096))
    w = Window.partitionBy(*keys, "_b").orderBy(order)
    ends = carry_over_buckets(b.groupBy(*keys, "_b").agg(F.max_by(end, order).alias("_e")), keys, "_b", {"_prev": (F.struct("_e"), "last_before")})
    j = null_safe_join(b, ends, [*keys, "_b"])
    before = F.when(F.row_number().over(w) == 1, F.col("_prev._e")).otherwise(F.lag(end).over(w))
    seg = _segments(j.withColumn("_new", F.coalesce(F.col(start) - before >= min_gap, F.lit(True)).cast("int")), keys, w)
    return seg.groupBy(*keys, "_seg").agg(F.min_by(start, order).alias(start), F.max_by(end, order).alias(end)).drop("_seg")


def _segments(marked: DataFrame, keys: list[str], w) -> DataFrame:
    """``_seg``: the running number of segments over buckets ``_b``, from ``_new`` at each segment's first row."""
    c = marked.withColumn("_in", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    base = carry_over_buckets(c.groupBy(*keys, "_b").agg(F.sum("_new").alias("_n")), keys, "_b", {"_base": (F.col("_n"), "before")})
    return null_safe_join(c, base, [*keys, "_b"]).withColumn("_seg", F.col("_base") + F.col("_in"))


def ipu_units(frames: DataFrame, keys: list[str], channel: str, start: str, end: str, total: str, pause: int) -> DataFrame:
    """(keys, channel, total, start, end) in frames: activity with every silence shorter than ``pause`` bridged.

    ``frames`` has half-open intervals [start, end) in frames and the number of frames of the whole signal. Silence at
    both ends counts too; a channel without activity is one unit if the whole signal is shorter than ``pause``. Rows
    with start >= end stand for a channel without activity there. Intervals are sorted in buckets of BUCKET_FRAMES;
    how far earlier buckets reach is carried.
    """
    k = [*keys, channel]
    full = frames.where(F.col(start) < F.col(end)).withColumn("_b", F.floor(F.col(start) / BUCKET_FRAMES))
    w = Window.partitionBy(*k, "_b").orderBy(start, end)
    reached = carry_over_buckets(full.groupBy(*k, "_b").agg(F.max(end).alias("_m")), k, "_b", {"_far": (F.col("_m"), "max_before")})
    j = null_safe_join(full, reached, [*k, "_b"])
    gap = F.col(start) - F.greatest(F.col("_far"), F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    seg = _segments(j.withColumn("_new", F.coalesce(((gap > 0) & (gap >= pause)).cast("int"), F.lit(1))), k, w)
    units = seg.groupBy(*k, "_seg").agg(F.min(start).alias(start), F.max(end).alias(end), F.max(total).alias(total))
    last = units.groupBy(*k).agg(F.max("_seg").alias("_last"))
    units = null_safe_join(units, last, k)
    first = F.when((F.col("_seg") == 1) & (F.col(start) < pause), 0).otherwise(F.col(start))
    until = F.when((F.col("_seg") == F.col("_last")) & (F.col(total) - F.col(end) < pause), F.col(total)).otherwise(F.col(end))
    units = units.select(*k, total, first.alias("_a"), until.alias("_b")).select(*k, total, F.col("_a").alias(start), F.col("_b").alias(end))
    silent = frames.groupBy(*k).agg(F.max(total).alias(total), F.max(F.col(start) < F.col(end)).alias("_any")).where(~F.col("_any") & (F.col(total) < pause))
    return units.unionByName(silent.select(*k, total, F.lit(0).cast(frames.schema[start].dataType).alias(start), F.col(total).cast(frames.schema[end].dataType).alias(end)))


def ipu_ends(frames: DataFrame, keys: list[str], channel: str, start: str, end: str, total: str, pause: int, least: int, duration: int, context: int = -1) -> DataFrame:
    """(keys, channel, end) of the inter-pausal units of at least ``least`` frames at which a clip may be anchored.

    ``context`` > 0 frames must lie before the end, and ``duration - context`` after it.
    """
    u = ipu_units(frames, keys, channel, start, end, total, pause).where(F.col(end) - F.col(start) >= least)
    if context > 0:
        u = u.where(F.col(end) >= context)
    return u.where(F.col(end) < F.col(total) - (duration - context)).select(*keys, channel, end)
