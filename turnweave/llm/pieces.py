"""Splitting oversized clips at pauses (problem 2).

A clip of more samples than its dataset allows is cut into pieces of at most that many; consecutive pieces overlap.
Every boundary between samples has a strength: one in a pause has the greatest, others are the stronger the quieter
their surroundings. A sparse table over the strengths answers, for each window of permissible lengths, where the
strongest cut is, the rightmost among equals; the next piece starts the overlap before it. As all boundaries in pauses
are equally strong, each cut in a pause is the latest possible one, which finds a way through pauses wherever one
exists. Clips are read in Arrow batches without a shuffle; only the piece bounds are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, floor

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.runtime import ship

PAUSE_SECONDS = 0.2
QUIET = 0.01
#: Levels of strength outside pauses; one in a pause has LOUD_LEVELS + 1.
LOUD_LEVELS = 62
#: clip_limits has one row for each dataset; more than this many are refused.
MOST_LIMITS = 10_000


class StrongestCut:
    """Sparse-table range maximum over strengths, the rightmost among equals.

    The table covers a stretch of at most ``reach`` boundaries at a time and is rebuilt when a query leaves it, so its
    size depends on the limit of a piece, not on the length of a clip.
    """

    def __init__(self, strength: np.ndarray, reach: int):
        self.strength, self.reach, self.at, self.levels = strength, max(reach, 1), -1, []

    def _build(self, lo: int) -> None:
        part = self.strength[lo : lo + 4 * self.reach].astype(np.int64)
        level = part * (1 << 32) + np.arange(len(part))  # the position breaks ties rightward
        self.at, self.levels = lo, [level]
        width = 1
        while 2 * width <= len(part):
            level = np.maximum(level[: len(level) - width], level[width:])
            self.levels.append(level)
            width *= 2

    def query(self, lo: int, hi: int) -> tuple[int, int]:
        """(position, strength) of the strongest boundary in [lo, hi]."""
        if self.at < 0 or lo < self.at or hi >= self.at + len(self.levels[0]):
            self._build(lo)
        k = (hi - lo + 1).bit_length() - 1
        level, a, b = self.levels[k], lo - self.at, hi - self.at - (1 << k) + 1
        best = int(max(level[a], level[b]))
        return self.at + (best & 0xFFFFFFFF), best >> 32


def active_spans(vad: list | None) -> list[tuple[float, float]]:
    """Merged [start, end) of activity in any channel; what is no pair of two finite numbers is ignored."""
    spans = []
    for channel in vad or ():
        for seg in channel or ():
            if seg is None or len(seg) != 2 or seg[0] is None or seg[1] is None:
                continue
            a, b = sorted(seg) if seg[0] == seg[0] and seg[1] == seg[1] else (0.0, 0.0)
            a = max(a, 0.0)
            if a < b < float("inf"):
                spans.append((a, b))
    out: list[tuple[float, float]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def strengths(channels: list[np.ndarray], vad: list | None, rate: float) -> np.ndarray:
    """Strength of each of the n + 1 boundaries of a clip of n samples."""
    n = max((len(c) for c in channels), default=0)
    loud = np.zeros(n, np.float32)
    for c in channels:
        size = np.abs(c)
        np.maximum(loud[: len(c)], np.where(np.isnan(size), np.inf, size), out=loud[: len(c)])
    pause = np.zeros(n + 1, bool)
    if vad is None:
        quiet = np.concatenate(([False], loud < QUIET, [False])).astype(np.int8)
        edge = np.diff(quiet)
        gaps = [(a / rate, b / rate) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]
    else:
        gaps, at = [], 0.0
        for a, b in active_spans(vad):
            gaps.append((at, a))
            at = b
        gaps.append((at, max(n / rate, at)))
    for a, b in gaps:
        if b - a >= PAUSE_SECONDS - 1e-9:
            pause[ceil(a * rate - 1e-6) : floor(min(b * rate, n) + 1e-6) + 1] = True
    both = np.concatenate((loud[:1], np.maximum(loud[1:], loud[:-1]), loud[-1:])) if n else np.zeros(1, np.float32)
    level = (LOUD_LEVELS * (1 - np.minimum(both, 1))).astype(np.uint8)
    return np.where(pause, np.uint8(LOUD_LEVELS + 1), level)


def cut_points(strength: np.ndarray, most: int, overlap: int) -> tuple[list[tuple[int, int, bool]], bool]:
    """([(start, end, ends in a pause)], whether every cut is in a pause) of pieces of at most ``most`` samples.

    An overlap that would leave no progress is shortened to half the limit, and the clip counts as forced.
    """
    n = len(strength) - 1
    fits = overlap < most
    if not fits:
        overlap = most // 2
    table = StrongestCut(strength, most)
    out, start, last, all_paused = [], 0, 0, fits
    while n - start > most:
        lo = max(last + 1, overlap)
        at, s = table.query(lo, start + most)
        paused = s > LOUD_LEVELS
        out.append((start, at, paused))
        all_paused &= paused
        start, last = at - overlap, at
    out.append((start, n, True))
    return out, all_paused


def _limits(clip_limits: DataFrame) -> dict[str, tuple[float, float, float]]:
    rows = clip_limits.select("dataset_name", "max_seconds", "overlap_seconds", "default_rate").limit(MOST_LIMITS + 1).collect()
    if len(rows) > MOST_LIMITS:
        raise ValueError("clip_limits has one row for each dataset")
    return {r[0]: (r[1], r[2] or 0.0, r[3]) for r in rows if r[0] is not None and r[1] and r[1] > 0}


def pieces(clips: DataFrame, clip_limits: DataFrame, with_samples: bool = False) -> DataFrame:
    """(clip_id, kind, piece, start_sample, end_sample, rate, cut) of the clips over their limit; with ``with_samples``
    also ``samples``: the piece of each channel.

    kind ``pause`` if every cut lies in a pause, else ``forced``; cut says so for the piece's own end (``end`` for the
    last). Of the rows with one clip_id the last loaded holds, the first by its content among equals. Clips with a
    null id or dataset, without limit, samples or rate, and those within the limit have no rows. Null samples count as
    loud. Declared durations and frame counts are not used. Other columns are ignored.
    """
    import pyarrow as pa

    ship(clips.sparkSession)
    limits = _limits(clip_limits)
    c = clips.select("clip_id", "dataset_name", "sample_rate", "vad", "loaded_at", "waveform").where("clip_id is not null")
    fields = "clip_id bigint, loaded_at {}, kind string, pieces array<struct<piece: int, start_sample: bigint, end_sample: bigint, rate: double, cut: string{}>>"
    samples = pa.list_(pa.list_(pa.float32()))
    shape = [("piece", pa.int32()), ("start_sample", pa.int64()), ("end_sample", pa.int64()), ("rate", pa.float64()), ("cut", pa.string())] + ([("samples", samples)] if with_samples else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, rates, vads, waves = (b.column(x) for x in ("dataset_name", "sample_rate", "vad", "waveform"))
            kinds, found = [], []
            for i in range(b.num_rows):
                limit = limits.get(names[i].as_py())
                rate = rates[i].as_py() or (limit and limit[2])
                wave = waves[i].values
                kind, got = None, []
                if limit and rate and rate > 0 and wave is not None:
                    chans = [np.asarray(x.values.to_numpy(zero_copy_only=False), np.float32) for x in wave if x.values is not None]
                    n = max((len(x) for x in chans), default=0)
                    most = floor(limit[0] * rate + 1e-6)
                    if n > limit[0] * rate + 1e-9 and most > 0:
                        cuts, paused = cut_points(strengths(chans, vads[i].as_py(), rate), most, ceil(limit[1] * rate - 1e-6))
                        kind = "pause" if paused else "forced"
                        got = [(k, s, e, float(rate), "end" if e == n else "pause" if p else "forced", *([[x[s:e].tolist() for x in chans]] if with_samples else [])) for k, (s, e, p) in enumerate(cuts)]
                kinds.append(kind)
                found.append([dict(zip((x for x, _ in shape), g)) for g in got])
            yield pa.RecordBatch.from_arrays([b.column("clip_id"), b.column("loaded_at"), pa.array(kinds, pa.string()), pa.array(found, pa.list_(pa.struct(shape)))], names=["clip_id", "loaded_at", "kind", "pieces"])

    t = c.schema["loaded_at"].dataType.simpleString()
    each = c.mapInArrow(run, fields.format(t, ", samples: array<array<float>>" if with_samples else ""))
    last = each.groupBy("clip_id").agg(F.max_by(F.struct("kind", "pieces"), F.struct("loaded_at", "kind")).alias("x"))
    return last.where("x.kind is not null").select("clip_id", F.col("x.kind").alias("kind"), F.inline("x.pieces"))


def found(clips: DataFrame, clip_limits: DataFrame) -> DataFrame:
    return pieces(clips, clip_limits).where("piece = 0").select("clip_id", "kind")
