"""Dialogue audio: sessions and segments to clips with waveform, activity and activity history."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnweave.functions import arrays as A
from turnweave.operators import vad as V
from turnweave.operators.cumulate import numbered
from turnweave.operators.islands import BUCKET_FRAMES, ipu_ends
from turnweave.operators.windows import ipu_clips, sliding_clips

#: Seconds of a signal in one block.
WAVE_SECONDS = 60


@dataclass
class DialogAudio:
    """The flow from (session, duration) and (session, channel, start, end) segments to samples.

    ``kind`` is ``sliding`` or ``ipu``. All settings reach every step, those of pauses too. Frames come from one
    expansion of the segments, which clips, history and labels share.
    """

    kind: str = "sliding"
    duration: float = 10.0
    overlap: float = 2.0
    context: float = 8.0
    pause: float = 0.2
    least: float = 1.0
    hz: int = 100
    horizon: float = 2.0
    history_times: list[float] = field(default_factory=lambda: [60, 30, 10, 5])
    flip_share: float = 0.5
    seed: int = 1234

    @property
    def hop(self) -> float:
        return 1.0 / self.hz

    def _f(self, seconds: float) -> int:
        return int(seconds * self.hz + 1e-9)

    def segments(self, sessions: DataFrame, segments: DataFrame) -> DataFrame:
        s = segments.join(sessions.select("session", "duration"), "session")
        return V.to_frames(s, "start", "end", self.hop, F.col("duration") / self.hop).select("session", "channel", "sf", "ef", "total")

    def clips(self, sessions: DataFrame, segments: DataFrame) -> DataFrame:
        """(session, clip, start, end, kind)."""
        if self.kind == "sliding":
            return sliding_clips(sessions, ["session"], "duration", self.duration, self.overlap).withColumn("kind", F.lit("sliding"))
        ends = ipu_ends(self.segments(sessions, segments), ["session"], "channel", "sf", "ef", "total", self._f(self.pause), self._f(self.least), self._f(self.duration), self._f(self.context))
        c = ipu_clips(ends, ["session"], "channel", "ef", self._f(self.context), self._f(self.duration))
        c = numbered(c, ["session"], ["start_frame", "channel"], F.floor(F.col("start_frame") / BUCKET_FRAMES), "clip")
        return c.select("session", "clip", (F.col("start_frame") * self.hop).alias("start"), (F.col("end_frame") * self.hop).alias("end"), F.lit("ipu").alias("kind"))

    def blocks(self, sessions: DataFrame, segments: DataFrame) -> DataFrame:
        """Activity and its history in blocks of frames, all blocks of every session."""
        return V.history_blocks(V.blocks(self.segments(sessions, segments), ["session"], self._totals(sessions)), ["session"], V.history_edges(self.history_times, self.hop))

    def _totals(self, sessions: DataFrame) -> DataFrame:
        return sessions.select("session", (F.col("duration") / self.hop).cast("int").alias("total"))

    @property
    def _histories(self) -> list[str]:
        return [f"h{i}" for i in range(len(self.history_times) + 1)]

    def _rows(self, arrays: DataFrame) -> DataFrame:
        """``vad`` and ``history`` as an array a frame, from one array a column."""
        hs = self._histories
        h = F.transform(F.arrays_zip(*hs), lambda x: F.array(*(x[c] for c in hs)))
        vad = F.zip_with("v0", "v1", lambda a, b: F.array(a.cast("int"), b.cast("int")))
        return arrays.withColumns({"vad": vad, "history": h}).drop("v0", "v1", *hs)

    def samples(self, sessions: DataFrame, segments: DataFrame, signals: DataFrame | None = None, train: bool = False, features: Callable[[Column], Column] | None = None, transforms: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """(session, clip, start, end, kind, vad, history[, waveform, sample_rate][, features]): one row a clip.

        ``vad`` is [v0, v1] a frame up to the horizon past the end, 0 beyond the session; ``history`` covers the clip,
        0.5 beyond. ``signals``: (session, sample_rate, waveform), one row a session; each is cut into blocks that are
        joined by their number, so no clip meets more of a signal than the blocks it touches. ``features`` makes a
        column of the clip's waveform, ``transforms`` is applied to the samples last. For training, a share of the
        clips has its two speakers (and waveform channels) swapped, drawn from a hash of session and clip.
        """
        clips = self.clips(sessions, segments)
        n, ahead = self._f(self.duration), self._f(self.horizon)
        at = F.round(F.col("start") * self.hz).cast("int")
        active = V.blocks(self.segments(sessions, segments), ["session"], self._totals(sessions))
        out = V.clip_histories(clips.withColumn("start_frame", at), active, ["session"], V.history_edges(self.history_times, self.hop), n, ahead).drop("start_frame")
        if signals is not None:
            out = out.hint("merge").join(clip_waves(clips, signals).hint("merge"), ["session", "clip"])
        if train:
            draw = F.pmod(F.xxhash64(F.lit(self.seed), "session", "clip"), F.lit(1 << 20)) / float(1 << 20) < self.flip_share
            out = out.withColumn("flipped", draw).withColumn("vad", F.when(draw, F.transform("vad", F.reverse)).otherwise(F.col("vad")))
            out = out.withColumn("history", F.when(draw, F.transform("history", lambda h: F.transform(h, lambda x: 1 - x))).otherwise(F.col("history")))
            if signals is not None:
                out = out.withColumn("waveform", F.when(draw, A.flip_channels(F.col("waveform"))).otherwise(F.col("waveform")))
        if features is not None:
            out = out.withColumn("features", features(F.col("waveform")))
        return out.transform(transforms) if transforms is not None else out

    def dialogs(self, sessions: DataFrame, segments: DataFrame, signals: DataFrame | None = None, flip: bool = False) -> DataFrame:
        """(session, vad, history[, waveform]): whole dialogues, the horizon appended to ``vad`` as zeros.

        A row holds a whole dialogue, which is what is asked for; only blocks of arrays are gathered for it.
        """
        hs = self._histories
        f = self.blocks(sessions, segments)
        if flip:
            f = V.flip(f).withColumns({h: F.transform(h, lambda x: 1 - x) for h in hs})
        g = f.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("block", "v0", "v1", *hs))).alias("_x"))
        whole = g.select("session", *(F.flatten(f"_x.{c}").alias(c) for c in ("v0", "v1", *hs)))
        zeros = F.array_repeat(F.array(F.lit(0), F.lit(0)), self._f(self.horizon))
        out = self._rows(whole).withColumn("vad", F.concat("vad", zeros))
        if signals is None:
            return out
        out = out.join(signals, "session")
        return out.withColumn("waveform", A.flip_channels(F.col("waveform"))) if flip else out


def clip_waves(clips: DataFrame, signals: DataFrame) -> DataFrame:
    """(session, clip, sample_rate, waveform): samples [start, end) of each clip, offsets truncated; what lies past the
    end of a channel is missing. Clips of sessions without a signal or rate have no row."""
    size = (F.col("sample_rate") * WAVE_SECONDS).cast("int")
    s = signals.where("sample_rate > 0 and waveform is not null")
    longest = F.coalesce(F.array_max(F.transform("waveform", F.size)), F.lit(0))
    cut_up = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(longest / size), F.lit(1)).cast("int") - 1), lambda k: F.transform("waveform", lambda ch: F.slice(ch, k * size + 1, size)))
    blocks = s.select("session", F.posexplode(cut_up).alias("block", "_w"))
    c = clips.join(s.select("session", "sample_rate"), "session")
    a, b = (F.greatest((F.col(x) * F.col("sample_rate")).cast("int"), F.lit(0)) for x in ("start", "end"))
    p = c.select("session", "clip", "sample_rate", a.alias("_a"), b.alias("_b"), F.explode(F.sequence(F.floor(a / size).cast("int"), F.greatest(F.floor((b - 1) / size), F.floor(a / size)).cast("int"))).alias("block"))
    at = F.col("block") * size
    first, until = F.greatest(F.col("_a") - at, F.lit(0)), F.least(F.col("_b") - at, size)
    j = p.join(blocks, ["session", "block"], "left").select("session", "clip", "sample_rate", "block", F.transform("_w", lambda ch: F.slice(ch, first + 1, F.greatest(until - first, F.lit(0)))).alias("_w"))
    g = j.groupBy("session", "clip").agg(F.max("sample_rate").alias("sample_rate"), F.array_sort(F.collect_list(F.struct("block", "_w"))).alias("_x"))
    channels = F.coalesce(F.array_max(F.transform("_x._w", F.size)), F.lit(0))
    empty = F.array().cast(signals.schema["waveform"].dataType.elementType)
    whole = F.transform(F.when(channels > 0, F.sequence(F.lit(0), channels - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.flatten(F.transform("_x._w", lambda w: F.coalesce(F.get(w, i), empty))))
    return g.select("session", "clip", "sample_rate", whole.alias("waveform"))
