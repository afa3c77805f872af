"""Voice activity: intervals to frames, clip windows, activity history.

Frames travel as arrays, one row for each block of BLOCK frames of a session, built from the ends of intervals in Arrow
batches: an hour at 100 Hz is 176 rows of two byte arrays, not 360,000 rows. A long or hot session is as many rows as it
has blocks. Clips meet blocks by equality of the block number and take slices; histories look back over the blocks they
need. Rows of single frames are exploded at the very end, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnweave.runtime import carry_over_buckets, cut, ship, spread

#: Frames in a block.
BLOCK = 2048
#: Blocks turned into arrays at a time: bounds the memory of a Python worker, whatever the Arrow batch.
AT_A_TIME = 256
#: Clips whose histories are made at a time, and blocks with clips.
CLIPS_AT_A_TIME = 64


def vad_list(utts: DataFrame, keys: list[str], channel: str = "channel", start: str = "start", end: str = "end") -> DataFrame:
    """(keys, vad): ``vad[channel]`` the [start, end] of its utterances in order of time, two channels."""
    seg = F.struct(F.col(start).alias("s"), F.col(end).alias("e"))
    lists = [F.transform(F.array_sort(F.collect_list(F.when(F.col(channel) == c, seg))), lambda x: F.array(x["s"], x["e"])) for c in (0, 1)]
    return utts.groupBy(*keys).agg(F.array(*lists).alias("vad"))


def to_frames(seg: DataFrame, start: str, end: str, hop: float, total: Column) -> DataFrame:
    """``seg`` with its times as half-open frames [sf, ef), truncated and clipped to [0, total)."""
    q = lambda c: F.least(F.greatest((F.col(c) / hop).cast("int"), F.lit(0)), total.cast("int"))
    return seg.withColumns({"sf": q(start), "ef": q(end), "total": total.cast("int")})


def blocks(frames: DataFrame, keys: list[str], sessions: DataFrame | None = None, channel: str = "channel", total: str = "total", size: int = BLOCK) -> DataFrame:
    """(keys, block, n, v0, v1, s0, s1): activity of the two channels in blocks of ``size`` frames, byte arrays of the
    ``n`` frames of the block, and how many frames of each are active.

    ``frames``: keys, channel, sf, ef; empty intervals and other channels add nothing, repeated ones change nothing.
    With ``sessions`` (keys, total) all blocks of a session come, silent ones too, the last with fewer frames; without,
    only blocks with activity, all of ``size`` frames. What reaches an array is bounded by the frames of a block.
    """
    import pyarrow as pa

    ship(frames.sparkSession)
    at = F.col("block") * size
    pieces = frames.where("sf < ef").where(F.col(channel).isin(0, 1)).select(*keys, F.col(channel).cast("int").alias("c"), "sf", "ef", F.explode(F.sequence(F.floor(F.col("sf") / size), F.floor((F.col("ef") - 1) / size))).alias("block"))
    ends = F.array(F.struct(F.greatest(F.col("sf") - at, F.lit(0)).cast("int").alias("p"), F.lit(1).alias("d")), F.struct(F.least(F.col("ef") - at, F.lit(size)).cast("int").alias("p"), F.lit(-1).alias("d")))
    events = pieces.select(*keys, "block", "c", F.inline(ends)).groupBy(*keys, "block", "c", "p").agg(F.sum("d").cast("int").alias("d")).where("d <> 0")
    rows = events.select(*keys, "block", F.lit(None if sessions is not None else size).cast("int").alias("n"), F.struct("c", "p", "d").alias("e"))
    if sessions is not None:
        grid = sessions.where(F.col(total) > 0).select(*keys, F.col(total).alias("_t"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(total) - 1) / size))).alias("block"))
        rows = rows.unionByName(grid.select(*keys, "block", F.least(F.col("_t") - at, F.lit(size)).cast("int").alias("n"), F.lit(None).cast(rows.schema["e"].dataType).alias("e")))
    g = spread(rows, *keys, "block").groupBy(*keys, "block").agg(F.max("n").alias("n"), F.collect_list("e").alias("e")).where("n is not null")
    names = [*keys, "block", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, AT_A_TIME) for i in range(0, whole.num_rows, AT_A_TIME)):
                n = b.column("n").to_numpy().astype(np.int64)
                e = b.column("e")
                row = np.repeat(np.arange(len(n)), np.diff(e.offsets.to_numpy()))
                c, p, d = (np.asarray(x.to_numpy(zero_copy_only=False)) for x in e.flatten().flatten())
                first = np.concatenate(([0], np.cumsum(n + 1)))  # one more for what ends with the block
                inside = np.ones(first[-1], bool)
                inside[first[1:] - 1] = False
                bounds = np.concatenate(([0], np.cumsum(n)))
                lists, sums = [], []
                for k in (0, 1):
                    steps = np.zeros(first[-1], np.int32)
                    m = c == k
                    np.add.at(steps, first[row[m]] + np.minimum(p[m], n[row[m]]), d[m])
                    v = (np.cumsum(steps) > 0)[inside].astype(np.int8)
                    lists.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(v)))
                    sums.append(pa.array(np.diff(np.concatenate(([0], np.cumsum(v, dtype=np.int64)))[bounds])))
                yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), *lists, *sums], names=[*names, "v0", "v1", "s0", "s1"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in g.select(*names).schema)
    return g.mapInArrow(run, fields + ", v0 array<tinyint>, v1 array<tinyint>, s0 bigint, s1 bigint")


def unpack(blocked: DataFrame, keys: list[str], columns: list[str], size: int = BLOCK) -> DataFrame:
    """(keys, frame, columns): one row for each frame."""
    return _spread(blocked, [*keys, "block"], columns, "_p").select(*keys, (F.col("block") * size + F.col("_p")).cast("int").alias("frame"), *columns)


def _spread(arrays: DataFrame, keep: list[str], columns: list[str], pos: str) -> DataFrame:
    """(keep, pos, columns): parallel arrays as rows. Only the first is exploded, the others are read at its position,
    which builds no row of all of them for each element."""
    e = arrays.select(*keep, F.posexplode(columns[0]).alias(pos, "_x"), *columns[1:])
    return e.select(*keep, pos, F.col("_x").alias(columns[0]), *(F.get(c, F.col(pos)).alias(c) for c in columns[1:]))


def one_hot(frames: DataFrame, sessions: DataFrame, keys: list[str], channel: str = "channel", total: str = "total") -> DataFrame:
    """(keys, frame, v0, v1) for every frame of every session, silent ones included."""
    return unpack(blocks(frames, keys, sessions, channel, total), keys, ["v0", "v1"]).withColumns({c: F.col(c).cast("int") for c in ("v0", "v1")})


def slices(clips: DataFrame, blocked: DataFrame, keys: list[str], fill: dict[str, Column], size: int = BLOCK) -> DataFrame:
    """(keys, clip, arrays): frames [start_frame, end_frame) of each clip from the array columns named in ``fill``,
    whose value stands where nothing is known, before the beginning too. Clips without length have no row.

    A clip meets the blocks it touches by equality and is put together again: one row a clip, never one a frame. The
    join is a sort-merge join whatever the planner takes the blocks' size for: it estimates them by the size of the
    file behind the intervals, a small part of what the arrays hold, and would broadcast them through the driver.
    """
    at = F.col("block") * size
    p = clips.where("start_frame < end_frame").select(*keys, "clip", "start_frame", "end_frame", F.explode(F.sequence(F.floor(F.col("start_frame") / size), F.floor((F.col("end_frame") - 1) / size))).alias("block"))
    p = p.withColumn("_a", F.greatest(F.col("start_frame") - at, F.lit(0)).cast("int")).withColumn("_m", (F.least(F.col("end_frame") - at, F.lit(size)) - F.col("_a")).cast("int"))
    j = p.join(blocked.select(*keys, "block", *fill).hint("merge"), [*keys, "block"], "left")

    def part(c: str, f: Column) -> Column:
        x = F.slice(c, F.col("_a") + 1, F.col("_m"))
        kind = blocked.schema[c].dataType
        return F.coalesce(F.concat(x, F.array_repeat(f.cast(kind.elementType), F.col("_m") - F.size(x))), F.array_repeat(f.cast(kind.elementType), F.col("_m"))).alias(c)

    g = spread(j, *keys, "clip").groupBy(*keys, "clip").agg(F.array_sort(F.collect_list(F.struct("block", *(part(c, f) for c, f in fill.items())))).alias("_x"))
    return g.select(*keys, "clip", *(F.flatten(f"_x.{c}").alias(c) for c in fill))


def clip_arrays(clips: DataFrame, blocked: DataFrame, keys: list[str], horizon: int = 0) -> DataFrame:
    """(keys, clip, v0, v1): activity of frames [start_frame, end_frame + horizon) of each clip, 0 where nothing is known."""
    return slices(clips.withColumn("end_frame", F.col("end_frame") + horizon), blocked, keys, {c: F.lit(0) for c in ("v0", "v1")})


def clip_windows(clips: DataFrame, blocked: DataFrame, keys: list[str], horizon: int = 0) -> DataFrame:
    """(keys, clip, offset, v0, v1): :func:`clip_arrays`, one row a frame."""
    e = _spread(clip_arrays(clips, blocked, keys, horizon), [*keys, "clip"], ["v0", "v1"], "offset")
    return e.withColumns({c: F.col(c).cast("int") for c in ("v0", "v1")})


def gathered(clips: DataFrame, blocked: DataFrame, keys: list[str], back: int, ahead: int, before: DataFrame | None = None, size: int = BLOCK) -> DataFrame:
    """(keys, block, c, p, b0, b1): ``c`` the clips (all columns but the keys) that start in the block, ``p`` the arrays
    of the blocks from ``back`` before to ``ahead`` after it, each at its ``slot``, and the sums of all earlier blocks
    from ``before`` (keys, block, b0, b1). Blocks in which no clip starts have no row.

    Clips come to the blocks by a union and not by a join, so neither an array is repeated for each of them nor
    broadcast.
    """
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    sums = [F.lit(None).cast("long").alias(f"b{c}") for c in (0, 1)]
    started = clips.select(*keys, F.floor(F.col("start_frame") / size).alias("block"), F.struct(*(c for c in clips.columns if c not in keys)).alias("c"))
    moved = blocked.select(*keys, "block", F.explode(F.sequence(F.lit(-ahead), F.lit(back))).alias("_j"), "v0", "v1")
    parts = moved.select(*keys, (F.col("block") + F.col("_j")).alias("block"), F.struct((F.lit(back) - F.col("_j")).alias("slot"), "v0", "v1").alias("p"))
    rows = started.select(*keys, "block", "c", none(parts, "p"), *sums).unionByName(parts.select(*keys, "block", none(started, "c"), "p", *sums))
    if before is not None:
        rows = rows.unionByName(before.select(*keys, "block", none(started, "c"), none(parts, "p"), "b0", "b1"))
    g = spread(rows, *keys, "block").groupBy(*keys, "block").agg(F.collect_list("c").alias("c"), F.collect_list("p").alias("p"), F.max("b0").alias("b0"), F.max("b1").alias("b1"))
    return g.where(F.size("c") > 0)


def _timelines(x, slots: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a batch of :func:`gathered`: frames by row, channel and place, 0 where nothing is known, and where each row's
    known frames end."""
    p = x.column("p")
    row = np.repeat(np.arange(x.num_rows), np.diff(p.offsets.to_numpy()))
    slot, *lists = p.flatten().flatten()
    at = slot.to_numpy().astype(np.int64) * size
    v, end = np.zeros((x.num_rows, 2, slots * size), np.int8), np.zeros(x.num_rows, np.int64)
    for c, ls in enumerate(lists):
        bounds, values = ls.offsets.to_numpy(), ls.values.to_numpy()
        for r, a, i, j in zip(row, at, bounds, bounds[1:]):
            v[r, c, a : a + j - i] = values[i:j]
        np.maximum.at(end, row, at + np.diff(bounds))
    return v, end


def _counts(v: np.ndarray) -> np.ndarray:
    """How many frames before each place are active."""
    sums = np.zeros((*v.shape[:2], v.shape[2] + 1), np.int32)
    np.cumsum(v, axis=2, dtype=np.int32, out=sums[:, :, 1:])
    return sums


def flip(frames: DataFrame) -> DataFrame:
    """The two speakers swapped."""
    return frames.withColumns({"v0": F.col("v1"), "v1": F.col("v0")})


def history_edges(times: list[float], hop: float) -> list[int]:
    """Bin edges in frames, the longest first."""
    return sorted((int(t / hop) for t in times), reverse=True)


def history_blocks(blocked: DataFrame, keys: list[str], edges: list[int], size: int = BLOCK) -> DataFrame:
    """``blocked`` (all blocks of each session) with ``h0`` … ``hk``, arrays beside ``v0`` and ``v1``: the share of
    speaker 0 in the activity of each stretch of the past.

    The stretches are: longer ago than edges[0], then between neighbouring edges, last the most recent edges[-1]
    frames with the frame itself. 0.5 where nobody was active. Running sums come from the block itself, the blocks
    that the longest edge reaches back to, and the sums of all earlier blocks, which are carried from block to block.
    """
    import pyarrow as pa

    b = cut(blocked)
    reach = ceil(max(edges, default=0) / size)
    carried = carry_over_buckets(b.select(*keys, "block", "s0", "s1"), keys, "block", {f"_b{c}": (F.col(f"s{c}"), "before") for c in (0, 1)})
    kept = b.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(reach))).alias("_j"), "block", "n", "v0", "v1").withColumn("block", F.col("block") + F.col("_j"))
    parts = kept.select(*keys, "block", F.when(F.col("_j") == 0, F.col("n")).alias("n"), F.struct("_j", "v0", "v1").alias("_p"), *(F.lit(None).cast("long").alias(f"_b{c}") for c in (0, 1)))
    rows = parts.unionByName(carried.select(*keys, "block", F.lit(None).cast("int").alias("n"), F.lit(None).cast(parts.schema["_p"].dataType).alias("_p"), "_b0", "_b1"))
    g = spread(rows, *keys, "block").groupBy(*keys, "block").agg(F.max("n").alias("n"), F.max("_b0").alias("_b0"), F.max("_b1").alias("_b1"), F.sort_array(F.collect_list("_p"), asc=False).alias("_p")).where("n is not null")
    names = [*keys, "block", "n"]
    bounds = list(zip([None, *edges], [*edges, 0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for x in (whole.slice(i, AT_A_TIME) for i in range(0, whole.num_rows, AT_A_TIME)):
                hs, vs = [[] for _ in bounds], [[], []]
                for i in range(x.num_rows):
                    n = x.column("n")[i].as_py()
                    own, sums = [], []
                    for c in (0, 1):
                        v = np.concatenate([q.to_numpy() for q in _lists(x.column("_p")[i].values.field(f"v{c}"))])
                        own.append(v[len(v) - n :])
                        s = np.concatenate((np.zeros(1, np.int64), np.cumsum(v, dtype=np.int64)))
                        sums.append(s + (x.column(f"_b{c}")[i].as_py() - s[len(v) - n]))
                    ago = lambda c, k: _ago(sums[c], n, k)  # noqa: B023, E731
                    for h, (far, near) in zip(hs, bounds):
                        a0, a1 = (ago(c, near) - (ago(c, far) if far is not None else 0) for c in (0, 1))
                        both = a0 + a1
                        h.append(np.divide(a0, both, out=np.full(n, 0.5), where=both > 0))
                    for c in (0, 1):
                        vs[c].append(own[c])
                ends = pa.array(np.concatenate(([0], np.cumsum(x.column("n").to_numpy()))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(y))) for y in (*vs, *hs)]
                yield pa.RecordBatch.from_arrays([*(x.column(c) for c in names), *lists], names=[*names, "v0", "v1", *(f"h{i}" for i in range(len(bounds)))])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in g.select(*names).schema)
    return g.mapInArrow(run, fields + ", v0 array<tinyint>, v1 array<tinyint>" + "".join(f", h{i} array<double>" for i in range(len(bounds))))


def _lists(x) -> Iterator:
    return (x[i].values for i in range(len(x)))


def _ago(sums: np.ndarray, n: int, k: int) -> np.ndarray:
    """Sums up to each of the last ``n`` frames, ``k`` frames earlier; 0 before the beginning of the session."""
    at = np.arange(len(sums) - n, len(sums)) - k
    return np.where(at >= 0, sums[np.maximum(at, 0)], 0)


def clip_histories(clips: DataFrame, blocked: DataFrame, keys: list[str], edges: list[int], n: int, horizon: int = 0, size: int = BLOCK) -> DataFrame:
    """``clips`` (keys, start_frame and any other columns) of ``n`` frames with ``vad``, [v0, v1] a frame up to
    ``horizon`` past the end, 0 where nothing is known, and ``history``, the shares of :func:`history_blocks` a frame,
    0.5 beyond the session.

    Only activity is moved, one byte a frame: a clip's shares are made where it starts and go straight to the result.
    """
    import pyarrow as pa

    b = cut(blocked)
    back, ahead = ceil(max(edges, default=0) / size), ceil((n + horizon) / size)
    before = carry_over_buckets(b.select(*keys, "block", "s0", "s1"), keys, "block", {f"b{c}": (F.col(f"s{c}"), "before") for c in (0, 1)})
    g = gathered(clips, b, keys, back, ahead, before, size)
    bounds = list(zip([None, *edges], [*edges, 0]))
    names = [c for c in clips.columns if c not in keys]

    def nested(x: np.ndarray) -> pa.ListArray:
        """Clips by frames by values as a list of lists a clip."""
        inner = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[2], dtype=np.int32)), pa.array(x.ravel()))
        return pa.ListArray.from_arrays(pa.array(np.arange(x.shape[0] + 1, dtype=np.int32) * x.shape[1]), inner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for x in (whole.slice(i, CLIPS_AT_A_TIME) for i in range(0, whole.num_rows, CLIPS_AT_A_TIME)):
                v, end = _timelines(x, back + 1 + ahead, size)
                sums = _counts(v)
                early = np.stack([np.nan_to_num(x.column(f"b{c}").to_numpy(zero_copy_only=False)).astype(np.int64) - sums[:, c, back * size] for c in (0, 1)], axis=1)
                lists = x.column("c")
                rows = np.repeat(np.arange(x.num_rows), np.diff(lists.offsets.to_numpy()))
                fields = dict(zip(names, lists.flatten().flatten()))
                starts = fields["start_frame"].to_numpy().astype(np.int64) - (x.column("block").to_numpy()[rows] - back) * size
                for i in range(0, len(rows), CLIPS_AT_A_TIME):
                    row, a = rows[i : i + CLIPS_AT_A_TIME, None], starts[i : i + CLIPS_AT_A_TIME, None]
                    at, known = a + np.arange(n), a + np.arange(n) < end[row]
                    history = np.full((len(row), n, len(bounds)), 0.5)
                    for h, (far, near) in enumerate(bounds):
                        a0, a1 = (sums[row, c, at + 1 - near] - sums[row, c, at + 1 - far] if far is not None else early[row, c] + sums[row, c, at + 1 - near] for c in (0, 1))
                        both = a0 + a1
                        np.divide(a0, both, out=history[:, :, h], where=known & (both > 0))
                    wide = a + np.arange(n + horizon)
                    vad = np.stack([v[row, c, wide] for c in (0, 1)], axis=2).astype(np.int32)
                    own = [f.slice(i, CLIPS_AT_A_TIME) for f in fields.values()]
                    yield pa.RecordBatch.from_arrays([*(x.column(k).take(pa.array(row[:, 0])) for k in keys), *own, nested(vad), nested(history)], names=[*keys, *names, "vad", "history"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in clips.select(*keys, *names).schema)
    return g.mapInArrow(run, fields + ", vad array<array<int>>, history array<array<double>>")


def activity_history(frames: DataFrame, sessions: DataFrame, keys: list[str], edges: list[int], channel: str = "channel", total: str = "total") -> DataFrame:
    """(keys, frame, v0, v1, h0 …): activity and :func:`history_blocks`, one row for every frame of every session."""
    h = history_blocks(blocks(frames, keys, sessions, channel, total), keys, edges)
    return unpack(h, keys, ["v0", "v1", *(f"h{i}" for i in range(len(edges) + 1))]).withColumns({c: F.col(c).cast("int") for c in ("v0", "v1")})


def response_arrays(responses: DataFrame, blocked: DataFrame, keys: list[str], frames: int, ahead: int = 0) -> DataFrame:
    """(keys, response, own, other): activity of the ``frames`` before each response and ``ahead`` after its start.

    ``responses``: keys, response, speaker (0 or 1), frame. ``own`` is the activity of the responding speaker.
    """
    at = responses.select(*keys, F.struct("response", "speaker").alias("clip"), (F.col("frame") - frames).alias("start_frame"), F.col("frame").alias("end_frame"))
    w = clip_arrays(at, blocked, keys, ahead)
    first = F.col("clip.speaker") == 0
    return w.select(*keys, F.col("clip.response").alias("response"), F.when(first, F.col("v0")).otherwise(F.col("v1")).alias("own"), F.when(first, F.col("v1")).otherwise(F.col("v0")).alias("other"))


def response_counts(responses: DataFrame, blocked: DataFrame, keys: list[str], frames: int, ahead: int = 0, size: int = BLOCK) -> DataFrame:
    """(keys, response, own, other, frames): of :func:`response_arrays` the sums and the length, without the arrays.

    Responses are counted by differences of running sums in the block where their window starts and those it reaches.
    """
    import pyarrow as pa

    more = ceil((frames + ahead) / size)
    at = responses.select(*keys, "response", F.col("speaker").cast("int").alias("speaker"), (F.col("frame") - frames).cast("int").alias("start_frame")).where(F.lit(frames + ahead > 0))
    g = gathered(at, blocked, keys, 0, more, size=size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for x in (whole.slice(i, AT_A_TIME) for i in range(0, whole.num_rows, AT_A_TIME)):
                sums = _counts(_timelines(x, 1 + more, size)[0])
                clips = x.column("c")
                row = np.repeat(np.arange(x.num_rows), np.diff(clips.offsets.to_numpy()))
                response, speaker, start = clips.flatten().flatten()
                a = start.to_numpy().astype(np.int64) - x.column("block").to_numpy()[row] * size
                n = [(sums[row, c, a + frames + ahead] - sums[row, c, a]).astype(np.int64) for c in (0, 1)]
                first = speaker.to_numpy() == 0
                made = [response, *(pa.array(np.where(first, n[c], n[1 - c])) for c in (0, 1)), pa.array(np.full(len(row), frames + ahead, np.int64))]
                yield pa.RecordBatch.from_arrays([*(x.column(k).take(pa.array(row)) for k in keys), *made], names=[*keys, "response", "own", "other", "frames"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in responses.select(*keys, "response").schema)
    return g.mapInArrow(run, fields + ", own bigint, other bigint, frames bigint")


def response_window(responses: DataFrame, blocked: DataFrame, keys: list[str], frames: int, ahead: int = 0) -> DataFrame:
    """(keys, response, offset, own, other): :func:`response_arrays`, one row a frame."""
    e = _spread(response_arrays(responses, blocked, keys, frames, ahead), [*keys, "response"], ["own", "other"], "offset")
    return e.withColumns({c: F.col(c).cast("int") for c in ("own", "other")})


def history_at(responses: DataFrame, history: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """(keys, response, h): the condensed history at one moment, of ``bins`` shares of the responding speaker: the
    frame before the response starts; 0.5 where the session hasn't begun or isn't known."""
    at = responses.select(*keys, F.struct("response", "speaker").alias("clip"), (F.col("frame") - 1).alias("start_frame"), F.col("frame").alias("end_frame"))
    w = slices(at, history, keys, {f"h{i}": F.lit(0.5) for i in range(bins)})
    h = F.array(*(F.get(f"h{i}", F.lit(0)) for i in range(bins)))
    return w.select(*keys, F.col("clip.response").alias("response"), F.when(F.col("clip.speaker") == 0, h).otherwise(F.transform(h, lambda x: 1 - x)).alias("h"))
