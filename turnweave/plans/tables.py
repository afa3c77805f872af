"""The test tables seen as the operators' inputs, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.functions import text as X
from turnweave.functions import timing as M
from turnweave.operators.intervals import vad_segments
from turnweave.runtime import table

#: 2024-01-01, so that event times are small numbers of seconds.
BASE = 1_704_067_200
#: Seconds of a frame of the event signal.
HOP = 600


def utterances(s: SparkSession, d: str) -> DataFrame:
    """Last delivery of each line: session, reel, line_no, line_id, channel, start, end, text, words."""
    v = F.struct("line_id", "speaker", "start", "end", "text", "words")
    t = table(s, d, "transcripts").groupBy("session", "reel", "line_no").agg(F.max_by(v, F.struct("loaded_at", "line_id")).alias("v")).select("session", "reel", "line_no", "v.*")
    return t.withColumn("channel", X.channel_of(F.col("speaker"))).drop("speaker")


UTTERANCES = r"""
utt AS (SELECT session, reel, line_no, line_id, start, "end", text, words,
        CASE WHEN regexp_replace(upper(regexp_replace(speaker, '^\s+|\s+$', '', 'g')), '[:.]$', '') IN ('A', 'AGENT', '0') THEN 0 WHEN speaker IS NOT NULL THEN 1 END AS channel
        FROM transcripts QUALIFY row_number() OVER (PARTITION BY session, reel, line_no ORDER BY loaded_at DESC, line_id DESC) = 1)"""


def dialogs(s: SparkSession, d: str) -> DataFrame:
    """dialog_id, dialog without repeated deliveries."""
    return table(s, d, "text_dialogs").select("dialog_id", "dialog").distinct()


DIALOGS = "dlg AS (SELECT DISTINCT dialog_id, dialog FROM text_dialogs)"
TURNS = DIALOGS + ", trn AS (SELECT dialog_id, unnest(dialog) AS text, unnest(range(len(dialog))) AS turn FROM dlg)"


def intervals(s: SparkSession, d: str) -> DataFrame:
    """Events as intervals: session, channel, event_id, start, end in seconds."""
    start = M.epoch_seconds(F.col("ts")) - BASE
    return table(s, d, "events").select(F.col("user_id").alias("session"), (F.col("event_id") % 2).cast("int").alias("channel"), "event_id", "event_type", start.alias("start"), (start + 60 * F.col("value")).alias("end"))


INTERVALS = f"""
itv AS (SELECT user_id AS session, CAST(event_id % 2 AS INT) AS channel, event_id, event_type, epoch_us(ts) / 1e6 - {BASE} AS start, epoch_us(ts) / 1e6 - {BASE} + 60 * value AS "end" FROM events)"""


def interval_frames(s: SparkSession, d: str) -> DataFrame:
    """session, channel, sf, ef, total: the intervals in frames; total reaches past the last one."""
    i = intervals(s, d)
    total = i.groupBy("session").agg((F.max("end") / HOP).cast("int").alias("total"))
    j = i.join(total, "session")
    q = lambda c: F.least((F.col(c) / HOP).cast("int"), F.col("total"))
    return j.select("session", "channel", q("start").alias("sf"), q("end").alias("ef"), "total")


FRAMES = (
    INTERVALS
    + f""",
tot AS (SELECT session, CAST(trunc(max("end") / {HOP}) AS INT) AS total FROM itv GROUP BY session),
frm AS (SELECT session, channel, least(CAST(trunc(start / {HOP}) AS INT), total) AS sf, least(CAST(trunc("end" / {HOP}) AS INT), total) AS ef, total FROM itv JOIN tot USING (session)),
act AS (SELECT DISTINCT session, channel, unnest(range(sf, ef)) AS frame FROM frm),
grid AS (SELECT session, unnest(range(total)) AS frame FROM tot),
hot AS (SELECT g.session, g.frame, CAST(max(CASE WHEN a.channel = 0 THEN 1 ELSE 0 END) AS INT) AS v0, CAST(max(CASE WHEN a.channel = 1 THEN 1 ELSE 0 END) AS INT) AS v1
        FROM grid g LEFT JOIN act a ON a.session = g.session AND a.frame = g.frame GROUP BY ALL)"""
)


def reels(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(session, duration) and (session, channel, start, end) of each reel of ``vad_lists``; session is session/reel."""
    seg = vad_segments(table(s, d, "vad_lists"))
    seg = seg.select(F.concat_ws("/", "session", F.col("reel").cast("string")).alias("session"), "channel", (F.col("start_us") / 1e6).alias("start"), (F.col("end_us") / 1e6).alias("end"))
    return seg.groupBy("session").agg(F.max("end").alias("duration")), seg


REELS = """
seg0 AS (SELECT session, reel, coalesce(lower(trim(time_unit)) = 'ms', false) AS ms, unnest(range(len(vad))) AS channel, unnest(vad) AS segs FROM vad_lists),
seg1 AS (SELECT session || '/' || reel AS session, channel, ms, unnest(segs) AS seg FROM seg0),
seg2 AS (SELECT session, channel, CAST(round(seg[1] * CASE WHEN ms THEN 1000 ELSE 1000000 END) AS BIGINT) AS x, CAST(round(seg[2] * CASE WHEN ms THEN 1000 ELSE 1000000 END) AS BIGINT) AS y
         FROM seg1 WHERE len(seg) = 2 AND seg[1] IS NOT NULL AND seg[2] IS NOT NULL AND isfinite(seg[1]) AND isfinite(seg[2])),
seg AS (SELECT session, CAST(channel AS INT) AS channel, greatest(least(x, y), 0) / 1e6 AS start, greatest(x, y) / 1e6 AS "end" FROM seg2 WHERE greatest(x, y) > greatest(least(x, y), 0)),
reel AS (SELECT session, max("end") AS duration FROM seg GROUP BY session)"""


def waves(s: SparkSession, d: str) -> DataFrame:
    """vec_id, x: each embedding as a waveform of doubles."""
    return table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))


WAVES = "wav AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"


def clip_waves(s: SparkSession, d: str) -> DataFrame:
    """clip_id, a, b: the two channels of each clip, deliveries once, missing ones empty."""
    c = table(s, d, "clips").select("clip_id", F.col("waveform").cast("array<array<double>>").alias("w")).where("w is not null").groupBy("clip_id").agg(F.max("w").alias("w"))
    none = F.array().cast("array<double>")
    return c.select("clip_id", F.coalesce(F.get("w", F.lit(0)), none).alias("a"), F.coalesce(F.get("w", F.lit(1)), none).alias("b"))


CLIP_WAVES = """
cw AS (SELECT clip_id, CAST(max(waveform) AS DOUBLE[][]) AS w FROM clips WHERE waveform IS NOT NULL GROUP BY clip_id),
cwv AS (SELECT clip_id, coalesce(w[1], []) AS a, coalesce(w[2], []) AS b FROM cw)"""


def clip_channels(s: SparkSession, d: str) -> DataFrame:
    """clip_id, channel, x: every channel that a clip has, deliveries once, empty ones too."""
    c = table(s, d, "clips").select("clip_id", F.col("waveform").cast("array<array<double>>").alias("w")).where("w is not null").groupBy("clip_id").agg(F.max("w").alias("w"))
    return c.select("clip_id", F.posexplode("w").alias("channel", "x")).where("x is not null")


CLIP_CHANNELS = """
cch0 AS (SELECT clip_id, CAST(max(waveform) AS DOUBLE[][]) AS w FROM clips WHERE waveform IS NOT NULL GROUP BY clip_id),
cch AS (SELECT clip_id, CAST(channel AS INT) AS channel, x FROM (SELECT clip_id, unnest(range(len(w))) AS channel, unnest(w) AS x FROM cch0) WHERE x IS NOT NULL)"""
