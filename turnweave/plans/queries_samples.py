"""Queries over samples of dialogue audio with waveforms, condensed histories and batches with content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.functions import signal as S
from turnweave.functions import text as X
from turnweave.operators import joins
from turnweave.operators import vad as V
from turnweave.operators.intervals import valid_pairs
from turnweave.plans import batch, tables
from turnweave.plans.dialog_audio import DialogAudio
from turnweave.plans.queries_vad import EDGES, HOP, _histories, totals
from turnweave.plans.tables import FRAMES
from turnweave.runtime import table

FLOW = DialogAudio()
RATE = 100
R6 = lambda c: F.round(c, 6)


def parts(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sessions, segments, signals) of the clips: a clip is a session; its length is its longest channel's."""
    c = table(s, d, "clips").where("waveform is not null")
    one = c.groupBy("clip_id").agg(F.max("waveform").alias("waveform"), F.coalesce(F.max("sample_rate"), F.lit(RATE)).alias("sample_rate"))
    signals = one.select(F.col("clip_id").alias("session"), "sample_rate", "waveform")
    longest = F.coalesce(F.array_max(F.transform("waveform", F.size)), F.lit(0))
    sessions = signals.select("session", (longest / F.col("sample_rate")).alias("duration"))
    seg = c.select(F.col("clip_id").alias("session"), F.posexplode("vad").alias("channel", "segs")).where("channel < 2").select("session", "channel", F.explode("segs").alias("seg"))
    return sessions, valid_pairs(seg, "seg").select("session", "channel", "start", "end").distinct(), signals


_ON = lambda c: F.aggregate("vad", F.lit(0), lambda a, v: a + v[c])


def _last_history(n: int) -> list:
    last = F.element_at("history", -1)
    return [R6(last[i]).alias(f"h{i}") for i in range(n)]


def waveform_samples(s: SparkSession, d: str) -> DataFrame:
    ses, seg, sig = parts(s, d)
    peak = lambda w: S.peak(F.get(w, F.lit(0)).cast("array<double>"))
    x = FLOW.samples(ses, seg, sig, features=peak, transforms=lambda df: df.withColumn("seconds", F.col("end") - F.col("start")))
    n = lambda i: F.coalesce(F.size(F.get("waveform", F.lit(i))), F.lit(0)).alias(f"n{i}")
    total = lambda i: R6(S.total(F.coalesce(F.get("waveform", F.lit(i)).cast("array<double>"), F.array().cast("array<double>")))).alias(f"total{i}")
    return x.select("session", "clip", "sample_rate", "seconds", n(0), n(1), total(0), total(1), R6("features").alias("peak"), F.size("vad").alias("frames"), _ON(0).alias("on0"), _ON(1).alias("on1"), *_last_history(5))


def full_samples(flip: bool):
    def run(s: SparkSession, d: str) -> DataFrame:
        ses, seg, sig = parts(s, d)
        x = FLOW.dialogs(ses, seg, sig, flip=flip)
        first = R6(F.coalesce(F.get(F.get("waveform", F.lit(0)), F.lit(0)), F.lit(0.0)).cast("double")).alias("first")
        return x.select("session", F.size("vad").alias("frames"), _ON(0).alias("on0"), _ON(1).alias("on1"), F.size("history").alias("past"), *_last_history(5), first)

    return run


def train_samples(s: SparkSession, d: str) -> DataFrame:
    """What a swap of speakers leaves as it is: activity of both, its difference, and how one-sided the past was."""
    ses, seg, sig = parts(s, d)
    x = FLOW.samples(ses, seg, sig, train=True)
    last = F.element_at("history", -1)
    return x.select("session", "clip", (_ON(0) + _ON(1)).alias("both"), F.abs(_ON(0) - _ON(1)).alias("apart"), *(R6(F.abs(last[i] - 0.5)).alias(f"h{i}") for i in range(5)), F.size("waveform").alias("channels"))


def responses(s: SparkSession, d: str) -> DataFrame:
    i = tables.intervals(s, d)
    return i.select("session", F.col("event_id").alias("response"), F.col("channel").alias("speaker"), (F.col("start") / HOP).cast("int").alias("frame"))


def history_blocks(s: SparkSession, d: str) -> DataFrame:
    return V.history_blocks(V.blocks(tables.interval_frames(s, d), ["session"], totals(s, d)), ["session"], EDGES)


def condensed(s: SparkSession, d: str) -> DataFrame:
    h = V.history_at(responses(s, d), history_blocks(s, d), ["session"], len(EDGES) + 1)
    return h.select("session", "response", *(R6(F.col("h")[i]).alias(f"h{i}") for i in range(len(EDGES) + 1)))


def audio_batches(s: SparkSession, d: str) -> DataFrame:
    ses, seg, sig = parts(s, d)
    b = batch.dialog_batches(FLOW.samples(ses, seg, sig), ["session", "clip"], 4)
    longest = F.array_max(F.transform("waveform", lambda w: F.array_max(F.transform(w, F.size))))
    on = F.aggregate(F.flatten("vad"), F.lit(0), lambda a, v: a + v[0] + v[1])
    return b.select("batch_id", F.array_join(F.transform("session", lambda x: x.cast("string")), ",").alias("sessions"), F.size("vad").alias("items"), longest.alias("longest"), on.alias("active"))


def speech_batches(s: SparkSession, d: str) -> DataFrame:
    """Channels of clips of at least a second with their level as a sidecar feature, eight to a batch."""
    w = tables.clip_channels(s, d).select(F.concat_ws("/", F.lit("clips"), F.col("clip_id").cast("string"), F.concat(F.col("channel").cast("string"), F.lit(".wav"))).alias("file"), F.col("clip_id"), "channel", F.col("x").alias("waveform"))
    side = w.where(F.size("waveform") >= 16).select(X.swap_suffix(F.col("file"), ".wav", "_rms.npy").alias("file"), S.rms(F.col("waveform"), 16, 8, center=False).alias("value"))
    items = batch.with_sidecars(w, {"rms": side}, ".wav", "npy")
    b = batch.speech_batches(items.withColumn("id", F.col("file")), ["clip_id", "channel"], 8, ("waveform", "rms"), least={"waveform": RATE})
    most = lambda c: F.array_max(F.transform(c, F.size)).alias(c)
    return b.select("batch_id", F.array_join("id", ",").alias("ids"), most("waveform"), most("rms"), F.array_join(F.transform("rms_length", lambda x: x.cast("string")), ",").alias("rms_length"))


def _items(s: SparkSession, d: str) -> DataFrame:
    """Events as responses to classify: label, tokens, activity around the response, history, mean length, audio."""
    kind = F.when(F.col("event_type") == "click", "shift").when(F.col("event_type") == "view", "hold").otherwise("backchannel")
    i = tables.intervals(s, d).select("session", F.col("event_id").alias("response"), F.col("channel").alias("speaker"), kind.alias("label"), F.sequence(F.lit(1), (F.col("event_id") % 7 + 1).cast("int")).alias("input_ids"), F.transform(F.sequence(F.lit(1), (F.col("event_id") % 5 + 1).cast("int")), lambda x: x.cast("double")).alias("waveform"))
    lengths = tables.intervals(s, d)
    mean = lengths.groupBy("session").agg(F.array(*(F.avg(F.when(F.col("channel") == c, F.col("end") - F.col("start"))) for c in (0, 1))).alias("means"))
    return batch.classification_items(i, V.response_arrays(responses(s, d), V.blocks(tables.interval_frames(s, d), ["session"]), ["session"], 24, 2), V.history_at(responses(s, d), history_blocks(s, d), ["session"], len(EDGES) + 1), joins.long_means(mean))


def classification(s: SparkSession, d: str) -> DataFrame:
    b = batch.classification_batches(_items(s, d), ["response"], 16, 4, 5)
    flat = lambda c: F.flatten(c)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    return b.select("batch_id", F.array_join(F.transform("label", lambda x: x.cast("string")), ",").alias("labels"), F.aggregate(flat("input_ids"), F.lit(0), lambda a, v: a + v).alias("tokens"), F.size(F.element_at("input_ids", 1)).alias("longest"), F.aggregate(flat("own"), F.lit(0), lambda a, v: a + v).alias("own"), F.round(total(flat("history")), 4).alias("history"), F.round(total(F.filter("f0_mean", lambda x: x.isNotNull())), 3).alias("f0_mean"), F.get(F.element_at("waveform", 1), F.lit(0)).alias("first"))


def prosody(s: SparkSession, d: str) -> DataFrame:
    i = _items(s, d).withColumn("prosody", F.array(F.array(F.col("f0_mean"))))
    b = batch.prosody_batches(i.withColumn("waveform", F.array("waveform", F.transform("waveform", lambda x: -x))), ["response"], 16, 5)
    return b.select("batch_id", F.array_join(F.transform("label", lambda x: x.cast("string")), ",").alias("labels"), F.aggregate(F.transform("waveform", lambda w: w[0]), F.lit(0.0), lambda a, v: a + v).alias("firsts"), F.aggregate(F.transform("waveform", lambda w: w[4]), F.lit(0.0), lambda a, v: a + v).alias("lasts"), F.size("prosody").alias("items"))


QUERIES = {
    "dialog_audio_waveform": waveform_samples,
    "dialog_full_sample": full_samples(False),
    "dialog_full_flip": full_samples(True),
    "dialog_train_flip": train_samples,
    "response_history": condensed,
    "batch_dialog_audio": audio_batches,
    "batch_speech": speech_batches,
    "batch_classification": classification,
    "batch_prosody": prosody,
}

# --- the same in SQL -------------------------------------------------------------------------------------------------

def _shares(edges: list[int]) -> str:
    """The histories as they are; what is rounded is the result."""
    return _histories(edges).replace("round(CASE", "(CASE").replace(", 6) AS", ") AS")


_CLIPS = f"""
sig AS (SELECT clip_id AS session, CAST(max(waveform) AS DOUBLE[][]) AS w, coalesce(max(sample_rate), {RATE}) AS rate FROM clips WHERE waveform IS NOT NULL GROUP BY clip_id),
ses AS (SELECT session, w, rate, coalesce(list_max(list_transform(w, lambda c: len(c))), 0) / rate AS duration FROM sig),
sg0 AS (SELECT clip_id AS session, unnest(range(len(vad))) AS channel, unnest(vad) AS segs FROM clips WHERE waveform IS NOT NULL),
sg1 AS (SELECT session, channel, unnest(segs) AS seg FROM sg0 WHERE channel < 2),
seg AS (SELECT DISTINCT session, channel, greatest(least(seg[1], seg[2]), 0) AS start, greatest(seg[1], seg[2]) AS "end" FROM sg1
        WHERE len(seg) = 2 AND seg[1] IS NOT NULL AND seg[2] IS NOT NULL AND isfinite(seg[1]) AND isfinite(seg[2]) AND greatest(seg[1], seg[2]) > greatest(least(seg[1], seg[2]), 0)),
tot AS (SELECT session, CAST(trunc(duration / 0.01) AS INT) AS total FROM ses),
frm AS (SELECT session, channel, least(CAST(trunc(start / 0.01) AS INT), total) AS sf, least(CAST(trunc("end" / 0.01) AS INT), total) AS ef FROM seg JOIN tot USING (session)),
act AS (SELECT DISTINCT session, channel, unnest(range(sf, ef)) AS frame FROM frm),
grid AS (SELECT session, unnest(range(total)) AS frame FROM tot),
hot AS (SELECT g.session, g.frame, CAST(max(CASE WHEN a.channel = 0 THEN 1 ELSE 0 END) AS INT) AS v0, CAST(max(CASE WHEN a.channel = 1 THEN 1 ELSE 0 END) AS INT) AS v1
        FROM grid g LEFT JOIN act a ON a.session = g.session AND a.frame = g.frame GROUP BY ALL),
past AS (SELECT session, frame, v0, v1, {_shares([6000, 3000, 1000, 500])} FROM hot),
clp AS (SELECT session, w, rate, unnest(range(greatest(CAST(trunc((duration - 10) / 8 + 1) AS INT), 0))) AS clip FROM ses)"""
_LAST = ", ".join(f"round(coalesce(max(h{i}) FILTER (i = 999), 0.5), 6) AS h{i}" for i in range(5))
_SAMPLES = f"""{_CLIPS},
o AS (SELECT session, clip, unnest(range(1200)) AS i FROM clp),
smp AS (SELECT o.session, o.clip, CAST(count(*) AS INT) AS frames, CAST(sum(coalesce(v0, 0)) AS INT) AS on0, CAST(sum(coalesce(v1, 0)) AS INT) AS on1, {_LAST} FROM o LEFT JOIN past p ON p.session = o.session AND p.frame = o.clip * 800 + o.i GROUP BY o.session, o.clip)"""
_CUT = "[CAST(trunc(clip * 8.0 * rate) AS INT) + 1:CAST(trunc((clip * 8.0 + 10.0) * rate) AS INT)]"


def _full(flip: bool) -> str:
    a, b = ("v1", "v0") if flip else ("v0", "v1")
    h = ", ".join(f"round({'1 - ' if flip else ''}max(h{i}) FILTER (frame = total - 1), 6) AS h{i}" for i in range(5))
    first = "CASE WHEN len(any_value(w)) = 2 THEN any_value(w)[2][1] ELSE any_value(w)[1][1] END" if flip else "any_value(w)[1][1]"
    return f"""WITH {_CLIPS} SELECT session, CAST(max(total) + 200 AS INT) AS frames, CAST(sum({a}) AS INT) AS on0, CAST(sum({b}) AS INT) AS on1, CAST(max(total) AS INT) AS past, {h}, round(coalesce({first}, 0), 6) AS first
FROM past JOIN tot USING (session) JOIN ses USING (session) GROUP BY session"""


_RESPONSES = f"res AS (SELECT session, event_id AS response, channel AS speaker, CAST(trunc(start / {HOP}) AS INT) AS frame FROM itv), past AS (SELECT session, frame, {_shares(EDGES)} FROM hot)"
_MINE = ", ".join(f"(CASE WHEN p.h{i} IS NULL THEN 0.5 WHEN r.speaker = 0 THEN p.h{i} ELSE 1 - p.h{i} END) AS h{i}" for i in range(len(EDGES) + 1))
_CONDENSED = f"con AS (SELECT r.session, r.response, {_MINE} FROM res r LEFT JOIN past p ON p.session = r.session AND p.frame = r.frame - 1)"
_LABELLED = f"""lab AS (SELECT event_id, session, channel, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 0 END AS label, (row_number() OVER (ORDER BY event_id) - 1) // 16 AS batch_id FROM itv)"""

SQL = {
    "dialog_audio_waveform": f"""WITH {_SAMPLES}, wav AS (SELECT session, clip, rate, coalesce(w[1]{_CUT}, []) AS a, coalesce(w[2]{_CUT}, []) AS b FROM clp)
SELECT session, CAST(clip AS INT) AS clip, rate AS sample_rate, CAST(10 AS DOUBLE) AS seconds, CAST(len(a) AS INT) AS n0, CAST(len(b) AS INT) AS n1, round(coalesce(list_sum(a), 0), 6) AS total0, round(coalesce(list_sum(b), 0), 6) AS total1,
round(list_max(list_transform(a, lambda v: abs(v))), 6) AS peak, frames, on0, on1, h0, h1, h2, h3, h4 FROM wav JOIN smp USING (session, clip)""",
    "dialog_full_sample": _full(False),
    "dialog_full_flip": _full(True),
    "dialog_train_flip": f"""WITH {_SAMPLES} SELECT session, CAST(clip AS INT) AS clip, on0 + on1 AS both, abs(on0 - on1) AS apart, {", ".join(f"round(abs(h{i} - 0.5), 6) AS h{i}" for i in range(5))}, CAST(len(w) AS INT) AS channels FROM smp JOIN clp USING (session, clip)""",
    "response_history": f"WITH {FRAMES}, {_RESPONSES}, {_CONDENSED} SELECT session, response, {", ".join(f"round(h{i}, 6) AS h{i}" for i in range(4))} FROM con",
    "batch_dialog_audio": f"""WITH {_SAMPLES}, n AS (SELECT session, clip, on0, on1, greatest(coalesce(len(w[1]{_CUT}), 0), coalesce(len(w[2]{_CUT}), 0)) AS n, (row_number() OVER (ORDER BY session, clip) - 1) // 4 AS batch_id FROM smp JOIN clp USING (session, clip))
SELECT batch_id, string_agg(CAST(session AS VARCHAR), ',' ORDER BY session, clip) AS sessions, CAST(count(*) AS INT) AS items, CAST(max(n) AS INT) AS longest, CAST(sum(on0 + on1) AS INT) AS active FROM n GROUP BY batch_id""",
    "batch_speech": f"""WITH {tables.CLIP_CHANNELS}, n AS (SELECT clip_id, channel, len(x) AS n, (len(x) - 16) // 8 + 1 AS m, (row_number() OVER (ORDER BY clip_id, channel) - 1) // 8 AS batch_id FROM cch WHERE len(x) >= {RATE})
SELECT batch_id, string_agg('clips/' || clip_id || '/' || channel || '.wav', ',' ORDER BY clip_id, channel) AS ids, CAST(max(n) AS INT) AS waveform, CAST(max(m) AS INT) AS rms, string_agg(CAST(m AS VARCHAR), ',' ORDER BY clip_id, channel) AS rms_length FROM n GROUP BY batch_id""",
    "batch_classification": f"""WITH {FRAMES}, {_RESPONSES}, {_CONDENSED}, {_LABELLED},
mean AS (SELECT session, channel, avg("end" - start) AS f0_mean FROM itv GROUP BY ALL),
win AS (SELECT r.response, CAST(sum(coalesce(CASE WHEN r.speaker = 0 THEN v0 ELSE v1 END, 0)) AS INT) AS own FROM (SELECT *, unnest(range(-24, 2)) AS o FROM res) r LEFT JOIN hot h ON h.session = r.session AND h.frame = r.frame + r.o GROUP BY r.response)
SELECT batch_id, string_agg(CAST(label AS VARCHAR), ',' ORDER BY event_id) AS labels, CAST(sum(list_sum(range(greatest(event_id % 7 - 2, 1), event_id % 7 + 2))) AS INT) AS tokens, CAST(max(least(event_id % 7 + 1, 4)) AS INT) AS longest, CAST(sum(own) AS INT) AS own,
round(sum(h0 + h1 + h2 + h3), 4) AS history, round(sum(f0_mean), 3) AS f0_mean, arg_min(CASE WHEN event_id % 5 = 4 THEN 1.0 ELSE 0.0 END, event_id)::DOUBLE AS first
FROM lab JOIN con ON con.response = event_id JOIN win ON win.response = event_id JOIN mean ON mean.session = lab.session AND mean.channel = lab.channel GROUP BY batch_id""",
    "batch_prosody": f"""WITH {tables.INTERVALS}, {_LABELLED} SELECT batch_id, string_agg(CAST(label AS VARCHAR), ',' ORDER BY event_id) AS labels, CAST(sum(CASE WHEN channel = 0 THEN 1 ELSE -1 END) AS DOUBLE) AS firsts,
CAST(sum(CASE WHEN event_id % 5 = 4 THEN CASE WHEN channel = 0 THEN 5 ELSE -5 END ELSE 0 END) AS DOUBLE) AS lasts, CAST(count(*) AS INT) AS items FROM lab GROUP BY batch_id""",
}
