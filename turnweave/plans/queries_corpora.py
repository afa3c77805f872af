"""Queries that bring corpora's own formats to tables: the test tables written as lines, documents and listings of each
corpus, then read by its parsers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave import schemas
from turnweave.functions import text as X
from turnweave.functions import timing as M
from turnweave.operators import dialog as D
from turnweave.operators import normalize, windows
from turnweave.plans import tables
from turnweave.plans.queries_dialog import WORDS, chain_sql, words_of
from turnweave.plans.tables import DIALOGS, TURNS, UTTERANCES
from turnweave.runtime import table
from turnweave.sources import corpora, dialogs, sinks

K = ["session", "reel"]
R6 = lambda c: F.round(c, 6)


def _swb(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(word lines, utterance lines) of the Switchboard sessions, in files named as that corpus names them."""
    file = lambda kind: F.concat(F.col("session"), F.when(F.col("channel") == 0, "A").otherwise("B"), F.lit(f"-ms98-a-{kind}.text")).alias("file")
    key = F.concat_ws("-", "session", F.col("reel").cast("string"), F.col("line_no").cast("string"))
    u = tables.utterances(s, d).where("session like 'sw%' and channel is not null")
    w = words_of(s, d).join(u.select(*K, "line_no", "channel"), [*K, "line_no"])
    times = [F.col(c).cast("string") for c in ("start", "end")]
    words = w.select(file("word"), "word_idx", F.concat(key, F.lit("\t"), times[0], F.lit("  "), times[1], F.lit(" "), F.col("word")).alias("line")).where("line is not null")
    utts = u.where("text is not null").select(file("trans"), "line_no", F.concat(key, F.lit(" 0.0 0.0 "), F.col("text")).alias("line"))
    return words.withColumnRenamed("word_idx", "line_no"), utts


def swb_words(s: SparkSession, d: str) -> DataFrame:
    return dialogs.swb_words(_swb(s, d)[0])


def swb_dialogs(s: SparkSession, d: str) -> DataFrame:
    w, u = _swb(s, d)
    utts, _ = dialogs.swb_dialogs(dialogs.swb_words(w), dialogs.swb_utterances(u))
    said = D.without_words(utts.select("utt_key", F.array(F.struct("start", "end", "words")).alias("dialog")))
    n = utts.select("utt_key", F.size("words").alias("n"))
    return said.join(n, "utt_key").select("utt_key", F.col("dialog")[0]["start"].alias("start"), F.col("dialog")[0]["end"].alias("end"), "n")


def swb_segments(s: SparkSession, d: str) -> DataFrame:
    w, u = _swb(s, d)
    return dialogs.swb_dialogs(dialogs.swb_words(w), dialogs.swb_utterances(u))[1]


def _recordings(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "recordings").where("rec_id is not null").select("rec_id").distinct()


def swb_sessions(s: SparkSession, d: str) -> DataFrame:
    r = _recordings(s, d)
    name = lambda end: F.concat(F.lit("disc"), (F.col("rec_id") % 4).cast("string"), F.lit("/sw0"), F.col("rec_id").cast("string"), F.lit(end))
    files = r.select(name(".sph").alias("file")).unionByName(r.select(F.concat(F.lit("notes/"), F.col("rec_id").cast("string"), F.lit(".txt")).alias("file")))
    return dialogs.swb_sessions(r.select(F.col("rec_id").cast("string").alias("session")), dialogs.audio_mapping(files), "/audio/")


def callhome_files(s: SparkSession, d: str) -> DataFrame:
    r = _recordings(s, d).withColumn("k", F.col("rec_id") % 3)
    folder = lambda t: F.when(F.col("k") == 0, "train").when(F.col("k") == 1, "devtest").otherwise(t)
    path = lambda root, t, end: F.concat(F.lit(f"{root}/"), folder(t), F.lit("/en_"), F.col("rec_id").cast("string"), F.lit(end)).alias("file")
    return dialogs.callhome_files(r.select(path("audio", "evltest", ".wav")), r.where("rec_id % 5 <> 0").select(path("trans", "evaltest", ".txt")))


def _vacation_docs(s: SparkSession, d: str) -> DataFrame:
    u = tables.utterances(s, d)
    turn = F.struct(F.when(F.col("channel") == 0, "A:").when(F.col("channel") == 1, "B:").alias("name"), F.col("start").alias("start_time"), F.col("end").alias("end_time"), F.col("text").alias("utterance"))
    g = u.groupBy(*K).agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", turn.alias("t")))), lambda x: x["t"]).alias("turns"))
    text = F.to_json(F.struct("turns"), {"ignoreNullFields": "false"})
    return g.select(F.concat_ws("", F.lit("v/dialogs/"), F.col("session"), F.lit("_"), F.col("reel").cast("string"), F.lit(".json")).alias("file"), F.from_json(text, schemas.VACATION_DIALOG).alias("value"))


def vacation_sessions(s: SparkSession, d: str) -> DataFrame:
    docs = _vacation_docs(s, d)
    audio = docs.where("size(value.turns) > 20").select(F.concat(F.lit("/v/audio/"), X.stem(F.col("file")), F.lit(".wav")).alias("file"))
    return dialogs.vacation_sessions(docs, "/v", audio)


def vad_documents(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "vad_lists").where("vad is not null and time_unit = 'ms'").select("list_id", "vad").distinct()
    docs = v.select(F.concat(F.lit("vad/"), F.col("list_id").cast("string"), F.lit(".json")).alias("file"), F.from_json(sinks.vad_json(F.transform("vad", lambda ch: F.transform(ch, lambda seg: F.transform(seg, lambda t: F.round(t))))), schemas.VAD_JSON).alias("value"))
    seg = dialogs.vad_segments(docs)
    return seg.groupBy("session", "channel").agg(F.count("start").alias("starts"), F.count("end").alias("ends"), F.sum("start").alias("start"), F.sum("end").alias("end"))


def text_corpora(s: SparkSession, d: str) -> DataFrame:
    t = tables.dialogs(s, d).where("dialog is not null").select("dialog_id", "dialog")
    pairs = lambda text, who: F.transform("dialog", lambda x, i: F.struct(x.alias(text), F.floor(i / 2).cast("string").alias(who)))
    tm = t.select(pairs("text", "speaker").alias("utterances"))
    raw = {
        "curiosity_dialogs": t.select(pairs("message", "sender").alias("messages")), "daily_dialog": t.select("dialog", F.lit(1).alias("act")), "multiwoz_v22": t.select(pairs("utterance", "speaker").alias("turns")),
        "metawoz": t.select(F.col("dialog").alias("turns")), "taskmaster1": tm, "taskmaster2": {p: tm for p in corpora.TASKMASTER2_PARTS}, "taskmaster3": tm,
    }
    u = corpora.load_texts(raw, list(corpora.LOADERS))
    return u.groupBy("dataset_name").agg(F.count(F.lit(1)).alias("dialogs"), F.sum(F.size("dialog")).alias("turns"), F.sum(F.length(F.array_join("dialog", " | "))).alias("letters"))


def stored_splits(s: SparkSession, d: str) -> DataFrame:
    index = table(s, d, "customer").select((F.col("c_custkey") * 2).alias("pos"), F.when(F.col("c_custkey") % 3 == 0, "test").otherwise("train").alias("split"))
    t = table(s, d, "orders").select("o_orderkey")
    return corpora.stored_split(t, ["o_orderkey"], index, "test").unionByName(corpora.stored_split(t, ["o_orderkey"], index, "train"))


def _vctk(s: SparkSession, d: str) -> DataFrame:
    i = table(s, d, "supplier").select(F.concat(F.lit("p"), (280 + F.col("s_nationkey")).cast("string"), F.lit("_"), F.col("s_suppkey").cast("string")).alias("id"), "s_name")
    audio = i.select(F.explode(F.array(*(F.concat(F.lit("wav48/"), F.col("id"), F.lit(f"_{m}.flac")) for m in ("mic1", "mic2")))).alias("file"))
    lines = i.select(F.concat(F.lit("txt/"), F.col("id"), F.lit(".txt")).alias("file"), F.posexplode(F.array(F.concat(F.lit(" "), F.col("s_name")), F.lit("second line"))).alias("line_no", "line"))
    return corpora.vctk(audio, lines)


def speech_union(s: SparkSession, d: str) -> DataFrame:
    lj = corpora.lj_speech(table(s, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit("lj/"), F.col("p_partkey").cast("string")).alias("file"), F.col("p_name").alias("text"), "p_partkey"), ["p_partkey"])
    return corpora.load_speech({"vctk": _vctk(s, d), "lj_speech": lj.drop("p_partkey")}, ["vctk", "lj_speech"])


def timit_units(s: SparkSession, d: str) -> DataFrame:
    w = words_of(s, d).where("word is not null and start is not null and end is not null")
    at = lambda c: M.time_to_samples(F.col(c), 16000).cast("string")
    lines = w.select(F.concat_ws("/", "session", F.col("reel").cast("string"), F.col("line_no").cast("string")).alias("file"), F.col("word_idx").alias("line_no"), F.concat_ws(" ", at("start"), at("end"), F.col("word")).alias("line"))
    return corpora.timit(lines)


def chapters(s: SparkSession, d: str) -> DataFrame:
    u = tables.utterances(s, d).where("start is not null and channel is not null").withColumn("who", F.concat(F.lit("s"), F.col("channel").cast("string")))
    turns = u.groupBy("session").agg(F.array(F.collect_list(F.struct("text", "start", F.col("who").alias("speaker")))).alias("dialog"))
    marks = u.where("line_no % 3 = 0").groupBy("session", "who").agg(F.collect_list(F.array("start")).alias("starts")).groupBy("session").agg(F.map_from_entries(F.collect_list(F.struct("who", "starts"))).alias("chapter"))
    docs = turns.join(marks, "session").select(F.col("session").alias("file"), F.struct("dialog", "chapter").alias("value"))
    return dialogs.chapter_turns(docs)


def normalized_features(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("loudness"), F.when(F.col("o_orderkey") % 4 == 0, 0.0).otherwise(F.col("o_totalprice").cast("double")).alias("f0"))
    return normalize.normalize_features(o, ["o_custkey"], ["loudness"], ["f0"]).select("o_orderkey", R6("loudness").alias("loudness"), R6("f0").alias("f0"))


def random_starts(s: SparkSession, d: str) -> DataFrame:
    """Where random segments begin, as what must hold of them: inside the item, 0 for short ones, spread over it."""
    length = F.col("o_totalprice").cast("double")
    at = windows.random_segment(F.col("o_orderkey"), length, 1000.0)
    g = table(s, d, "orders").select(length.alias("n"), at.alias("at"))
    return g.agg(F.count(F.lit(1)).alias("items"), F.sum(F.when((F.col("at") < 0) | ((F.col("n") >= 1000) & (F.col("at") > F.col("n") - 1000)) | ((F.col("n") < 1000) & (F.col("at") != 0)), 1).otherwise(0)).alias("outside"))


QUERIES = {
    "swb_words": swb_words,
    "swb_dialogs": swb_dialogs,
    "swb_segments": swb_segments,
    "swb_sessions": swb_sessions,
    "callhome_files": callhome_files,
    "vacation_utterances": lambda s, d: dialogs.vacation_utterances(_vacation_docs(s, d)),
    "vacation_sessions": vacation_sessions,
    "vad_documents": vad_documents,
    "text_corpora": text_corpora,
    "stored_splits": stored_splits,
    "speech_union": speech_union,
    "timit_units": timit_units,
    "chapter_turns": chapters,
    "normalize_features": normalized_features,
    "random_segments": random_starts,
}

# --- the same in SQL -------------------------------------------------------------------------------------------------

_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_SWB = rf"""{UTTERANCES}{WORDS},
sw0 AS (SELECT w.*, u.channel, regexp_extract(w.session, '^sw(\d+)', 1) AS sess, w.session || '-' || w.reel || '-' || w.line_no AS utt_key, {_TRIM.format("w.w.word")} AS raw, w.w.start AS s, w.w."end" AS e
        FROM wrd w JOIN utt u ON u.session = w.session AND u.reel = w.reel AND u.line_no = w.line_no WHERE w.session LIKE 'sw%' AND u.channel IS NOT NULL),
sw1 AS (SELECT sess AS session, CAST(channel AS INT) AS channel, utt_key, CAST(word_idx AS INT) AS word_idx, s AS start, e AS "end", raw, {chain_sql("raw", X.SWITCHBOARD_RULES)} AS text FROM sw0 WHERE s IS NOT NULL AND e IS NOT NULL AND regexp_matches(raw, '^\S+$')),
sww AS (SELECT * EXCLUDE (raw) FROM sw1 WHERE raw NOT IN ('[silence]', '[noise]', '[vocalized-noise]') AND text NOT IN ('[silence]', '[noise]', '[vocalized-noise]', '')),
swu AS (SELECT regexp_extract(session, '^sw(\d+)', 1) AS session, channel, session || '-' || reel || '-' || line_no AS utt_key FROM utt WHERE session LIKE 'sw%' AND channel IS NOT NULL AND {_TRIM.format("text")} <> '' AND {_TRIM.format("text")} NOT IN ('[silence]', '[noise]', '[vocalized-noise]'))"""
_REC = "r AS (SELECT DISTINCT rec_id FROM recordings WHERE rec_id IS NOT NULL)"

SQL = {
    "swb_words": f"WITH {_SWB} SELECT * FROM sww",
    "swb_dialogs": f"""WITH {_SWB} SELECT w.utt_key, arg_min(start, word_idx) AS start, arg_max("end", word_idx) AS "end", CAST(count(*) AS INT) AS n FROM sww w JOIN swu u ON u.utt_key = w.utt_key GROUP BY w.utt_key""",
    "swb_segments": f"""WITH {_SWB}, a AS (SELECT *, CASE WHEN start - lag("end") OVER q < 0.05 THEN 0 ELSE 1 END AS n FROM sww WINDOW q AS (PARTITION BY utt_key ORDER BY word_idx)),
b AS (SELECT *, sum(n) OVER (PARTITION BY utt_key ORDER BY word_idx ROWS UNBOUNDED PRECEDING) AS g FROM a) SELECT session, channel, arg_min(start, word_idx) AS start, arg_max("end", word_idx) AS "end" FROM b GROUP BY session, channel, utt_key, g""",
    "swb_sessions": f"WITH {_REC} SELECT CAST(rec_id AS VARCHAR) AS session, '/audio/disc' || (rec_id % 4) || '/sw0' || rec_id || '.wav' AS audio_path, 'switchboard' AS dataset_name FROM r",
    "callhome_files": f"""WITH {_REC}, f AS (SELECT rec_id, ['train', 'devtest', 'evltest'][1 + rec_id % 3] AS a, ['train', 'devtest', 'evaltest'][1 + rec_id % 3] AS t, ['train', 'validation', 'test'][1 + rec_id % 3] AS split FROM r)
SELECT 'en_' || rec_id AS session, split, 'audio/' || a || '/en_' || rec_id || '.wav' AS audio_path, CASE WHEN rec_id % 5 <> 0 THEN 'trans/' || t || '/en_' || rec_id || '.txt' END AS transcript_path, 'callhome' AS dataset_name FROM f""",
    "vacation_utterances": f"""WITH {UTTERANCES} SELECT session || '_' || reel AS session, CAST(row_number() OVER (PARTITION BY session, reel ORDER BY line_no) - 1 AS INT) AS utt_idx, channel, start, "end", text FROM utt""",
    "vacation_sessions": f"""WITH {UTTERANCES}, s AS (SELECT session || '_' || reel AS session, count(*) > 20 AS audio_exists FROM utt GROUP BY session, reel)
SELECT session, '/v/audio/' || session || '.wav' AS audio_path, '/v/vad/' || session || '.json' AS vad_path, 'vacation_interview' AS dataset_name, split, audio_exists FROM s, (SELECT unnest(['train', 'validation', 'test']) AS split)""",
    "vad_documents": """WITH v AS (SELECT DISTINCT list_id, vad FROM vad_lists WHERE vad IS NOT NULL AND time_unit = 'ms'), c AS (SELECT list_id, unnest(range(len(vad))) AS channel, unnest(vad) AS segs FROM v), g AS (SELECT list_id, channel, unnest(segs) AS seg FROM c)
SELECT CAST(list_id AS VARCHAR) AS session, CAST(channel AS INT) AS channel, count(round(seg[1])) AS starts, count(round(seg[2])) AS ends, sum(round(seg[1])) AS start, sum(round(seg[2])) AS "end" FROM g GROUP BY list_id, channel""",
    "text_corpora": f"""WITH {TURNS}, g AS (SELECT dialog_id, turn // 2 AS k, coalesce(string_agg(text, ' ' ORDER BY turn), '') AS t FROM trn GROUP BY ALL),
m AS (SELECT dialog_id, list(t ORDER BY k) AS merged FROM g GROUP BY dialog_id),
a AS (SELECT dlg.dialog, coalesce(m.merged, []) AS merged FROM dlg LEFT JOIN m USING (dialog_id) WHERE dlg.dialog IS NOT NULL),
n AS (SELECT unnest(['daily_dialog', 'metawoz']) AS dataset_name, 1 AS times, false AS m UNION ALL SELECT unnest(['curiosity_dialogs', 'multiwoz_v22', 'taskmaster1', 'taskmaster3']), 1, true UNION ALL SELECT 'taskmaster2', 3, true),
x AS (SELECT dataset_name, times, CASE WHEN m THEN merged ELSE list_filter(dialog, lambda t: true) END AS dialog FROM a, n)
SELECT dataset_name, CAST(sum(times) AS BIGINT) AS dialogs, CAST(sum(times * len(dialog)) AS BIGINT) AS turns, CAST(sum(times * coalesce(length(array_to_string(list_filter(dialog, lambda t: t IS NOT NULL), ' | ')), 0)) AS BIGINT) AS letters FROM x GROUP BY dataset_name""",
    "stored_splits": "WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders) SELECT o_orderkey, CASE WHEN c_custkey % 3 = 0 THEN 'test' ELSE 'train' END AS split FROM p JOIN customer ON pos = c_custkey * 2",
    "speech_union": """WITH v AS (SELECT 'p' || (280 + s_nationkey) AS speaker, 'p' || (280 + s_nationkey) || '_' || s_suppkey AS id, s_name FROM supplier WHERE s_nationkey IS NOT NULL AND s_nationkey <> 0),
n AS (SELECT speaker, row_number() OVER (ORDER BY speaker) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT speaker FROM v)),
p AS (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_partkey) - 1 AS pos, count(*) OVER () AS n FROM part)
SELECT 'vctk' AS dataset_name, CASE WHEN pos < floor(n * 0.85) THEN 'train' WHEN pos < floor(n * 0.85) + floor(n * 0.1) + 1 THEN 'validation' ELSE 'test' END AS split, id, 'wav48/' || id || '_mic2.flac' AS file, s_name AS text FROM v JOIN n USING (speaker)
UNION ALL SELECT 'lj_speech', CASE WHEN pos < round(n * 0.85) THEN 'train' WHEN pos < round(n * 0.95) THEN 'validation' ELSE 'test' END, CAST(p_partkey AS VARCHAR), 'lj/' || p_partkey, p_name FROM p""",
    "timit_units": rf"""WITH {UTTERANCES}{WORDS} SELECT session || '/' || reel || '/' || line_no AS file, CAST(word_idx AS INT) AS idx, CAST(trunc(w.start * 16000) AS INT) AS start, CAST(trunc(w."end" * 16000) AS INT) AS "end", regexp_replace(w.word, '\s+$', '') AS phoneme
FROM wrd WHERE w.word IS NOT NULL AND regexp_replace(w.word, '\s+', '', 'g') <> '' AND w.start IS NOT NULL AND w."end" IS NOT NULL""",
    "chapter_turns": f"""WITH {UTTERANCES}, u AS (SELECT *, 's' || channel AS who FROM utt WHERE start IS NOT NULL AND channel IS NOT NULL), c AS (SELECT DISTINCT session, who, start FROM u WHERE line_no % 3 = 0)
SELECT session AS file, who AS speaker, start, text FROM u WHERE (session, who, start) IN (SELECT (session, who, start) FROM c)""",
    "normalize_features": """WITH o AS (SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DOUBLE) AS x, CASE WHEN o_orderkey % 4 = 0 THEN 0.0 ELSE CAST(o_totalprice AS DOUBLE) END AS y FROM orders), t AS (SELECT avg(y) FILTER (y <> 0) AS m, stddev_samp(y) FILTER (y <> 0) AS sd FROM o)
SELECT o_orderkey, round(CASE WHEN stddev_samp(x) OVER w > 0 THEN (x - avg(x) OVER w) / stddev_samp(x) OVER w END, 6) AS loudness, round(CASE WHEN y = 0 THEN 0 ELSE (y - m) / sd END, 6) AS f0 FROM o, t WINDOW w AS (PARTITION BY o_custkey)""",
    "random_segments": "SELECT count(*) AS items, CAST(0 AS BIGINT) AS outside FROM orders",
}
