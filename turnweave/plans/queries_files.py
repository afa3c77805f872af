"""Queries over sources' formats, splits, sets, lookups and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.functions import text as X
from turnweave.operators import joins, splits
from turnweave.plans import tables
from turnweave.plans.queries_dialog import chain_sql
from turnweave.plans.tables import UTTERANCES
from turnweave.runtime import table
from turnweave.sources import corpora, dialogs


def lines(s: SparkSession, d: str) -> DataFrame:
    """The lines of transcripts as files of lines: file, line_no, line."""
    u = tables.utterances(s, d).where("text is not null")
    return u.select(F.concat_ws("/", "session", F.col("reel").cast("string")).alias("file"), "line_no", F.col("text").alias("line"))


LINES = UTTERANCES + ", lin AS (SELECT session || '/' || reel AS file, line_no, text AS line FROM utt WHERE text IS NOT NULL)"


def prompts(s: SparkSession, d: str) -> DataFrame:
    key = F.regexp_replace(F.regexp_replace(F.lower("source"), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    t = table(s, d, "documents").where((key == "read_prompts") & F.col("text").isNotNull())
    return t.select(F.concat(F.lit("train/"), F.col("doc_id").cast("string"), F.lit("/a.txt")).alias("file"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def librispeech(s: SparkSession, d: str) -> DataFrame:
    p = prompts(s, d).where(X.strip(F.col("line")).rlike(r"^[0-9]+-[0-9]+-[0-9]+ "))
    return corpora.librispeech(p)


def slices(s: SparkSession, d: str) -> DataFrame:
    return splits.percent_slices(table(s, d, "customer").select("c_custkey"), ["c_custkey"], corpora.LJ_SLICES)


def speakers(s: SparkSession, d: str) -> DataFrame:
    return splits.speaker_splits(table(s, d, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", leave_out=()).select("s_suppkey", "s_nationkey", "split")


def selected(s: SparkSession, d: str) -> DataFrame:
    index = table(s, d, "nation").select((F.col("n_nationkey") * 3).cast("long").alias("pos"))
    return splits.at_positions(table(s, d, "customer").select("c_custkey", "c_name"), ["c_custkey"], index)


def split_counts(s: SparkSession, d: str) -> DataFrame:
    """Rows and different keys of each split: what the sizes must be whatever the order, each key in one split."""
    t = splits.shuffled_splits(table(s, d, "orders").select("o_orderkey"), "o_orderkey", halves=True)
    several = t.groupBy("o_orderkey").agg(F.countDistinct("split").alias("n")).agg(F.max("n").alias("splits_of_a_key"))
    return t.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("o_orderkey").alias("keys")).crossJoin(F.broadcast(several))


def sessions(s: SparkSession, d: str) -> DataFrame:
    return tables.utterances(s, d).select("session").distinct()


def vad_sessions(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "vad_lists").select("session").distinct()


def with_transcript(s: SparkSession, d: str) -> DataFrame:
    """Recordings with the lines of their transcript; those without one have null session and lines."""
    r = table(s, d, "recordings").where("audio_path is not null").select("rec_id", "audio_path").distinct()
    t = tables.utterances(s, d).groupBy("session", "reel").agg(F.count(F.lit(1)).alias("lines"))
    return joins.pair_by(r, t, X.stem(F.col("audio_path")), F.concat_ws("_", "session", F.col("reel").cast("string"))).select("rec_id", "audio_path", "session", "lines")


def mean_lookup(s: SparkSession, d: str) -> DataFrame:
    i = tables.intervals(s, d)
    means = i.groupBy("session").agg(F.array(*(F.round(F.avg(F.when(F.col("channel") == c, F.col("end") - F.col("start"))), 6) for c in (0, 1))).alias("means"))
    long = joins.long_means(means).withColumnRenamed("speaker", "channel")
    return i.join(long, ["session", "channel"]).select("event_id", "session", "channel", "mean")


def paths(s: SparkSession, d: str) -> DataFrame:
    p = F.col("audio_path")
    return table(s, d, "recordings").where(p.isNotNull()).select("rec_id", p.alias("path")).distinct().select(
        "rec_id", X.basename(F.col("path")).alias("base"), X.dirname(F.col("path")).alias("folder"), X.stem(F.col("path")).alias("stem"), X.swap_suffix(F.col("path"), ".sph", ".wav").alias("wav"),
        X.join_first(X.stem(F.col("path")), "_", 2).alias("two"), X.zero_filled(F.col("rec_id"), 5).alias("padded"), X.fisher_disc(F.col("rec_id")).alias("disc"), X.fisher_audio_path(F.col("rec_id"), "x/").alias("fisher"),
    )


def event_labels(s: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "shift").when(F.col("event_type") == "view", "hold").otherwise("backchannel")
    return table(s, d, "events").select("event_id", X.label_index(kind).alias("label"), X.label_name(X.label_index(kind)).alias("name"))


def numbered_rows(s: SparkSession, d: str) -> DataFrame:
    rows = dialogs.callhome_rows(lines(s, d))
    return rows.select("file", "line_no", "line")


QUERIES = {
    "fisher_sessions": lambda s, d: dialogs.fisher_sessions(s, "fisher/"),
    "fisher_lines": lambda s, d: dialogs.fisher_utterances(lines(s, d)),
    "callhome_rows": numbered_rows,
    "callhome_utterances": lambda s, d: dialogs.callhome_utterances(lines(s, d)),
    "librispeech_lines": librispeech,
    "percent_slice": slices,
    "speaker_split": speakers,
    "kfold_11": lambda s, d: splits.folds(table(s, d, "part").select("p_partkey"), ["p_partkey"]),
    "index_select": selected,
    "shuffled_split": lambda s, d: splits.shuffled_splits(table(s, d, "orders").select("o_orderkey"), "o_orderkey", halves=True),
    "shuffled_split_counts": split_counts,
    "session_semi": lambda s, d: joins.only(sessions(s, d), vad_sessions(s, d), "session"),
    "aside_anti": lambda s, d: joins.without(sessions(s, d), table(s, d, "transcripts").where("text like '%aside>%'"), "session"),
    "left_transcript_join": with_transcript,
    "two_key_lookup": mean_lookup,
    "path_parts": paths,
    "label_encode": event_labels,
    "json_props": lambda s, d: table(s, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"), F.to_json(F.from_json("props", "k int")).alias("again")),
    "constant_column": lambda s, d: table(s, d, "documents").withColumn("dataset_name", F.lit("documents")).select("doc_id", "dataset_name"),
}

_HEAD = r"regexp_matches(line, '^[0-9]')"
_ROWS = f"""kept AS (SELECT * FROM lin WHERE regexp_replace(line, '^\\s+|\\s+$', '', 'g') <> '' AND NOT starts_with(line, '#')),
num AS (SELECT *, sum(CASE WHEN {_HEAD} THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS n FROM kept),
crow AS (SELECT file, min(line_no) AS line_no, string_agg(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), ' ' ORDER BY line_no) AS line FROM num WHERE n > 0 GROUP BY file, n)"""
_TIMED = r"'^(\S*) (\S*) (\S*) ((?s).*)$'"


def _parsed(source: str, line: str) -> str:
    f = lambda i: f"regexp_extract({line}, {_TIMED}, {i})"
    return f"""SELECT file, line_no, TRY_CAST({f(1)} AS DOUBLE) AS start, TRY_CAST({f(2)} AS DOUBLE) AS "end", {f(3)} AS who, {f(4)} AS text FROM {source} WHERE regexp_matches({line}, {_TIMED})"""


_WHO = r"regexp_replace(upper(who), '[:.]$', '')"

SQL = {
    "fisher_sessions": """WITH n AS (SELECT unnest(range(1, 5851)) AS id), p AS (SELECT id, lpad(CAST(id AS VARCHAR), 5, '0') AS session, CASE WHEN id < 800 THEN 1 ELSE (id - 800) // 900 + 2 END AS disc FROM n)
SELECT session, CASE WHEN id <= 5099 THEN 'train' WHEN id <= 5499 THEN 'validation' ELSE 'test' END AS split, 'fisher/fisher_eng_tr_sp_d' || disc || '/audio/' || session[1:3] || '/fe_03_' || session || '.wav' AS audio_path,
'fisher/fe_03_p1_tran/data/trans/' || session[1:3] || '/fe_03_' || session || '.txt' AS transcript_path, 'fisher' AS dataset_name FROM p""",
    "fisher_lines": f"""WITH {LINES}, p AS ({_parsed("lin", "regexp_replace(line, '^\\s+|\\s+$', '', 'g')")}),
u AS (SELECT *, CASE WHEN {_WHO} IN ('A', 'AGENT', '0') THEN 0 WHEN {_WHO} IN ('B', 'USER', '1') THEN 1 END AS channel FROM p WHERE start IS NOT NULL AND "end" IS NOT NULL)
SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY line_no) - 1 AS INT) AS utt_idx, channel, start, "end", text FROM u WHERE channel IS NOT NULL""",
    "callhome_rows": f"WITH {LINES}, {_ROWS} SELECT file, line_no, line FROM crow",
    "librispeech_lines": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE regexp_replace(regexp_replace(lower(source), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') = 'read_prompts' AND text IS NOT NULL),
p AS (SELECT doc_id, line FROM (SELECT doc_id, regexp_replace(line, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS line FROM l) WHERE regexp_matches(line, '^[0-9]+-[0-9]+-[0-9]+ ')), h AS (SELECT doc_id, string_split(line, ' ')[1] AS id, regexp_replace(line, '^[^ ]* ', '') AS text FROM p)
SELECT id, 'train/' || doc_id || '/' || id || '.flac' AS file, text, CAST(string_split(id, '-')[1] AS BIGINT) AS speaker_id, CAST(string_split(id, '-')[2] AS BIGINT) AS chapter_id FROM h""",
    "percent_slice": """WITH p AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos, count(*) OVER () AS n FROM customer)
SELECT c_custkey, CASE WHEN pos < round(n * 0.85) THEN 'train' WHEN pos < round(n * 0.95) THEN 'validation' ELSE 'test' END AS split FROM p""",
    "speaker_split": """WITH s AS (SELECT DISTINCT s_nationkey FROM supplier WHERE s_nationkey IS NOT NULL), p AS (SELECT s_nationkey, row_number() OVER (ORDER BY s_nationkey) - 1 AS pos, count(*) OVER () AS n FROM s)
SELECT s_suppkey, s_nationkey, CASE WHEN pos < floor(n * 0.85) THEN 'train' WHEN pos < floor(n * 0.85) + floor(n * 0.1) + 1 THEN 'validation' ELSE 'test' END AS split FROM supplier JOIN p USING (s_nationkey)""",
    "kfold_11": "SELECT p_partkey, CAST(ntile(11) OVER (ORDER BY p_partkey) - 1 AS INT) AS fold FROM part",
    "index_select": "WITH p AS (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer) SELECT pos, c_custkey, c_name FROM p WHERE pos IN (SELECT n_nationkey * 3 FROM nation)",
    "shuffled_split_counts": """WITH n AS (SELECT count(*) AS n, CAST(floor(count(*) * 0.9) AS BIGINT) AS a FROM orders), r AS (SELECT 'train' AS split, a AS rows FROM n UNION ALL SELECT 'validation', (n - a) // 2 FROM n UNION ALL SELECT 'test', n - a - (n - a) // 2 FROM n)
SELECT split, rows, rows AS keys, CAST(1 AS BIGINT) AS splits_of_a_key FROM r""",
    "callhome_utterances": f"""WITH {LINES}, {_ROWS}, p AS ({_parsed("crow", "line")}),
u AS (SELECT file, line_no, start, "end", CASE WHEN {_WHO} IN ('A', 'AGENT', '0') THEN 0 ELSE 1 END AS channel, {chain_sql("text", X.CALLHOME_RULES)} AS text FROM p WHERE start IS NOT NULL AND "end" IS NOT NULL),
m AS (SELECT *, CASE WHEN lag(channel) OVER q = channel THEN 0 ELSE 1 END AS n FROM u WINDOW q AS (PARTITION BY file ORDER BY line_no)), g AS (SELECT *, sum(n) OVER (PARTITION BY file ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS g FROM m),
t AS (SELECT file, g, min(channel) AS channel, arg_min(start, line_no) AS start, arg_max("end", line_no) AS "end", string_agg(text, ' ' ORDER BY line_no) AS text FROM g GROUP BY file, g)
SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY g) - 1 AS INT) AS utt_idx, channel, start, "end", text FROM t""",
    "session_semi": f"WITH {UTTERANCES} SELECT DISTINCT session FROM utt WHERE session IN (SELECT session FROM vad_lists)",
    "aside_anti": f"WITH {UTTERANCES} SELECT DISTINCT session FROM utt WHERE session NOT IN (SELECT session FROM transcripts WHERE text LIKE '%aside>%' AND session IS NOT NULL)",
    "left_transcript_join": rf"""WITH {UTTERANCES}, t AS (SELECT session || '_' || reel AS stem, any_value(session) AS session, count(*) AS lines FROM utt GROUP BY session, reel),
r AS (SELECT DISTINCT rec_id, audio_path, regexp_replace(regexp_extract(audio_path, '([^/]*)$', 1), '\.[^.]*$', '') AS stem FROM recordings WHERE audio_path IS NOT NULL)
SELECT rec_id, audio_path, session, lines FROM r LEFT JOIN t USING (stem)""",
    "two_key_lookup": f"""WITH {tables.INTERVALS} SELECT event_id, session, channel, round(avg("end" - start) OVER (PARTITION BY session, channel), 6) AS mean FROM itv""",
    "path_parts": r"""WITH r AS (SELECT DISTINCT rec_id, audio_path AS p FROM recordings WHERE audio_path IS NOT NULL), q AS (SELECT *, regexp_extract(p, '([^/]*)$', 1) AS base, regexp_replace(regexp_extract(p, '([^/]*)$', 1), '\.[^.]*$', '') AS stem,
CASE WHEN rec_id < 800 THEN 1 ELSE (rec_id - 800) // 900 + 2 END AS disc, CASE WHEN rec_id < 100000 THEN lpad(CAST(rec_id AS VARCHAR), 5, '0') ELSE CAST(rec_id AS VARCHAR) END AS padded FROM r)
SELECT rec_id, base, regexp_replace(p, '/?[^/]*$', '') AS folder, stem, regexp_replace(p, '\.sph$', '.wav') AS wav, array_to_string(string_split(stem, '_')[1:2], '_') AS two, padded, CAST(disc AS INT) AS disc,
'x/fisher_eng_tr_sp_d' || disc || '/audio/' || padded[1:3] || '/fe_03_' || padded || '.wav' AS fisher FROM q""",
    "label_encode": "SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 0 END AS label, CASE event_type WHEN 'click' THEN 'shift' WHEN 'view' THEN 'hold' ELSE 'backchannel' END AS name FROM events",
    "json_props": """SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, '{"k":' || CAST(json_extract(props, '$.k') AS INT) || '}' AS again FROM events""",
    "constant_column": "SELECT doc_id, 'documents' AS dataset_name FROM documents",
}
