"""Queries over dialogues, utterances and words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.functions import arrays as A
from turnweave.functions import text as X
from turnweave.operators import dialog as D
from turnweave.operators import islands, joins
from turnweave.operators.cumulate import numbered
from turnweave.plans import batch, dialog_text, tables
from turnweave.plans.tables import DIALOGS, TURNS, UTTERANCES
from turnweave.runtime import table
from turnweave.sources import corpora

K = ["session", "reel"]


def merged(s: SparkSession, d: str) -> DataFrame:
    return islands.merge_turns(tables.utterances(s, d), K, "line_no", "channel", "text")


def dialog_arrays(s: SparkSession, d: str) -> DataFrame:
    a = D.to_arrays(merged(s, d), K, "line_no", "text")
    return a.select(*K, F.size("dialog").alias("n_turns"), F.array_join("dialog", " | ").alias("dialog"))


def interleaved(s: SparkSession, d: str) -> DataFrame:
    u = tables.utterances(s, d).where("start is not null")
    a, b = (u.where(F.col("channel") == c).select(*K, "line_no", "start", "text") for c in (0, 1))
    n = numbered(D.interleave(a, b), K, ["start", "channel", "line_no"], F.floor(F.col("start") / 1800))
    return n.withColumn("pos", F.col("pos") + 1)


def _words(s: SparkSession, d: str) -> DataFrame:
    return tables.dialogs(s, d).where("dialog is not null").select("dialog_id", F.filter(F.split(F.array_join("dialog", " "), r"\s+"), lambda w: w != "").alias("w"))


def truncated(tail: bool):
    def run(s: SparkSession, d: str) -> DataFrame:
        return _words(s, d).select("dialog_id", F.array_join((A.tail if tail else A.head)(F.col("w"), 20), " ").alias("words"))

    return run


def padded(s: SparkSession, d: str) -> DataFrame:
    t = D.to_turns(tables.dialogs(s, d), ["dialog_id"]).select(F.col("dialog_id").alias("batch_id"), "turn", F.split(F.coalesce("text", F.lit("")), " ").alias("ids"))
    return batch.pad_to_batch(t, "ids", F.lit("<pad>")).select(F.col("batch_id").alias("dialog_id"), "turn", F.array_join("ids", " ").alias("ids"), "ids_length")


def words_of(s: SparkSession, d: str) -> DataFrame:
    return tables.utterances(s, d).select("session", "reel", "line_no", F.posexplode("words").alias("word_idx", "w")).select("session", "reel", "line_no", "word_idx", F.col("w.word").alias("word"), F.col("w.start").alias("start"), F.col("w.end").alias("end"))


def noise_filtered(s: SparkSession, d: str) -> DataFrame:
    return words_of(s, d).where(~X.is_noise(F.col("word"))).groupBy("session").agg(F.count(F.lit(1)).alias("words"), F.countDistinct("word").alias("different"))


def word_join(s: SparkSession, d: str) -> DataFrame:
    u = tables.utterances(s, d).select("session", "reel", "line_no", "text")
    j = joins.utterances_with_words(u, words_of(s, d), ["session", "reel", "line_no"])
    return j.select("session", "reel", "line_no", "start", "end", F.size("words").alias("n"), F.array_join("words.word", " ").alias("said"))


def word_segments(s: SparkSession, d: str) -> DataFrame:
    return islands.word_gap_segments(words_of(s, d), ["session", "reel", "line_no"], "word_idx")


def token_rows(s: SparkSession, d: str) -> DataFrame:
    w = words_of(s, d).where("word is not null")
    return joins.tokens_of_words(w, ["session", "reel", "line_no"], F.split("word", "[-']"), keep=5)


def clean(f):
    def run(s: SparkSession, d: str) -> DataFrame:
        return table(s, d, "transcripts").where("text is not null").select("line_id", f(F.col("text")).alias("text"))

    return run


def encoded(s: SparkSession, d: str) -> DataFrame:
    e = dialog_text.encode(D.keep_full(tables.dialogs(s, d)))
    return e.select("dialog_id", F.size("input_ids").alias("tokens"), A_sum(F.col("speaker_ids")).alias("of_second"))


def A_sum(x):
    return F.aggregate(x, F.lit(0), lambda a, v: a + v)


def batched(s: SparkSession, d: str) -> DataFrame:
    t = D.keep_full(tables.dialogs(s, d)).select("dialog_id", F.size("dialog").alias("turns"))
    c = batch.collate(batch.number_batches(t, ["dialog_id"], 16), ["dialog_id", "turns"])
    return c.select("batch_id", F.array_join(F.transform("dialog_id", lambda x: x.cast("string")), ",").alias("dialog_ids"), A_sum(F.col("turns")).alias("turns"))


def union_sources(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "documents").select(F.col("doc_id").alias("id"), "text").withColumn("dataset_name", F.lit("documents"))
    b = tables.dialogs(s, d).select(F.col("dialog_id").alias("id"), F.array_join("dialog", " ").alias("text")).withColumn("dataset_name", F.lit("text_dialogs"))
    return a.unionByName(b)


def row_merged(s: SparkSession, d: str) -> DataFrame:
    """Turns merged inside the row: every third turn continues its speaker's."""
    t = tables.dialogs(s, d).where("dialog is not null").withColumn("who", F.transform("dialog", lambda _, i: F.floor(i / 2) % 2))
    m = t.select("dialog_id", corpora.merged(F.col("dialog"), F.col("who")).alias("m"))
    return m.select("dialog_id", F.size("m").alias("n_turns"), F.array_join("m", " | ").alias("dialog"))


QUERIES = {
    "merge_consecutive_turns": lambda s, d: merged(s, d).withColumn("channel", F.coalesce("channel", F.lit(-1))),
    "merge_turns_in_row": row_merged,
    "dialog_arrays": dialog_arrays,
    "filter_empty_dialogs": lambda s, d: D.keep_full(tables.dialogs(s, d)).select("dialog_id", F.size("dialog").alias("n_turns")),
    "interleave_channels": interleaved,
    "turn_head_truncate": truncated(False),
    "turn_tail_truncate": truncated(True),
    "pad_token_arrays": padded,
    "noise_token_filter": noise_filtered,
    "swb_clean": clean(X.clean_switchboard),
    "callhome_clean": clean(X.clean_callhome),
    "utterance_word_join": word_join,
    "word_gap_merge": word_segments,
    "token_word_times": token_rows,
    "short_utterance_topk": lambda s, d: D.short_utterances(tables.utterances(s, d)),
    "backchannel_flag": lambda s, d: tables.utterances(s, d).select(*K, "line_no", F.coalesce(X.is_backchannel(F.col("text")), F.lit(False)).alias("backchannel")),
    "text_context_range": lambda s, d: D.between(tables.utterances(s, d), F.lit(10.0), F.lit(40.0)).select(*K, "line_no", F.coalesce("channel", F.lit(-1)).alias("channel"), "text"),
    "encode_dialogs": encoded,
    "batch_collate": batched,
    "union_sources": union_sources,
}

# --- the same in SQL -------------------------------------------------------------------------------------------------

WORDS = ", wrd AS (SELECT session, reel, line_no, unnest(range(len(words))) AS word_idx, unnest(words) AS w FROM utt)"
MERGED = """, mk AS (SELECT *, CASE WHEN lag(channel) OVER q IS NOT DISTINCT FROM channel AND row_number() OVER q > 1 THEN 0 ELSE 1 END AS n FROM utt WINDOW q AS (PARTITION BY session, reel ORDER BY line_no)),
gr AS (SELECT *, sum(n) OVER (PARTITION BY session, reel ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS g FROM mk),
mrg AS (SELECT session, reel, min(channel) AS channel, min(line_no) AS line_no, coalesce(string_agg(text, ' ' ORDER BY line_no), '') AS text FROM gr GROUP BY session, reel, g)"""
_DWORDS = "ws AS (SELECT dialog_id, list_filter(regexp_split_to_array(array_to_string(list_filter(dialog, lambda t: t IS NOT NULL), ' '), '\\s+'), lambda w: w <> '') AS w FROM dlg WHERE dialog IS NOT NULL)"
_FULL = r"dialog IS NOT NULL AND len(list_filter(dialog, lambda t: t IS NULL OR NOT regexp_matches(t, '[\p{L}\p{M}\p{N}_]'))) = 0"


def chain_sql(column: str, rules: tuple[tuple[str, str], ...]) -> str:
    out = column
    for pattern, new in rules:
        p = pattern.replace(r"\w", r"[\p{L}\p{M}\p{N}_]").replace("'", "''")
        n = new.replace("$", "\\").replace("'", "''")
        out = f"regexp_replace({out}, '{p}', '{n}', 'g')"
    return out


SQL = {
    "merge_consecutive_turns": f"WITH {UTTERANCES}{MERGED} SELECT session, reel, coalesce(channel, -1) AS channel, line_no, text FROM mrg",
    "merge_turns_in_row": f"""WITH {TURNS}, g AS (SELECT dialog_id, turn // 2 AS k, coalesce(string_agg(text, ' ' ORDER BY turn), '') AS t FROM trn GROUP BY ALL),
m AS (SELECT dialog_id, CAST(count(*) AS INT) AS n_turns, string_agg(t, ' | ' ORDER BY k) AS dialog FROM g GROUP BY dialog_id)
SELECT dialog_id, coalesce(n_turns, 0) AS n_turns, coalesce(m.dialog, '') AS dialog FROM dlg LEFT JOIN m USING (dialog_id) WHERE dlg.dialog IS NOT NULL""",
    "dialog_arrays": f"WITH {UTTERANCES}{MERGED} SELECT session, reel, CAST(count(*) AS INT) AS n_turns, string_agg(text, ' | ' ORDER BY line_no) AS dialog FROM mrg GROUP BY session, reel",
    "filter_empty_dialogs": f"WITH {DIALOGS} SELECT dialog_id, CAST(len(dialog) AS INT) AS n_turns FROM dlg WHERE {_FULL}",
    "interleave_channels": f"WITH {UTTERANCES} SELECT session, reel, line_no, start, text, channel, CAST(row_number() OVER (PARTITION BY session, reel ORDER BY start, channel, line_no) AS INT) AS pos FROM utt WHERE start IS NOT NULL AND channel IS NOT NULL",
    "turn_head_truncate": f"WITH {DIALOGS}, {_DWORDS} SELECT dialog_id, array_to_string(w[1:20], ' ') AS words FROM ws",
    "turn_tail_truncate": f"WITH {DIALOGS}, {_DWORDS} SELECT dialog_id, array_to_string(w[greatest(len(w) - 19, 1):], ' ') AS words FROM ws",
    "pad_token_arrays": f"""WITH {TURNS}, t AS (SELECT dialog_id, turn, string_split(coalesce(text, ''), ' ') AS ids FROM trn), m AS (SELECT dialog_id, max(len(ids)) AS most FROM t GROUP BY dialog_id)
SELECT dialog_id, CAST(turn AS INT) AS turn, array_to_string(list_concat(ids, list_transform(range(most - len(ids)), lambda i: '<pad>')), ' ') AS ids, CAST(len(ids) AS INT) AS ids_length FROM t JOIN m USING (dialog_id)""",
    "noise_token_filter": f"WITH {UTTERANCES}{WORDS} SELECT session, count(*) AS words, count(DISTINCT w.word) AS different FROM wrd WHERE w.word NOT IN ('[silence]', '[noise]', '[vocalized-noise]', '') GROUP BY session",
    "swb_clean": f"SELECT line_id, {chain_sql('text', X.SWITCHBOARD_RULES)} AS text FROM transcripts WHERE text IS NOT NULL",
    "callhome_clean": f"SELECT line_id, {chain_sql('text', X.CALLHOME_RULES)} AS text FROM transcripts WHERE text IS NOT NULL",
    "utterance_word_join": f"""WITH {UTTERANCES}{WORDS}, g AS (SELECT session, reel, line_no, arg_min(w.start, word_idx) AS start, arg_max(w."end", word_idx) AS "end", CAST(count(*) AS INT) AS n, string_agg(w.word, ' ' ORDER BY word_idx) AS said FROM wrd GROUP BY ALL)
SELECT * FROM g""",
    "word_gap_merge": f"""WITH {UTTERANCES}{WORDS}, a AS (SELECT session, reel, line_no, word_idx, w.start AS start, w."end" AS "end", CASE WHEN w.start - lag(w."end") OVER q < 0.05 THEN 0 ELSE 1 END AS n FROM wrd WINDOW q AS (PARTITION BY session, reel, line_no ORDER BY word_idx)),
b AS (SELECT *, sum(n) OVER (PARTITION BY session, reel, line_no ORDER BY word_idx ROWS UNBOUNDED PRECEDING) AS g FROM a)
SELECT session, reel, line_no, arg_min(start, word_idx) AS start, arg_max("end", word_idx) AS "end" FROM b GROUP BY session, reel, line_no, g""",
    "token_word_times": f"""WITH {UTTERANCES}{WORDS}, p AS (SELECT session, reel, line_no, word_idx, w.start AS start, w."end" AS "end", regexp_split_to_array(w.word, '[-'']') AS parts FROM wrd WHERE w.word IS NOT NULL),
t AS (SELECT session, reel, line_no, word_idx, start, "end", unnest(range(len(parts))) AS i, unnest(parts) AS token FROM p)
SELECT session, reel, line_no, token, start, "end" FROM t QUALIFY row_number() OVER (PARTITION BY session, reel, line_no ORDER BY word_idx DESC, i DESC) <= 5""",
    "short_utterance_topk": rf"""WITH {UTTERANCES} SELECT lower(trim(text)) AS text, count(*) AS n FROM utt WHERE trim(text) <> '' AND len(regexp_split_to_array(trim(text), '\s+')) <= 2 GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, text LIMIT 20""",
    "backchannel_flag": rf"WITH {UTTERANCES} SELECT session, reel, line_no, coalesce(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')) IN ('uh-huh', 'um-hum', 'yeah', 'right', 'oh', 'okay', 'really', 'yes', 'huh', 'oh yeah', 'hum', 'i see'), false) AS backchannel FROM utt",
    "text_context_range": f"""WITH {UTTERANCES} SELECT session, reel, line_no, coalesce(channel, -1) AS channel, text FROM utt WHERE start >= 10 AND "end" <= 40""",
    "encode_dialogs": f"""WITH {TURNS}, w AS (SELECT dialog_id, turn, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM trn),
c AS (SELECT dialog_id, CAST(sum(n) AS INT) AS tokens, CAST(sum(CASE WHEN turn % 2 = 1 THEN n ELSE 0 END) AS INT) AS of_second FROM w GROUP BY dialog_id)
SELECT dialog_id, coalesce(tokens, 0) AS tokens, coalesce(of_second, 0) AS of_second FROM dlg LEFT JOIN c USING (dialog_id) WHERE {_FULL.replace("dialog IS", "dlg.dialog IS").replace("list_filter(dialog,", "list_filter(dlg.dialog,")}""",
    "batch_collate": f"""WITH {DIALOGS}, k AS (SELECT dialog_id, len(dialog) AS turns, (row_number() OVER (ORDER BY dialog_id) - 1) // 16 AS batch_id FROM dlg WHERE {_FULL})
SELECT batch_id, string_agg(CAST(dialog_id AS VARCHAR), ',' ORDER BY dialog_id) AS dialog_ids, CAST(sum(turns) AS INT) AS turns FROM k GROUP BY batch_id""",
    "union_sources": f"WITH {DIALOGS} SELECT doc_id AS id, text, 'documents' AS dataset_name FROM documents UNION ALL SELECT dialog_id, array_to_string(dialog, ' '), 'text_dialogs' FROM dlg",
}
