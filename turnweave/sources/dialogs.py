"""Two-channel dialogue corpora: lines of transcripts to words, utterances, segments and sessions.

Parsers take (file, line_no, line) tables, so they work on files and on any other table of lines alike. All of them
are column expressions; lines that don't parse are kept in ``bad_lines`` rather than cut off silently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnweave import schemas
from turnweave.functions import text as X
from turnweave.operators.islands import merge_utterances, word_gap_segments
from turnweave.operators.joins import long_means, lookup_path, utterances_with_words
from turnweave.sources.files import read_json

#: Ranges of Fisher session numbers.
FISHER_SPLITS = {"train": (1, 5099), "validation": (5100, 5499), "test": (5500, 5850)}
#: Folders of Callhome splits.
CALLHOME_FOLDERS = {"train": "train", "validation": "devtest", "test": "evltest"}


# --- Switchboard ---------------------------------------------------------------------------------------------------


def swb_session(file: Column) -> tuple[Column, Column]:
    """(session, channel) of ``sw<session><A|B>-ms98-a-….text``."""
    name = X.basename(file)
    return F.regexp_extract(name, r"^sw(\d+)[AB]-", 1), F.when(F.regexp_extract(name, r"^sw\d+([AB])-", 1) == "A", 0).otherwise(1)


def swb_words(lines: DataFrame, clean: bool = True) -> DataFrame:
    """(session, channel, utt_key, word_idx, start, end, text) of ``key start end word`` lines.

    Tabs and runs of blanks are single blanks, words are cleaned, noise tokens and empty words dropped.
    """
    session, channel = swb_session(F.col("file"))
    s = X.strip(X.squeeze(F.col("line")))
    p = lines.select(session.alias("session"), channel.alias("channel"), F.col("line_no").alias("word_idx"), F.split(s, " ").alias("p")).where(F.size("p") == 4)
    w = p.select("session", "channel", F.get("p", F.lit(0)).alias("utt_key"), "word_idx", *(F.get("p", F.lit(i)).try_cast("double").alias(n) for i, n in ((1, "start"), (2, "end"))), F.get("p", F.lit(3)).alias("raw"))
    w = w.withColumn("text", X.clean_switchboard(F.col("raw")) if clean else F.col("raw"))
    return w.where(~F.col("raw").isin(*X.NOISE_TOKENS) & ~X.is_noise(F.col("text"))).drop("raw")


def swb_utterances(lines: DataFrame, clean: bool = True) -> DataFrame:
    """(session, channel, utt_key, text) of ``key start end words…`` lines; those of one noise token are dropped.

    The times of these files are not used: an utterance reaches from its first to its last word.
    """
    session, channel = swb_session(F.col("file"))
    p = lines.select(session.alias("session"), channel.alias("channel"), F.split(X.strip(X.squeeze(F.col("line"))), " ", 4).alias("p")).where(F.size("p") == 4)
    u = p.select("session", "channel", F.get("p", F.lit(0)).alias("utt_key"), F.get("p", F.lit(3)).alias("raw")).where(~F.col("raw").isin(*X.NOISE_TOKENS))
    return u.select("session", "channel", "utt_key", (X.clean_switchboard(F.col("raw")) if clean else F.col("raw")).alias("text"))


def swb_dialogs(words: DataFrame, utts: DataFrame, min_gap: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(utterances with words and times, segments of speech inside utterances)."""
    key = ["session", "channel", "utt_key"]
    u = utterances_with_words(utts, words, key, word="text")
    return u, word_gap_segments(words, key, "word_idx", min_gap=min_gap).select("session", "channel", "start", "end")


def audio_mapping(files: DataFrame) -> DataFrame:
    """(session, audio_path without ending) of a listing of ``sw0<session>…`` files."""
    name = X.basename(F.col("file"))
    return files.where(name.rlike(r"^sw0\w*\.")).select(F.regexp_extract(name, r"^sw0(\w*)\.", 1).alias("session"), F.regexp_replace("file", r"\.[^./]*$", "").alias("audio_path"))


def session_paths(spark: SparkSession, path: str) -> DataFrame:
    """(session, audio_path) of a JSON file that maps sessions to paths."""
    d = read_json(spark, path, T.MapType(T.StringType(), T.StringType()))
    return d.select(F.explode("value").alias("session", "audio_path"))


def speaker_means(spark: SparkSession, path: str) -> DataFrame:
    """(session, speaker, mean) of a JSON file that maps sessions to one mean for each speaker."""
    d = read_json(spark, path, T.MapType(T.StringType(), T.ArrayType(T.DoubleType())))
    return long_means(d.select(F.explode("value").alias("session", "means")))


def swb_sessions(sessions: DataFrame, paths: DataFrame, root: str, ext: str = ".wav", strict: bool = True) -> DataFrame:
    """Sessions with ``root/<relative path><ext>``; one without a path raises when read."""
    return lookup_path(sessions, paths, "session", strict).withColumns({"audio_path": F.concat(F.lit(root.rstrip("/") + "/"), F.col("audio_path"), F.lit(ext)), "dataset_name": F.lit("switchboard")})


# --- Fisher --------------------------------------------------------------------------------------------------------


def fisher_sessions(spark: SparkSession, root: str = "", ext: str = ".wav") -> DataFrame:
    """(session, split, audio_path, transcript_path) of all session numbers, by rule."""
    n = F.col("id")
    split = F.lit(None).cast("string")
    for name, (a, b) in FISHER_SPLITS.items():
        split = F.when(n.between(a, b), F.lit(name)).otherwise(split)
    return spark.range(1, FISHER_SPLITS["test"][1] + 1).select(X.zero_filled(n, 5).alias("session"), split.alias("split"), X.fisher_audio_path(n, root, ext).alias("audio_path"), X.fisher_transcript_path(n, root).alias("transcript_path"), F.lit("fisher").alias("dataset_name"))


def fisher_utterances(lines: DataFrame) -> DataFrame:
    """(file, utt_idx, channel, start, end, text) of ``start end A: text``; blank and ``#`` rows are skipped."""
    p = lines.select("file", "line_no", F.split(X.strip(F.col("line")), " ", 4).alias("p")).where((F.size("p") == 4) & (F.get("p", F.lit(0)) != "#"))
    u = _timed(p).withColumn("channel", X.channel_of(F.get("p", F.lit(2)), strict=True)).drop("p")
    return _numbered(u.where("start is not null and end is not null and channel is not null"))


def _timed(p: DataFrame) -> DataFrame:
    return p.withColumns({"start": F.get("p", F.lit(0)).try_cast("double"), "end": F.get("p", F.lit(1)).try_cast("double"), "text": F.get("p", F.lit(3))})


def _numbered(u: DataFrame) -> DataFrame:
    return u.withColumn("utt_idx", F.row_number().over(Window.partitionBy("file").orderBy("line_no")) - 1).select("file", "utt_idx", "channel", "start", "end", "text")


# --- Callhome ------------------------------------------------------------------------------------------------------


def callhome_rows(lines: DataFrame) -> DataFrame:
    """(file, line_no, line): blank and ``#`` rows dropped, a row that doesn't begin with a digit added to the row
    before with a blank; rows before the first such row are dropped."""
    kept = lines.where((X.strip(F.col("line")) != "") & ~F.col("line").startswith("#"))
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    head = kept.withColumn("_row", F.sum(F.col("line").rlike(r"^\d").cast("int")).over(w)).where("_row > 0")
    return head.groupBy("file", "_row").agg(F.min("line_no").alias("line_no"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: X.strip(x["line"])), " ").alias("line")).drop("_row")


def callhome_utterances(lines: DataFrame, clean: bool = True) -> DataFrame:
    """(file, utt_idx, channel, start, end, text): rows parsed, cleaned, runs of one speaker merged."""
    p = callhome_rows(lines).select("file", "line_no", F.split("line", " ", 4).alias("p")).where(F.size("p") == 4)
    u = _timed(p).withColumn("channel", X.channel_of(F.get("p", F.lit(2)))).where("start is not null and end is not null").drop("p")
    if clean:
        u = u.withColumn("text", X.clean_callhome(F.col("text")))
    m = merge_utterances(u, ["file"], "line_no", "channel")
    return _numbered(m)


def bad_lines(lines: DataFrame) -> DataFrame:
    """Callhome rows that begin with a digit but have no two times and a speaker."""
    p = callhome_rows(lines).withColumn("p", F.split("line", " ", 4))
    return p.where((F.size("p") < 4) | F.get("p", F.lit(0)).try_cast("double").isNull() | F.get("p", F.lit(1)).try_cast("double").isNull()).drop("p")


def callhome_files(audio: DataFrame, texts: DataFrame) -> DataFrame:
    """Audio files with their transcript, if any: names agree, ``evltest`` is ``evaltest`` among transcripts."""
    key = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "evaltest", "evltest"), r".*/(train|devtest|evltest)/", "$1/"), r"\.[^./]*$", "")
    a = audio.where(F.col("file").endswith(".wav")).select(F.col("file").alias("audio_path"), key(F.col("file")).alias("_k"))
    t = texts.select(F.col("file").alias("transcript_path"), key(F.col("file")).alias("_k"))
    folder = F.regexp_extract("_k", r"^(\w+)/", 1)
    split = F.create_map(*(x for k, v in CALLHOME_FOLDERS.items() for x in (F.lit(v), F.lit(k))))[folder]
    return a.join(t, "_k", "left").select(X.stem(F.col("audio_path")).alias("session"), split.alias("split"), "audio_path", "transcript_path", F.lit("callhome").alias("dataset_name"))


# --- vacation interviews -------------------------------------------------------------------------------------------


def vacation_utterances(docs: DataFrame) -> DataFrame:
    """(session, utt_idx, channel, start, end, text) of ``turns`` documents (file, value)."""
    t = docs.select(X.stem(F.col("file")).alias("session"), F.posexplode("value.turns").alias("utt_idx", "t"))
    return t.select("session", "utt_idx", X.channel_of(F.col("t.name"), strict=True).alias("channel"), F.col("t.start_time").alias("start"), F.col("t.end_time").alias("end"), F.col("t.utterance").alias("text"))


def vad_segments(docs: DataFrame) -> DataFrame:
    """(session, channel, seg_idx, start, end) of ``[[[s, e], …], […]]`` documents (file, value)."""
    c = docs.select(X.stem(F.col("file")).alias("session"), F.posexplode("value").alias("channel", "segs"))
    return c.select("session", "channel", F.posexplode("segs").alias("seg_idx", "seg")).select("session", "channel", "seg_idx", F.get("seg", F.lit(0)).alias("start"), F.get("seg", F.lit(1)).alias("end"))


def vacation_sessions(dialogs: DataFrame, root: str, audio: DataFrame | None = None) -> DataFrame:
    """Sessions of the dialogue files with derived audio and VAD paths. Every split holds all of them. With ``audio``, a
    listing (file) of audio files, ``audio_exists`` says whether the path is listed."""
    s = dialogs.select(X.stem(F.col("file")).alias("session")).distinct()
    path = lambda kind, ext: F.concat(F.lit(f"{root.rstrip('/')}/{kind}/"), F.col("session"), F.lit(ext))
    every = F.explode(F.array(*map(F.lit, ("train", "validation", "test"))))
    s = s.select("session", path("audio", ".wav").alias("audio_path"), path("vad", ".json").alias("vad_path"), F.lit("vacation_interview").alias("dataset_name"))
    if audio is not None:
        listed = audio.select(F.regexp_replace("file", "^file:/+", "/").alias("_f")).distinct()
        s = s.join(listed, F.col("audio_path") == F.col("_f"), "left").withColumn("audio_exists", F.col("_f").isNotNull()).drop("_f")
    return s.withColumn("split", every)


def chapter_turns(docs: DataFrame) -> DataFrame:
    """(file, speaker, start, text): turns of example documents whose start a chapter lists for their speaker."""
    t = docs.select("file", F.explode(F.flatten("value.dialog")).alias("t")).select("file", F.col("t.speaker").alias("speaker"), F.col("t.start").alias("start"), F.col("t.text").alias("text"))
    c = docs.select("file", F.explode("value.chapter").alias("speaker", "starts")).select("file", "speaker", F.explode("starts").alias("s")).select("file", "speaker", F.get("s", F.lit(0)).alias("start"))
    return t.join(c, ["file", "speaker", "start"], "left_semi")


DOCUMENT_SCHEMAS = {"dialog": schemas.VACATION_DIALOG, "vad": schemas.VAD_JSON, "example": schemas.EXAMPLE_DIALOG}
