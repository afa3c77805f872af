"""A folder of a corpus to its tables: files listed, read and parsed, splits named. One builder a corpus."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave import schemas
from turnweave.functions import text as X
from turnweave.operators.joins import only
from turnweave.sources import corpora, dialogs
from turnweave.sources.files import audio_info, list_files, read_audio, read_json, read_lines, read_list


@dataclass
class Corpus:
    """``sessions``: one row a session or item, with its split and paths; ``utterances``: what was said in them, with
    speaker and times; ``segments``: stretches of speech, where the corpus tells them apart from utterances."""

    sessions: DataFrame
    utterances: DataFrame | None = None
    segments: DataFrame | None = None


def _under(root: str, *parts: str) -> str:
    return "/".join((root.rstrip("/"), *parts))


def _split_lists(spark: SparkSession, lists: dict[str, str]) -> DataFrame:
    """(session, split) of one list file a split."""
    out = [read_list(spark, path).select(F.col("id").alias("session"), F.lit(split).alias("split")) for split, path in lists.items()]
    return corpora.union_all(out)


def switchboard(spark: SparkSession, transcripts: str, audio: str, lists: dict[str, str], paths: str | None = None, min_gap: float = 0.05) -> Corpus:
    """``lists``: file of session names of each split; ``paths``: JSON of session -> relative audio path, else the audio
    folder is listed. A session without audio raises when it is read."""
    found = dialogs.session_paths(spark, paths) if paths else dialogs.audio_mapping(list_files(spark, audio)).withColumn("audio_path", F.regexp_replace("audio_path", rf"^(?:file:)?/*{_plain(audio)}/?", ""))
    sessions = dialogs.swb_sessions(_split_lists(spark, lists), found, audio)
    words = dialogs.swb_words(read_lines(spark, transcripts, "*word.text"))
    utts, segments = dialogs.swb_dialogs(words, dialogs.swb_utterances(read_lines(spark, transcripts, "*trans.text")), min_gap)
    return Corpus(sessions, only(utts, sessions, "session"), only(segments, sessions, "session"))


def _plain(path: str) -> str:
    return "".join(c if c.isalnum() or c in "/_-" else "\\" + c for c in path.strip("/"))


def fisher(spark: SparkSession, root: str, ext: str = ".wav") -> Corpus:
    """Sessions by rule; utterances of those whose transcript is there."""
    u = dialogs.fisher_utterances(read_lines(spark, _under(root, "fe_03_p1_tran/data/trans"), "*.txt"))
    return Corpus(dialogs.fisher_sessions(spark, root.rstrip("/") + "/", ext), u.withColumn("session", F.regexp_extract("file", r"fe_03_(\w+)\.txt$", 1)))


def callhome(spark: SparkSession, audio: str, transcripts: str, clean: bool = True) -> Corpus:
    sessions = dialogs.callhome_files(list_files(spark, audio), list_files(spark, transcripts, "*.txt"))
    u = dialogs.callhome_utterances(read_lines(spark, transcripts, "*.txt"), clean)
    return Corpus(sessions, u.withColumn("session", X.stem(F.col("file"))))


def vacation(spark: SparkSession, root: str) -> Corpus:
    """Dialogues, audio that is there, and activity lists of the interviews."""
    docs = read_json(spark, _under(root, "dialogs"), schemas.VACATION_DIALOG, "*.json")
    sessions = dialogs.vacation_sessions(docs, root, list_files(spark, _under(root, "audio"), "*.wav"))
    segments = dialogs.vad_segments(read_json(spark, _under(root, "vad"), schemas.VAD_JSON, "*.json"))
    return Corpus(sessions, dialogs.vacation_utterances(docs), segments)


def librispeech(spark: SparkSession, roots: dict[str, str], split: str, config: str | None = None) -> Corpus:
    """``roots``: folder of each part by name; the lines of ``*.trans.txt`` with their audio files."""
    wanted = corpora.LIBRISPEECH_TRAIN[config] if config and split == "train" else (corpora.LIBRISPEECH_SPLITS[split],)
    parts = {n: corpora.librispeech(read_lines(spark, roots[n], "*.trans.txt")) for n in wanted}
    return Corpus(corpora.librispeech_split(parts, split, config))


def vctk(spark: SparkSession, root: str, mic: str = "mic2") -> Corpus:
    return Corpus(corpora.vctk(list_files(spark, root, "*.flac"), read_lines(spark, root, "*.txt"), mic))


def timit(spark: SparkSession, root: str) -> Corpus:
    """Items are the audio files; utterances their phonemes in samples."""
    items = list_files(spark, root, "*.WAV").select(F.regexp_replace("file", r"\.[^./]*$", "").alias("id"), "file")
    units = corpora.timit(read_lines(spark, root, "*.PHN"))
    return Corpus(items, units.withColumn("id", F.regexp_replace("file", r"\.[^./]*$", "")))


def audio_table(spark: SparkSession, root: str, glob: str = "*.wav") -> DataFrame:
    """(file, sample_rate, num_frames, num_channels, bits_per_sample, duration) of every audio file below ``root``."""
    return read_audio(spark, root, glob).select("file", audio_info(F.col("content")).alias("i")).select("file", "i.*")


BUILDERS: dict[str, Callable[..., Corpus]] = {"switchboard": switchboard, "fisher": fisher, "callhome": callhome, "vacation_interview": vacation, "librispeech_asr": librispeech, "vctk": vctk, "timit": timit}
