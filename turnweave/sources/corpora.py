"""Text and read-speech corpora brought to (dataset_name, split, …) tables, and the dispatch over all of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.functions import text as X
from turnweave.operators.splits import at_positions, percent_slices, speaker_splits
from turnweave.runtime import union_all
from turnweave.sources.sinks import cached

#: Names of the text corpora.
TEXT_CORPORA = ("curiosity_dialogs", "daily_dialog", "metawoz", "multiwoz_v22", "taskmaster1", "taskmaster2", "taskmaster3")
#: Configurations of taskmaster2 that are joined.
TASKMASTER2_PARTS = ("flights", "food-ordering", "restaurant-search")
#: LibriSpeech splits by configuration.
LIBRISPEECH_SPLITS = {"train": "train.360", "validation": "validation", "test": "test"}
LIBRISPEECH_TRAIN = {"clean": ("train.100", "train.360"), "other": ("train.500",)}
#: Slices of LJ Speech and the VCTK speaker without transcripts.
LJ_SLICES = {"train": (0.0, 0.85), "validation": (0.85, 0.95), "test": (0.95, 1.0)}
VCTK_LEFT_OUT = ("p280",)


def flatten(df: DataFrame, column: str) -> DataFrame:
    """A struct column as columns named ``column.field``."""
    fields = df.schema[column].dataType.names
    return df.select(*(c for c in df.columns if c != column), *(F.col(f"{column}.{f}").alias(f"{column}.{f}") for f in fields))


def merged(texts: Column, speakers: Column) -> Column:
    """The turns of one row with those of one speaker in a row joined by a blank; inside the row, without a shuffle.

    The positions at which the speaker changes are found first; each run is then one slice. A null text adds nothing.
    """
    who = F.transform(speakers, lambda s: s.cast("string"))
    starts = F.filter(F.transform(who, lambda s, i: F.when((i == 0) | ~s.eqNullSafe(F.get(who, i - 1)), i)), lambda i: i.isNotNull())
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(texts)))
    run = lambda a, b: F.array_join(F.slice(texts, a + 1, b - a), " ")
    return F.when(F.size(texts) > 0, F.zip_with(starts, ends, run)).otherwise(F.when(texts.isNotNull(), F.array().cast("array<string>")))


def text_corpus(df: DataFrame, name: str, dialog: str, speaker: str | None = None) -> DataFrame:
    """(dialog, dataset_name, split if there is one) of a table whose ``dialog`` holds the turns; with ``speaker``,
    an array beside it, runs of one speaker are merged. All other columns are dropped."""
    d = merged(F.col(dialog), F.col(speaker)) if speaker else F.col(dialog)
    return df.select(d.alias("dialog"), F.lit(name).alias("dataset_name"), *(["split"] if "split" in df.columns else []))


LOADERS: dict[str, Callable[..., DataFrame]] = {
    "curiosity_dialogs": lambda df: text_corpus(df, "curiosity_dialogs", "messages.message", "messages.sender"),
    "daily_dialog": lambda df: text_corpus(df, "daily_dialog", "dialog"),
    "multiwoz_v22": lambda df: text_corpus(df, "multiwoz_v22", "turns.utterance", "turns.speaker"),
    "metawoz": lambda df: text_corpus(df, "metawoz", "turns"),
    "taskmaster1": lambda df: text_corpus(df, "taskmaster1", "utterances.text", "utterances.speaker"),
    "taskmaster2": lambda df: text_corpus(df, "taskmaster2", "utterances.text", "utterances.speaker"),
    "taskmaster3": lambda df: text_corpus(df, "taskmaster3", "utterances.text", "utterances.speaker"),
}


def stored_split(df: DataFrame, order: list[str], index: DataFrame, split: str) -> DataFrame:
    """Rows of one split of a corpus that is split by a stored list: ``index`` has (split, pos)."""
    return at_positions(df, order, index.where(F.col("split") == split)).drop("pos").withColumn("split", F.lit(split))


def load_texts(tables: dict[str, DataFrame | dict[str, DataFrame]], names: list[str]) -> DataFrame:
    """Union of the named text corpora in order of name; an unknown name raises. ``tables``: raw table of each name;
    taskmaster2, which has several configurations, may be given by configuration: those of TASKMASTER2_PARTS are
    joined, a missing one raises."""
    unknown = sorted(set(names) - set(LOADERS))
    if unknown:
        raise ValueError(f"unknown corpora: {unknown}")
    raw = {n: union_all([t[p] for p in TASKMASTER2_PARTS]) if isinstance(t, dict) else t for n, t in tables.items()}
    return union_all([LOADERS[n](raw[n]) for n in sorted(names)])


def few(tables: dict[str, DataFrame], order: dict[str, list[str]], n: int = 50) -> dict[str, DataFrame]:
    """The first ``n`` rows of each corpus, for a look at a flow; a development slice."""
    return {k: t.orderBy(*order[k]).limit(n) for k, t in tables.items()}


# --- read speech ---------------------------------------------------------------------------------------------------


def librispeech(lines: DataFrame) -> DataFrame:
    """(id, file, text, speaker_id, chapter_id) of ``speaker-chapter-utterance TRANSCRIPT`` lines."""
    head, rest = X.split_once(X.strip(F.col("line")))
    p = F.split(head, "-")
    return lines.where(X.strip(F.col("line")) != "").select(
        head.alias("id"), F.concat(X.dirname(F.col("file")), F.lit("/"), head, F.lit(".flac")).alias("file"), rest.alias("text"), *(F.get(p, F.lit(i)).try_cast("long").alias(n) for i, n in ((0, "speaker_id"), (1, "chapter_id")))
    )


def vctk(audio: DataFrame, lines: DataFrame, mic: str = "mic2") -> DataFrame:
    """(id, file, text, speaker_id, utterance_id, split): first lines of ``pNNN_UUU.txt`` with ``pNNN_UUU_mic.flac``."""
    name = X.stem(F.col("file"))
    a = audio.where(F.col("file").endswith(f"_{mic}.flac")).select(X.join_first(name, "_", 2).alias("id"), "file")
    t = lines.where("line_no = 0").select(X.join_first(name, "_", 2).alias("id"), X.strip(F.col("line")).alias("text"))
    both = a.join(t, "id").select("id", "file", "text", X.field(F.col("id"), 0, sep="_").alias("speaker_id"), X.field(F.col("id"), 1, sep="_").alias("utterance_id"))
    return speaker_splits(both, "speaker_id", leave_out=VCTK_LEFT_OUT)


def lj_speech(df: DataFrame, order: list[str]) -> DataFrame:
    return percent_slices(df, order, LJ_SLICES)


def timit(lines: DataFrame, phonemes: bool = True) -> DataFrame:
    """(file, idx, start, end, phoneme | text): times are sample numbers."""
    p = F.split(X.strip(F.col("line")), " ", 3)
    return lines.where(F.size(p) == 3).select("file", F.col("line_no").alias("idx"), F.get(p, F.lit(0)).try_cast("int").alias("start"), F.get(p, F.lit(1)).try_cast("int").alias("end"), F.get(p, F.lit(2)).alias("phoneme" if phonemes else "text"))


def first_files(files: DataFrame, n: int = 4) -> DataFrame:
    return files.orderBy("file").limit(n)


SPEECH_COLUMNS = ("id", "file", "text")


def librispeech_split(parts: dict[str, DataFrame], split: str, config: str | None = None) -> DataFrame:
    """Rows of one split out of LibriSpeech's parts by name: with ``config`` the training parts of that configuration,
    else the part that stands for the split. ``dataset_name`` and ``split`` are added, chapter and speaker dropped."""
    names = LIBRISPEECH_TRAIN[config] if config and split == "train" else (LIBRISPEECH_SPLITS[split],)
    u = union_all([parts[n] for n in names]).drop("speaker_id", "chapter_id")
    return u.withColumns({"dataset_name": F.lit("librispeech_asr"), "split": F.lit(split)})


def speech_datasets(spark: SparkSession, path: str, tables: dict[str, DataFrame], names: list[str], split: str = "all", load_from_cache: bool = True, overwrite: bool = False) -> DataFrame | list[DataFrame]:
    """The cached union of the named corpora: one split, or for ``all`` the list of train, validation and test."""
    u = cached(spark, path, lambda: load_speech(tables, names), load_from_cache, overwrite)
    of = lambda s: u.where(F.col("split") == ("validation" if s == "val" else s))
    return [of(s) for s in ("train", "validation", "test")] if split == "all" else of(split)


def load_speech(tables: dict[str, DataFrame], names: list[str]) -> DataFrame:
    """(dataset_name, split, id, file, text) of the named corpora in order of name; an unknown name raises."""
    unknown = sorted(set(names) - set(tables))
    if unknown:
        raise ValueError(f"unknown corpora: {unknown}")
    return union_all([tables[n].select(F.lit(n).alias("dataset_name"), *(["split"] if "split" in tables[n].columns else [F.lit(None).cast("string").alias("split")]), *SPEECH_COLUMNS) for n in sorted(names)])


def load_dialogs(tables: dict[str, DataFrame], names: list[str], split: str | None = None) -> DataFrame:
    """Union of prepared dialogue tables with equal columns; vacation interviews hold the same rows in every split."""
    unknown = sorted(set(names) - set(tables))
    if unknown:
        raise ValueError(f"unknown corpora: {unknown}")
    u = union_all([tables[n].withColumn("dataset_name", F.lit(n)) for n in names])
    return u.where(F.col("split") == ("validation" if split == "val" else split)) if split else u
