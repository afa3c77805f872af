"""Dialogues of turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnweave.functions.text import has_word


def keep_full(dialogs: DataFrame, dialog: str = "dialog") -> DataFrame:
    """Dialogues of which every turn has a word; one without turns stays, one with a null turn or null goes."""
    return dialogs.where(F.col(dialog).isNotNull() & F.forall(dialog, lambda t: F.coalesce((t != "") & has_word(t), F.lit(False))))


def to_arrays(turns: DataFrame, keys: list[str], turn: str = "turn", text: str = "text") -> DataFrame:
    """(keys, dialog): the turns of each dialogue in order."""
    return turns.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(turn, text))), lambda x: x[text]).alias("dialog"))


def to_turns(dialogs: DataFrame, keys: list[str], dialog: str = "dialog") -> DataFrame:
    """(keys, turn, text), turns numbered from 0."""
    return dialogs.select(*keys, F.posexplode(dialog).alias("turn", "text"))


def without_words(dialogs: DataFrame, dialog: str = "dialog", field: str = "words") -> DataFrame:
    """Dialogues of utterance structs without the struct's field ``words``; a null utterance stays null."""
    return dialogs.withColumn(dialog, F.transform(dialog, lambda u: u.dropFields(field)))


def interleave(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two channels of one call as one list, with their channel; order by start and channel to read it."""
    return a.withColumn("channel", F.lit(0)).unionByName(b.withColumn("channel", F.lit(1)))


def between(utts: DataFrame, start: Column, end: Column, s: str = "start", e: str = "end") -> DataFrame:
    """Utterances that start at or after ``start`` and end at or before ``end``."""
    return utts.where((F.col(s) >= start) & (F.col(e) <= end))


def short_utterances(utts: DataFrame, text: str = "text", most_words: int = 2, top: int = 20) -> DataFrame:
    """(text, n): the ``top`` most frequent utterances of at most ``most_words`` words that occur more than once."""
    n = F.size(F.split(F.trim(F.col(text)), r"\s+"))
    return utts.where((F.trim(F.col(text)) != "") & (n <= most_words)).groupBy(F.lower(F.trim(F.col(text))).alias("text")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "text").limit(top)
