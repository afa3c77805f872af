"""Equi-joins of the corpora: words, paths, sidecars, lookups; none by range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def utterances_with_words(utts: DataFrame, words: DataFrame, keys: list[str], order: str = "word_idx", word: str = "word", start: str = "start", end: str = "end") -> DataFrame:
    """Utterances with their words in order, the first word's start and the last word's end.

    Utterances without words are dropped; times of the utterance rows themselves, if any, are replaced.
    """
    w = words.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("i"), F.col(word).alias("word"), F.col(start).alias("start"), F.col(end).alias("end")))).alias("words"),
        F.min_by(start, order).alias("start"),
        F.max_by(end, order).alias("end"),
    )
    return utts.drop("words", "start", "end").join(w, keys)


def lookup_path(sessions: DataFrame, paths: DataFrame, key: str = "session", strict: bool = False) -> DataFrame:
    """Sessions with their audio path; with ``strict``, evaluating a row without one raises."""
    j = sessions.join(paths, key, "left")
    if strict:
        miss = F.raise_error(F.concat(F.lit("no path for "), F.col(key).cast("string")))
        j = j.withColumn("audio_path", F.when(F.col("audio_path").isNull(), miss.cast("string")).otherwise(F.col("audio_path")))
    return j


def only(df: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    return df.join(listed.select(key).distinct(), key, "left_semi")


def without(df: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't listed; rows with a null key stay."""
    return df.join(listed.select(key).distinct(), key, "left_anti")


def pair_by(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, how: str = "left") -> DataFrame:
    """Files paired by a key derived from their names."""
    return left.withColumn("_k", left_key).join(right.withColumn("_k", right_key), "_k", how).drop("_k")


def long_means(means: DataFrame, session: str = "session", values: str = "means") -> DataFrame:
    """(session, speaker, mean) of an array with one mean for each speaker."""
    return means.select(session, F.posexplode(values).alias("speaker", "mean"))


def tokens_of_words(words: DataFrame, keys: list[str], tokens: Column, keep: int | None = None) -> DataFrame:
    """One row for each token with its word's columns; ``keep`` keeps the last so many tokens of each ``keys``."""
    t = words.withColumn("_t", tokens)
    if keep is not None:
        by = t.groupBy(*keys).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "_t", "start", "end"))), lambda w: F.transform(w["_t"], lambda x: F.struct(x.alias("token"), w["start"].alias("start"), w["end"].alias("end"))))).alias("a"))
        return by.select(*keys, F.inline(F.slice("a", F.greatest(F.size("a") - keep, F.lit(0)) + 1, keep)))
    return t.select(*(c for c in words.columns), F.explode("_t").alias("token"))
