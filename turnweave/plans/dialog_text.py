"""Text dialogue: corpora to speaker-alternating, tokenized, cached dialogues."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.operators.dialog import keep_full
from turnweave.sources.corpora import load_texts
from turnweave.sources.sinks import cached

Tokenizer = Callable[[str], list[int]]


def hash_tokens(turn: Column, buckets: int = 50_000) -> Column:
    """A trivial tokenizer inside the JVM: one id a word, hashed into ``buckets``."""
    return F.transform(F.filter(F.split(F.lower(turn), r"\s+"), lambda w: w != ""), lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))


def encode(dialogs: DataFrame, tokenizer: Tokenizer | None = None, dialog: str = "dialog") -> DataFrame:
    """``dialogs`` with input_ids and speaker_ids: the tokens of all turns and, for each, whose turn it is (0, 1, 0 …).

    Without a tokenizer the words are hashed; a Python tokenizer runs on Arrow batches.
    """
    if tokenizer is None:
        per_turn = F.transform(dialog, lambda t: hash_tokens(t))
    else:

        @F.pandas_udf("array<array<int>>")
        def run(s: pd.Series) -> pd.Series:
            return s.map(lambda d: None if d is None else [tokenizer(t) for t in d])

        per_turn = run(dialog)
    d = dialogs.withColumn("_t", per_turn)
    who = F.flatten(F.transform("_t", lambda t, i: F.array_repeat(i % 2, F.size(t))))
    return d.withColumns({"input_ids": F.flatten("_t"), "speaker_ids": who}).drop("_t")


def prepare(spark: SparkSession, tables: dict[str, DataFrame], names: list[str], path: str, tokenizer: Tokenizer | None = None, overwrite: bool = False, load_from_cache: bool = True) -> DataFrame:
    """Union, filter, encode, cache: the table of all splits, one folder a split."""
    return cached(spark, path, lambda: encode(keep_full(load_texts(tables, names)), tokenizer), load_from_cache, overwrite)
