"""Collation: rows grouped into padded batches, as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from turnweave.functions import arrays as A
from turnweave.functions import text as X
from turnweave.operators.splits import positions
from turnweave.operators.windows import random_segment


def number_batches(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """``df`` with batch_id and item: ``size`` neighbours in ``order`` to a batch, numbered without one global task."""
    p = positions(df, order, "_pos")
    return p.withColumns({"batch_id": F.floor(F.col("_pos") / size), "item": F.col("_pos") % size}).drop("_pos")


def shuffle(df: DataFrame, key: Column, seed: int = 1234) -> DataFrame:
    """Rows in an order that depends on the seed and their key only."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key)


def pad_to_batch(df: DataFrame, column: str, value: Column, left: bool = False, longest: int | None = None) -> DataFrame:
    """Arrays of a batch padded to its longest one, with their own lengths; ``longest`` cuts them first."""
    d = df.withColumn(column, F.slice(column, 1, longest)) if longest else df
    d = d.withColumn(f"{column}_length", F.size(column))
    most = F.max(f"{column}_length").over(Window.partitionBy("batch_id"))
    return d.withColumn(column, (A.pad_left if left else A.pad_right)(F.col(column), most, value))


def collate(df: DataFrame, columns: list[str]) -> DataFrame:
    """(batch_id, columns): each column of a batch as an array in order of item."""
    s = F.struct("item", *columns)
    g = df.groupBy("batch_id").agg(F.array_sort(F.collect_list(s)).alias("_b"))
    return g.select("batch_id", *(F.col(f"_b.{c}").alias(c) for c in columns))


def text_batches(encoded: DataFrame, order: list[str], size: int, longest: int, pad: int = 0) -> DataFrame:
    """(batch_id, input_ids, speaker_ids, length): cut to ``longest``, padded with ``pad``."""
    d = number_batches(encoded, order, size)
    d = pad_to_batch(d, "input_ids", F.lit(pad), longest=longest)
    d = pad_to_batch(d, "speaker_ids", F.lit(pad), longest=longest)
    return collate(d.withColumnRenamed("input_ids_length", "length"), ["input_ids", "speaker_ids", "length"])


def dialog_batches(samples: DataFrame, order: list[str], size: int = 4) -> DataFrame:
    """(batch_id, the columns of the samples): waveforms, activity, histories, labels and names of ``size`` samples,
    each column an array in order; channels of a batch are padded with 0 to its longest one."""
    d = number_batches(samples, order, size)
    if "waveform" in samples.columns:
        longest = F.coalesce(F.array_max(F.transform("waveform", F.size)), F.lit(0))
        most = F.max("_n").over(Window.partitionBy("batch_id"))
        d = d.withColumn("_n", longest).withColumn("_m", most)
        zero = F.lit(0).cast(samples.schema["waveform"].dataType.elementType.elementType)
        d = d.withColumn("waveform", F.transform("waveform", lambda ch: A.pad_right(ch, F.col("_m"), zero))).drop("_n", "_m")
    return collate(d, list(samples.columns))


def with_sidecars(items: DataFrame, features: dict[str, DataFrame], ending: str, new: str, how: str = "left") -> DataFrame:
    """``items`` (file, …) with one column a feature from the file beside theirs: ``x.wav`` -> ``x_f0.npy``.

    ``features``: name -> (file, value), one row a file. Items without the file have null.
    """
    for name, side in features.items():
        key = X.swap_suffix(F.col("file"), ending, f"_{name}.{new}")
        items = items.withColumn("_k", key).join(side.select(F.col("file").alias("_k"), F.col("value").alias(name)), "_k", how).drop("_k")
    return items


def segments_of(items: DataFrame, key: str, seconds: float, rates: dict[str, float], seed: int = 1234) -> DataFrame:
    """``items`` with the same random segment of ``seconds`` cut from each array, whose elements come at ``rates`` a
    second; the first rate's array gives the length. The start is drawn from a hash of ``key``, 0 for shorter items."""
    name, rate = next(iter(rates.items()))
    start = random_segment(F.col(key), F.size(name) / rate, seconds, seed)
    cut = lambda c, r: F.slice(c, F.floor(F.col("_at") * r).cast("int") + 1, int(seconds * r))
    return items.withColumn("_at", start).withColumns({c: cut(c, r) for c, r in rates.items()}).drop("_at")


def speech_batches(items: DataFrame, order: list[str], size: int, features: tuple[str, ...] = ("waveform", "f0", "vad"), least: dict[str, int] | None = None, frames_of: dict[str, int] | None = None) -> DataFrame:
    """(batch_id, id, features, their lengths): arrays padded with 0 to the longest of the batch.

    ``least``: items with fewer elements of a feature are left out before they are numbered. ``frames_of``: features of
    one value for so many samples of the waveform are brought to ceil(n / hop) values first.
    """
    for f, n in (least or {}).items():
        items = items.where(F.size(f) >= n)
    for f, hop in (frames_of or {}).items():
        items = items.withColumn(f, A.pad_right(F.slice(f, 1, F.ceil(F.size("waveform") / hop).cast("int")), F.ceil(F.size("waveform") / hop).cast("int"), F.lit(0.0)))
    d = number_batches(items, order, size)
    for f in features:
        d = pad_to_batch(d, f, F.lit(0.0))
    return collate(d, ["id", *features, *(f"{f}_length" for f in features)])


def classification_items(responses: DataFrame, activity: DataFrame, history: DataFrame, means: DataFrame) -> DataFrame:
    """``responses`` (session, response, speaker, …) with own and other activity around the response, the condensed
    history at its start and the mean pitch of its speaker; joins by key, none by range."""
    j = responses.join(activity.select("response", "own", "other"), "response").join(history.select("response", F.col("h").alias("history")), "response")
    return j.join(means.select("session", "speaker", F.col("mean").alias("f0_mean")), ["session", "speaker"], "left")


def classification_batches(items: DataFrame, order: list[str], size: int, longest: int, samples: int, left: bool = True) -> DataFrame:
    """(batch_id, label, input_ids, waveform and, where the items have them, own, other, history, f0_mean): the last
    ``longest`` ids, padded with 0; audio filled with 0 on the left (or right) up to ``samples``."""
    d = number_batches(items, order, size).withColumn("label", X.label_index(F.col("label")))
    d = d.withColumn("input_ids", A.tail(F.col("input_ids"), longest))
    d = pad_to_batch(d, "input_ids", F.lit(0))
    d = d.withColumn("waveform", (A.pad_left if left else A.pad_right)(F.col("waveform"), samples, F.lit(0.0)))
    return collate(d, ["label", "input_ids", "waveform", *(c for c in ("own", "other", "history", "f0_mean") if c in items.columns)])


def prosody_batches(items: DataFrame, order: list[str], size: int, samples: int) -> DataFrame:
    """(batch_id, label, waveform, prosody): the channel of the responding speaker out of the two of ``waveform``, with
    0 on the right up to ``samples``, and the prosody of the response."""
    d = number_batches(items, order, size).withColumn("label", X.label_index(F.col("label")))
    own = F.coalesce(F.get("waveform", F.col("speaker")), F.array().cast(items.schema["waveform"].dataType.elementType))
    d = d.withColumn("waveform", A.pad_right(F.slice(own, 1, samples), samples, F.lit(0.0)))
    return collate(d, ["label", "waveform", "prosody"])


def iterate(batches: DataFrame) -> Iterator[Row]:
    """Batches in order, one partition at a time on the driver."""
    yield from batches.orderBy("batch_id").toLocalIterator(prefetchPartitions=True)
