"""Splits by position, rank, fold or stored index. Positions are assigned without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnweave.runtime import carry_over_buckets, cut


def positions(df: DataFrame, order: list[str], out: str = "pos") -> DataFrame:
    """``df`` with its position from 0 in ``order``, which should tell rows apart.

    Rows are range-partitioned, numbered in their partition, and the sizes of earlier partitions are added. The
    partition of each row is written down first: read twice, it must be the same both times.
    """
    p = cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    before = carry_over_buckets(p.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).withColumn("_all", F.lit(0)), ["_all"], "_p", {"_before": (F.col("_n"), "before")}).drop("_all")
    w = Window.partitionBy("_p").orderBy(*order)
    return p.join(F.broadcast(before), "_p").withColumn(out, F.col("_before") + F.row_number().over(w) - 1).drop("_p", "_before")


def percent_slices(df: DataFrame, order: list[str], bounds: dict[str, tuple[float, float]], out: str = "split") -> DataFrame:
    """Slices [from, to) of the ordered rows, bounds as shares rounded half up to whole rows."""
    p = positions(df, order, "_pos").crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("_n"))))
    split = F.lit(None).cast("string")
    for name, (a, b) in bounds.items():
        split = F.when((F.col("_pos") >= F.round(F.col("_n") * a)) & (F.col("_pos") < F.round(F.col("_n") * b)), F.lit(name)).otherwise(split)
    return p.withColumn(out, split).drop("_pos", "_n")


def speaker_splits(df: DataFrame, speaker: str, train: float = 0.85, val: float = 0.1, leave_out: tuple[str, ...] = (), out: str = "split") -> DataFrame:
    """Speakers in order: the first int(train n) to train, the next int(val n) + 1 to validation, the rest to test.

    All rows of a speaker share the split; speakers of ``leave_out`` and null ones are dropped.
    """
    kept = df.where(F.col(speaker).isNotNull() & ~F.col(speaker).isin(*leave_out)) if leave_out else df.where(F.col(speaker).isNotNull())
    names = positions(kept.select(speaker).distinct(), [speaker], "_pos")
    n = names.agg(F.count(F.lit(1)).alias("_n"))
    a = F.floor(F.col("_n") * train)
    b = a + F.floor(F.col("_n") * val) + 1
    split = F.when(F.col("_pos") < a, "train").when(F.col("_pos") < b, "validation").otherwise("test")
    return kept.join(names.crossJoin(F.broadcast(n)).select(speaker, split.alias(out)), speaker)


def folds(df: DataFrame, order: list[str], k: int = 11, out: str = "fold") -> DataFrame:
    """Contiguous folds from 0: sizes n // k, the first n % k one larger."""
    p = positions(df, order, "_pos").crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("_n"))))
    size, more = F.floor(F.col("_n") / k), F.col("_n") % k
    edge = more * (size + 1)
    fold = F.when(F.col("_pos") < edge, F.floor(F.col("_pos") / (size + 1))).otherwise(more + F.floor((F.col("_pos") - edge) / F.greatest(size, F.lit(1))))
    return p.withColumn(out, fold.cast("int")).drop("_pos", "_n")


def shuffled_splits(df: DataFrame, key: str, train: float = 0.9, halves: bool = False, seed: int = 1234, out: str = "split") -> DataFrame:
    """A split by hashed order: int(train n) rows to train, the rest to validation, or half of it (rounded down) to
    validation and the remainder to test. ``key`` tells rows apart; the same seed gives the same split."""
    h = df.withColumn("_h", F.xxhash64(F.lit(seed), F.col(key)))
    p = positions(h, ["_h", key], "_pos").crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("_n"))))
    a = F.floor(F.col("_n") * train)
    b = a + F.floor((F.col("_n") - a) / 2) if halves else F.col("_n")
    return p.withColumn(out, F.when(F.col("_pos") < a, "train").when(F.col("_pos") < b, "validation").otherwise("test")).drop("_h", "_pos", "_n")


def at_positions(df: DataFrame, order: list[str], index: DataFrame, pos: str = "pos") -> DataFrame:
    """Rows whose position is listed in ``index``, with ``pos``; a position listed twice gives its row twice."""
    return positions(df, order, pos).join(index.select(pos), pos)
