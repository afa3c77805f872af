"""Feature columns scaled to zero mean and unit deviation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.runtime import HOT_SHARE, lookup


def z_norm(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Each column less its mean, by its sample deviation, within ``keys``; null where that is 0 or undefined.

    The statistics are taken by a partial aggregation and looked up, with salt for hot keys; null keys are a group.
    """
    k = df.withColumn("_k", F.struct(*keys))
    stats = k.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"), *(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))))
    scaled = {c: F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")) for c in columns}
    hot = stats.join(F.broadcast(stats.agg(F.sum("_n").alias("_all"))), F.col("_n") * HOT_SHARE > F.col("_all"))
    return lookup(k, stats.drop("_n"), "_k", hot=hot).withColumns(scaled).select(*df.columns)


def z_norm_nonzero(df: DataFrame, columns: list[str]) -> DataFrame:
    """As :func:`z_norm` over the values other than 0 of the whole table; zeros stay 0.

    The statistics are one row, taken by a partial aggregation and joined to every row.
    """
    stats = df.agg(*(f(F.when(F.col(c) != 0, F.col(c))).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))))
    j = df.crossJoin(F.broadcast(stats))
    scaled = {c: F.when(F.col(c) == 0, F.lit(0.0)).when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")) for c in columns}
    return j.withColumns(scaled).drop(*(f"_{n}_{c}" for c in columns for n in "ms"))


def normalize_features(df: DataFrame, keys: list[str], regular: list[str], special: list[str]) -> DataFrame:
    """Regular features by :func:`z_norm` within ``keys``, those that are 0 where undefined by :func:`z_norm_nonzero`."""
    return z_norm_nonzero(z_norm(df, keys, regular), special)


def nonzero_range(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """(keys, low, high): the least value other than 0 and the greatest value."""
    return df.groupBy(*keys).agg(F.min(F.when(F.col(column) != 0, F.col(column))).alias("low"), F.max(column).alias("high"))
