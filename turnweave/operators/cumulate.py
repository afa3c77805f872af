"""Running totals and row numbers without one task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnweave.runtime import carry_over_buckets, null_safe_join

BUCKET_BITS = 12


def running_total(df: DataFrame, by: list[str], order: str, weight: str, out: str = "before", ties: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``out``: the sum of ``weight`` over the rows of the same ``by`` that come earlier in ``order``.

    ``order`` is a column of 64-bit hashes, read as unsigned; equal hashes are ordered by ``ties``. Each group is cut
    into 2**BUCKET_BITS buckets of the hash; only rows of one bucket are sorted together, and the totals of earlier
    buckets come from a table of one row for each bucket. ``by`` and ``weight`` must not be null.
    """
    b = df.withColumn("_b", F.shiftrightunsigned(F.col(order), 64 - BUCKET_BITS))
    carried = carry_over_buckets(b.groupBy(*by, "_b").agg(F.sum(weight).alias("_w")), by or ["_all"], "_b", {"_c": (F.col("_w"), "before")}) if by else None
    if carried is None:
        one = b.groupBy("_b").agg(F.sum(weight).alias("_w")).withColumn("_all", F.lit(0))
        carried = carry_over_buckets(one, ["_all"], "_b", {"_c": (F.col("_w"), "before")}).drop("_all")
    unsigned = F.shiftrightunsigned(F.col(order), 1)
    w = Window.partitionBy(*by, "_b").orderBy(unsigned, F.col(order), *ties).rowsBetween(Window.unboundedPreceding, 0)
    return b.join(carried, [*by, "_b"]).withColumn(out, F.col("_c") + F.sum(weight).over(w) - F.col(weight)).drop("_b", "_c")


def numbered(df: DataFrame, keys: list[str], order: list[str], bucket: Column, out: str = "pos") -> DataFrame:
    """``df`` with ``out``: its position from 0 in ``order`` within ``keys``, which may be null.

    ``bucket`` must not decrease along ``order``; rows of one bucket are sorted together, and the sizes of earlier
    buckets come from a table of one row a bucket.
    """
    b = df.withColumn("_b", bucket)
    before = carry_over_buckets(b.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n")), keys, "_b", {"_c": (F.col("_n"), "before")})
    w = Window.partitionBy(*keys, "_b").orderBy(*order)
    return null_safe_join(b, before, [*keys, "_b"]).withColumn(out, (F.col("_c") + F.row_number().over(w) - 1).cast("int")).drop("_b", "_c")
