"""Cached tables, JSON and text output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.operators.splits import folds


def exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` holds anything but hidden files."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and any(not s.getPath().getName().startswith((".", "_")) for s in fs.listStatus(p))


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame], load_from_cache: bool = True, overwrite: bool = False, by: tuple[str, ...] = ("split",)) -> DataFrame:
    """The Parquet table at ``path``; made and written first if asked to, if the cache is not to be used, or if there
    is none. Partitioned by ``by`` as far as the table has such columns, so that one split reads one folder."""
    if overwrite or not load_from_cache or not exists(spark, path):
        df = make()
        df.write.mode("overwrite").partitionBy(*(c for c in by if c in df.columns)).parquet(path)
    return spark.read.parquet(path)


def write_json(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """One JSON document a line, UTF-8, non-ASCII characters as they are, null fields kept."""
    df.select(F.to_json(F.struct(*(columns or df.columns)), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_lines(df: DataFrame, column: str, path: str, order: list[str] | None = None) -> None:
    """One value a line; with ``order``, the files read in name order give that order."""
    (df.orderBy(*order) if order else df).select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def vad_json(vad: Column) -> Column:
    """``vad[channel][segment] = [start, end]`` as JSON, times rounded to two decimals."""
    return F.to_json(F.transform(vad, lambda ch: F.transform(ch, lambda seg: F.transform(seg, lambda t: F.bround(t, 2)))))


def write_vad(lists: DataFrame, path: str, session: str = "session", vad: str = "vad") -> None:
    """One folder a session, holding its activity as one JSON document."""
    lists.select(F.col(session).alias("session"), vad_json(F.col(vad)).alias("value")).write.mode("overwrite").partitionBy("session").text(path)


def write_folds(sessions: DataFrame, key: str, path: str, k: int = 11) -> None:
    """Contiguous folds of the ordered sessions, one folder a fold."""
    folds(sessions.select(key).distinct(), [key], k).select(F.col(key).cast("string").alias("value"), "fold").write.mode("overwrite").partitionBy("fold").text(path)
