"""Line-oriented, JSON and audio files as DataFrames."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnweave.functions import features
from turnweave.runtime import ship


def read_lines(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """(file, line_no, line): transcript files are small, so each is one record that is split inside the scan's task."""
    t = _whole(spark, path, glob)
    return t.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("line_no", "line"))


def _whole(spark: SparkSession, path: str | list[str], glob: str | None) -> DataFrame:
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)


def list_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(file, length) without reading contents."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (r.option("pathGlobFilter", glob) if glob else r).load(path).select(F.col("path").alias("file"), "length")


def read_json(spark: SparkSession, path: str | list[str], schema: T.DataType, glob: str | None = None) -> DataFrame:
    """(file, value): one JSON document a file, read with a declared schema; a broken document gives null."""
    t = _whole(spark, path, glob)
    return t.select(F.col("_metadata.file_path").alias("file"), F.from_json("value", schema).alias("value"))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """(pos, id): a list file, one stripped id a line, blank lines left out."""
    return read_lines(spark, path).select(F.col("line_no").alias("pos"), F.regexp_replace("line", r"(?U)^\s+|\s+$", "").alias("id")).where("id <> ''")


def read_audio(spark: SparkSession, path: str, glob: str = "*.wav") -> DataFrame:
    """(file, content)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select(F.col("path").alias("file"), "content")


def read_arrays(spark: SparkSession, path: str, glob: str = "*.npy") -> DataFrame:
    """(file, value): one numeric array a file in numpy's format, flattened; what is no such file gives null."""

    ship(spark)

    @F.pandas_udf("array<double>")
    def load(c: pd.Series) -> pd.Series:
        def one(b: bytes) -> list[float] | None:
            try:
                return np.load(io.BytesIO(b), allow_pickle=False).astype(float).ravel().tolist()
            except (ValueError, EOFError, OSError, TypeError):
                return None

        return c.map(one)

    return read_audio(spark, path, glob).select("file", load("content").alias("value"))


_INFO = T.StructType([T.StructField("sample_rate", T.IntegerType()), T.StructField("num_frames", T.LongType()), T.StructField("num_channels", T.IntegerType()), T.StructField("bits_per_sample", T.IntegerType()), T.StructField("duration", T.DoubleType())])


def audio_info(content: Column) -> Column:
    """Header of a PCM WAV file as a struct; null for anything else."""

    @F.pandas_udf(_INFO)
    def info(s: pd.Series) -> pd.DataFrame:
        rows = []
        for b in s:
            try:
                with wave.open(io.BytesIO(b)) as w:
                    rows.append((w.getframerate(), w.getnframes(), w.getnchannels(), 8 * w.getsampwidth(), w.getnframes() / w.getframerate()))
            except (wave.Error, EOFError, TypeError):
                rows.append((None,) * 5)
        return pd.DataFrame(rows, columns=_INFO.names)

    return info(content)


def decode_wav(data: bytes, start: float = 0.0, end: float | None = None) -> tuple[np.ndarray, int]:
    """(channels, samples) of [start, end) seconds in [-1, 1], and the rate; only that range is decoded."""
    with wave.open(io.BytesIO(data)) as w:
        rate, width, chans = w.getframerate(), w.getsampwidth(), w.getnchannels()
        first = min(int(start * rate), w.getnframes())
        last = w.getnframes() if end is None else min(int(end * rate), w.getnframes())
        w.setpos(first)
        raw = w.readframes(max(0, last - first))
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(float) / float(1 << (8 * width - 1))
    return x.reshape(-1, chans).T, rate


def load_waveform(content: Column, sample_rate: int | None = None, start: Column | None = None, end: Column | None = None, normalize: bool = False, mono: bool = False, above: float = 0.05) -> Column:
    """array<array<float>> of a WAV file: a range of it, peak-normalized, mixed down and resampled, in that order.

    A peak of at most ``above`` is left as it is; after mixing down it is normalized again.
    """

    ship(SparkSession.active())

    def scaled(x: np.ndarray) -> np.ndarray:
        p = np.abs(x).max(axis=1, keepdims=True, initial=0.0)
        return np.where(p > above, x / np.where(p > 0, p, 1), x)

    @F.pandas_udf("array<array<float>>")
    def load(c: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for data, s, e in zip(c, a, b):
            if data is None:
                out.append(None)
                continue
            x, rate = decode_wav(data, 0.0 if s is None or s != s else s, None if e is None or e != e else e)
            x = scaled(x) if normalize else x
            if mono and len(x) > 1:
                x = x.mean(axis=0, keepdims=True)
                x = scaled(x) if normalize else x
            if sample_rate and rate != sample_rate:
                x = np.stack([features.resample(y, rate, sample_rate) for y in x])
            out.append([y.astype(np.float32).tolist() for y in x])
        return pd.Series(out)

    null = F.lit(None).cast("double")
    return load(content, start.cast("double") if start is not None else null, end.cast("double") if end is not None else null)
