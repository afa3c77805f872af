"""Helpers against skew and for written tables."""

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from turnweave import runtime as R


def test_salted_join(spark):
    """One key holds most rows of both sides; every pair comes once, and the hot key is spread over the grid."""
    left = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(90)] + [(None, -1)], "k long, a long")
    right = spark.createDataFrame([(0 if i % 2 else i, i) for i in range(60)] + [(None, -2)], "k long, b long")
    got = R.salted_join(left, right, "k", F.col("a"), F.col("b")).select("k", "a", "b")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(right, "k").select("k", "a", "b").collect()))
    assert R.salted_join(left.limit(0), right, "k", F.col("a"), F.col("b")).count() == 0


def test_cut_and_release(spark):
    df = R.cut(spark.range(5).toDF("x"))
    path = df._turnweave_path
    assert df.count() == 5 and path in R._written
    R.release(df, spark.range(1), df)
    assert path not in R._written and not os.path.exists(path.removeprefix("file:"))


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn"])
def test_checkpoint_folder_is_required_on_a_cluster(master):
    none = SimpleNamespace(isEmpty=lambda: True)
    sc = SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda k: None), _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    with pytest.raises(ValueError):
        R.checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d: None)))
