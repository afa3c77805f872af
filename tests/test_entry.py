"""The driver's contract."""

import os

import pytest

import __spark_entry__ as e


def test_names():
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and "dialog_arrays" in q


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_entry(spark):
    assert e.entry(spark).count() > 0
