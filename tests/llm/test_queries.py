"""Every query runs on the smallest tables; those with SQL give its rows."""

import os

import duckdb
import pytest

from turnweave.llm import queries as Q

DATA = "/root/testdata/sf0.001"
FOUND = {"p1_found": ["rec_id", "group_id"], "p2_found": ["clip_id", "kind"], "p4_found": ["session", "reel", "speaker", "start_ms", "end_ms"], "p5_found": ["dialog_id_a", "dialog_id_b"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id"]}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, name):
    df = Q.queries()[name](spark, DATA)
    if name in FOUND:
        assert df.columns == FOUND[name]
    got = [tuple(r) for r in df.collect()]
    if sql := Q.oracle_sql().get(name):
        c = duckdb.connect()
        for f in os.listdir(DATA):
            c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
        assert sorted(got) == sorted(c.sql(f"select {', '.join(df.columns)} from ({sql})").fetchall())
