"""Problem 1 against union-find."""

import random

import pytest
from pyspark.sql import functions as F

from turnweave.llm import splits as S

REC = "rec_id long, dataset_name string, session string, audio_path string, u string, g string"
LINK = "dataset_name string, session string, linked_dataset_name string, linked_session string, relation string"
TARGET = "split string, share double"

KEYS = [
    ("switchboard", "sw0000012", None, "sw:12"), ("SWBD", "12", None, "sw:12"), (None, "SW_00012-A", None, "sw:12"), ("swb", " sw-0000012\n", None, "sw:12"), ("x", "sw００００012", None, "sw:12"), (None, "12", None, None),
    ("fsh", "0", None, "fe:0"), ("fisher_eng", "session fe_0000007.wav", None, "fe:7"), ("callhome-en", "data/trans/ch_0000009.sph", None, "ch:9"), (" vacation interview", "Vi 0000003", None, "vi:3"), ("fisher", "fe_0000001B", None, "fe:1"),
    (None, None, "fisher/audio/00000/fe_0000020_0.wav", "fe:20"), (None, "unknown", "reels/fe12345678.wav", None), ("fisher", "", "", None), (None, None, "switchboard/audio/00000/sw0000001_2.sph", "sw:1"), ("switchboard", None, None, None),
]


def test_keys(spark):
    df = spark.createDataFrame([(i, *k[:3]) for i, k in enumerate(KEYS)], "i int, d string, s string, p string")
    got = [r[0] for r in df.orderBy("i").select(S.session_key(F.col("d"), F.col("s"), F.col("p"))).collect()]
    assert got == [k[3] for k in KEYS]


def union_find(pairs):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[root(a)] = root(b)
    return root, up


@pytest.mark.parametrize("kind", ["path", "star", "random", "clique"])
def test_components(spark, kind):
    rnd = random.Random(kind)
    n = 60
    pairs = {"path": [(i, i + 1) for i in range(n)], "star": [(0, i) for i in range(1, n)], "random": [(rnd.randint(0, n), rnd.randint(0, n)) for _ in range(45)], "clique": [(i, j) for i in range(12) for j in range(12)]}[kind]
    df = spark.createDataFrame([(f"v{a}", f"v{b}") for a, b in pairs] + [(None, "v1"), ("v1", None), ("v2", "v2")], "u string, v string")
    label = {r["vertex"]: r["label"] for r in S.components(df).collect()}
    root, _ = union_find([(f"v{a}", f"v{b}") for a, b in pairs])
    names = sorted({f"v{x}" for p in pairs for x in p})
    of = lambda v: label.get(v, v)
    assert all((of(a) == of(b)) == (root(a) == root(b)) for a in names for b in names)
    assert all(of(v) == v for v in label.values())


def test_no_edges(spark):
    assert S.components(spark.createDataFrame([], "u string, v string")).count() == 0


def groups(spark, rec, links):
    g = S.record_groups(spark.createDataFrame(rec, REC), spark.createDataFrame(links, LINK)).collect()
    return {r["rec_id"]: (r["group_id"], r["rows"], r["many"]) for r in g}


def test_records(spark):
    rec = [
        (5, "switchboard", "sw1", None, "", ""), (3, "swb", "1", None, "", ""), (3, "swb", "1", None, "", ""), (9, "fisher", "fe_0000001", None, "", ""), (2, None, None, None, "", ""), (7, None, None, None, "", ""), (7, None, None, None, "", ""),
        (11, "callhome", "ch_4", None, "", ""), (11, "callhome", "ch_5", None, "", ""), (12, "callhome", "5", None, "", ""), (None, "switchboard", "sw1", None, "", ""), (20, "vacation", "vi_8", None, "", ""),
    ]
    links = [("swb", "sw_1", "fisher", "77", "same_call"), ("fisher", "fe_77", "fsh", "1", " Copy_Of"), ("swb", "sw1", "vacation", "8", "same_topic"), (None, "8", "swb", "1", "same_call"), ("vacation", "8", None, None, "same_call"), (None, None, None, None, None)]
    assert groups(spark, rec, links) == {5: (3, 1, True), 3: (3, 2, True), 9: (3, 1, True), 2: (2, 1, False), 7: (7, 2, False), 11: (11, 2, True), 12: (11, 1, True), 20: (20, 1, False)}
    assert groups(spark, [], []) == {} and groups(spark, rec[:1], []) == {5: (5, 1, False)}


def test_shares(spark):
    rnd = random.Random(2)
    g = [(i, rnd.choice([1, 1, 1, 2, 3])) for i in range(3000)] + [(9000, 900), (9001, 300)]
    df = spark.createDataFrame(g, "group_id long, weight long")
    t = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], TARGET)
    got = {r["group_id"]: r["split"] for r in S.assign_splits(df, t).collect()}
    assert set(got) == {i for i, _ in g}
    whole = sum(w for _, w in g)
    for name, share in (("train", 0.8), ("validation", 0.1), ("test", 0.1)):
        assert abs(sum(w for i, w in g if got[i] == name) / whole - share) < 0.002
    assert got == {r["group_id"]: r["split"] for r in S.assign_splits(df.repartition(9), t).collect()}
    odd = spark.createDataFrame([("a", None), (None, 0.5), ("b", 0.0), ("c", 2.0)], TARGET)
    assert {r["split"] for r in S.assign_splits(df, odd).collect()} == {"c"}
    assert {r["split"] for r in S.assign_splits(df, spark.createDataFrame([], TARGET)).collect()} == {None}
    assert S.assign_splits(df.limit(0), t).count() == 0


def test_split_records(spark):
    rec = [(i, "swb", str(i // 3), None, "", "") for i in range(300)]
    t = spark.createDataFrame([("train", 0.5), ("test", 0.5)], TARGET)
    got = S.split_records(spark.createDataFrame(rec, REC), spark.createDataFrame([], LINK), t).collect()
    of = {}
    for r in got:
        of.setdefault(r["group_id"], set()).add(r["split"])
    assert len(got) == 300 and len(of) == 100 and all(len(v) == 1 for v in of.values())
    assert abs(sum(r["split"] == "train" for r in got) - 150) <= 3
