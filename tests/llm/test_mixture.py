"""Problem 7: budgets by hand and shares reached."""

import pytest
from pyspark.sql import functions as F

from turnweave.llm import mixture as M

DOC = "doc_id long, text string, lang string, source string, epochs int, n_tokens string"
TARGET = "source string, target_share double, max_repeats int"


def test_fill():
    assert M.fill(10, {"a": (1, 100), "b": (1, 100)}) == {"a": 5, "b": 5}
    assert M.fill(10, {"a": (1, 2), "b": (1, 100), "c": (2, 100)}) == pytest.approx({"a": 2, "b": 8 / 3, "c": 16 / 3})
    assert M.fill(10, {"a": (1, 2), "b": (1, 3)}) == {"a": 2, "b": 3}
    assert M.fill(10, {"a": (0, 9), "b": (1, 0)}) == {"a": 0, "b": 0} and M.fill(5, {}) == {}


def test_siblings_first():
    # task_chats lacks 30 of its 40; forum_posts is its sibling, topic_cards is not
    b = M.budgets([("task_chats", "en", 10), ("forum_posts", "en", 1000), ("topic_cards", "en", 1000)], {"task_chats": (0.4, 1), "forum_posts": (0.2, 1), "topic_cards": (0.4, 1)}, 100)
    assert b == pytest.approx({("task_chats", "en"): 10, ("forum_posts", "en"): 50, ("topic_cards", "en"): 40})
    # the domain lacks 35 in all: the rest goes to the other domain
    b = M.budgets([("task_chats", "en", 10), ("forum_posts", "en", 15), ("topic_cards", "en", 1000)], {"task_chats": (0.4, 1), "forum_posts": (0.2, 1), "topic_cards": (0.4, 1)}, 100)
    assert b == pytest.approx({("task_chats", "en"): 10, ("forum_posts", "en"): 15, ("topic_cards", "en"): 75})
    # languages of one source before other sources
    b = M.budgets([("task_chats", "en", 30), ("task_chats", "de", 10)], {"task_chats": (1.0, 2)}, 70)
    assert b == pytest.approx({("task_chats", "en"): 52.5, ("task_chats", "de"): 17.5})


def docs(spark):
    rows = [(i, f"word {i} " * (1 + i % 5), "en" if i % 3 else "DE ", [" Task_Chats", "task-chats", "forum posts", "TOPIC_CARDS"][i % 4], 1, "x") for i in range(400)]
    return rows + [(900, None, "en", "task_chats", 1, "x"), (901, "", "en", "task_chats", 1, "x"), (902, "loose", "en", None, 1, "x"), (903, "loose", "en", "other", 1, "x"), (None, "none", "en", "task_chats", 1, "x"), (5, "again", "en", "task_chats", 1, "x")]


def test_mix(spark):
    df = spark.createDataFrame(docs(spark), DOC)
    t = spark.createDataFrame([("task_chats", 0.3, 1), ("forum_posts", 0.3, 2), ("topic_cards", 0.2, 3), ("subtitle_drafts", 0.2, 3), ("bad", None, 1), (None, 0.5, 1)], TARGET)
    drawn, shares = M.mix(df, t)
    d, s = drawn.collect(), {r["source"]: r for r in shares.collect()}
    assert len({r["doc_id"] for r in d}) == len(d) and not {900, 901, 902, 903, None} & {r["doc_id"] for r in d}
    assert max(r["uses"] for r in d if r["source"] == "task_chats") <= 1 and max(r["uses"] for r in d if r["source"] == "topic_cards") <= 3
    assert set(s) == {"task_chats", "forum_posts", "topic_cards", "subtitle_drafts"} and s["subtitle_drafts"]["tokens"] == 0
    assert abs(sum(r["share"] for r in s.values()) - 1) < 1e-5
    # what subtitle_drafts lacks goes to all, as it has no sibling here
    assert all(abs(s[k]["share"] - w) < 0.01 for k, w in (("task_chats", 0.375), ("forum_posts", 0.375), ("topic_cards", 0.25)))
    half = {r["source"]: r["share"] for r in M.mix(df, t, total_tokens=sum(r["tokens"] for r in s.values()) // 2)[1].collect()}
    for k, w in (("task_chats", 0.375), ("forum_posts", 0.375), ("topic_cards", 0.25)):
        assert abs(half[k] - w) < 0.02
    assert sorted(map(tuple, M.mix(df.repartition(5), t)[0].collect())) == sorted(map(tuple, d))
    assert sum(r["tokens"] for r in s.values()) == pytest.approx(sum(r["available_tokens"] for r in s.values()), rel=0.02)
    small, ss = M.mix(df, t, total_tokens=300)
    assert abs(sum(r["tokens"] for r in ss.collect()) - 300) < 60
    most, _ = M.mix(df, t, total_tokens=10**9)
    assert {r["uses"] for r in most.where("source = 'topic_cards'").collect()} == {3}


def test_empty(spark):
    df, t = spark.createDataFrame([], DOC), spark.createDataFrame([("task_chats", 1.0, 1)], TARGET)
    drawn, shares = M.mix(df, t)
    assert drawn.count() == 0 and [r["share"] for r in shares.collect()] == [0.0]
    drawn, shares = M.mix(spark.createDataFrame(docs(spark)[:9], DOC), t.limit(0))
    assert drawn.count() == 0 and shares.count() == 0


def test_source_key(spark):
    v = [" Task-Chats ", "TASK_CHATS", "task  chats", None, ""]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, x string").orderBy("i").select(M.source_key(F.col("x"))).collect()
    assert [r[0] for r in got] == ["task_chats"] * 3 + [None, ""]


def test_nearly_empty_source(spark):
    """A source with a few tokens takes nothing from the total; the others keep their proportions."""
    rows = [(i, "word " * 9, "en", ["task_chats", "topic_cards"][i % 2]) for i in range(4000)] + [(9000, "word", "en", "read_prompts")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    shares = [("task_chats", 0.3, 4), ("topic_cards", 0.2, 4), ("read_prompts", 0.5, 1)]
    s = {r["source"]: r for r in M.mix(df, spark.createDataFrame(shares, TARGET))[1].collect()}
    assert sum(r["tokens"] for r in s.values()) == pytest.approx(sum(r["available_tokens"] for r in s.values()), rel=0.01)
    assert s["read_prompts"]["tokens"] == s["read_prompts"]["available_tokens"] < 20
    assert abs(s["task_chats"]["share"] - 0.6) < 0.01 and abs(s["topic_cards"]["share"] - 0.4) < 0.01
    without = {r["source"]: r for r in M.mix(df, spark.createDataFrame(shares[:2], TARGET))[1].collect()}
    assert all(abs(without[k]["tokens"] - s[k]["tokens"]) < 40 for k in without)


def test_domain_short(spark):
    """A domain whose sources are all used up leaves the rest to another domain."""
    rows = [(i, "word " * 9, "en", "task_chats" if i < 50 else "forum_posts" if i < 100 else "topic_cards") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    t = spark.createDataFrame([("task_chats", 0.3, 1), ("forum_posts", 0.3, 2), ("topic_cards", 0.4, 3)], TARGET)
    s = {r["source"]: r for r in M.mix(df, t)[1].collect()}
    per = s["topic_cards"]["available_tokens"] / 900
    assert [round(s[k]["tokens"] / per) for k in ("task_chats", "forum_posts")] == [50, 100]
    assert abs(s["topic_cards"]["tokens"] / per - 850) < 3
