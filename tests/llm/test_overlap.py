"""Problem 5 against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from turnweave.llm import overlap as O

SCHEMA = "dialog_id long, split string, dialog array<string>, dataset_name string, key string, n int, words string"


def slow_lcs(x, y):
    t = [0] * (len(y) + 1)
    for a in x:
        p = 0
        for j, b in enumerate(y, 1):
            p, t[j] = t[j], p + 1 if a == b else max(t[j], t[j - 1])
    return t[-1]


def test_lcs_and_words():
    rnd = random.Random(0)
    for _ in range(300):
        x, y = ([rnd.choice("abcde") for _ in range(rnd.randint(0, 30))] for _ in range(2))
        assert O.lcs(x, y) == slow_lcs(x, y)
    assert O.words("Élan VITAL, naïve_42! ﬁn") == ["elan", "vital", "naive", "42", "fin"]
    assert [O.needed(n, 1) for n in (1, 4, 5, 6, 10)] == [1, 4, 4, 5, 8]


@pytest.mark.parametrize("share", [0.5, 0.6, 0.8, 1.0])
def test_prefix_is_safe(share):
    """Two texts that overlap have a word in common in their prefixes, and its places leave room for the rest."""
    rnd = random.Random(1)
    hit = 0
    for _ in range(3000):
        x = [rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(1, 25))]
        y = list(x)
        for _ in range(rnd.randint(0, max(1, len(x) // 2))):
            i = rnd.randint(0, len(y))
            y[i : i + rnd.randint(0, 1)] = [rnd.choice("abcdefgh")] * rnd.randint(0, 1)
        need = O.needed(len(x), len(y), share)
        if not y or O.lcs(x, y) < need:
            continue
        hit += 1
        row, key = O.word_keys([" ".join(x), " ".join(y)])
        a, b = (sorted(key[row == r].tolist()) for r in (0, 1))
        pa, pb = (z[: O.prefix_length(len(z), share)] for z in (a, b))
        assert any(min(len(a) - pa.index(k), len(b) - pb.index(k)) >= need for k in set(pa) & set(pb)), (x, y)
    assert hit > 500


def test_word_keys():
    row, key = O.word_keys(["a b a", "a", "b a a a"])
    sets = [set(key[row == r].tolist()) for r in range(3)]
    assert [len(s) for s in sets] == [3, 1, 4] and sets[1] < sets[0] < sets[2]
    assert [len(x) for x in O.word_keys([])] == [0, 0]
    with pytest.raises(ValueError):
        O.needed(3, 3, 0)


@pytest.mark.parametrize("split,side", [("Train", "train"), ("training", "train"), ("val", "eval"), ("dev", "eval"), ("TEST ", "eval"), ("Valid", "eval"), ("other", None), ("", None), (None, None)])
def test_sides(spark, split, side):
    assert spark.createDataFrame([(split,)], "s string").select(O.side(F.col("s"))).first()[0] == side


def brute(rows, share=0.8):
    t, e = {}, {}
    for i, s, d, *_ in rows:
        w = O.words(" ".join(x for x in d or [] if x is not None))
        side = "train" if (s or "").lower().startswith("train") else "eval" if (s or "").strip().lower()[:3] in ("val", "dev", "tes") else None
        if w and side and i is not None:
            (t if side == "train" else e).setdefault(i, []).append(w)
    return {(min(i, j), max(i, j)) for i, xs in t.items() for j, ys in e.items() if i != j and any(O.lcs(x, y) >= O.needed(len(x), len(y), share) for x in xs for y in ys)}


def run(spark, rows, share=0.8):
    df = spark.createDataFrame([(*r, "c", "k", 1, "w") for r in rows], SCHEMA)
    got = [tuple(r) for r in O.found(df, share).collect()]
    assert len(got) == len(set(got))
    return set(got), df


def test_cases(spark):
    rows = [
        (1, "train", ["Hello there, how are you?"]), (2, "test", ["hello", "THERE how are you"]), (3, "dev", ["hello there how are"]), (4, "val", ["hello there how"]), (5, None, ["hello there how are you"]),
        (6, "train", None), (7, "test", []), (8, "test", ["...", None]), (9, "train", ["?!"]), (10, "train", ["one"]), (11, "test", ["One!"]), (12, "test", ["one two"]), (2, "test", ["hello", "THERE how are you"]), (None, "test", ["one"]), (13, "train", ["ONE"]), (14, "train", ["hello there how are you"]),
    ]
    got, df = run(spark, rows)
    assert got == brute(rows) == {(1, 2), (1, 3), (2, 14), (3, 14), (10, 11), (11, 13)}
    rep = {(r["split"], r["dataset_name"]): (r["pairs"], r["dialogs"]) for r in O.report(df).collect()}
    assert rep == {("test", "c"): (4, 2), ("validation", "c"): (2, 1)}
    assert run(spark, [])[0] == set()


def test_no_common_bigram(spark):
    """Six of ten words in order, but no two of them neighbours in both."""
    rows = [(1, "train", ["a p b q c"]), (2, "test", ["a r b s c"])]
    assert run(spark, rows, 0.6)[0] == {(1, 2)} and run(spark, rows, 0.61)[0] == set()


def report_of(rows, pairs, name="c"):
    """Pairs are train before evaluation here: (train id, eval id)."""
    out = {}
    for i, s in {(i, "test" if s.strip().lower().startswith("test") else "validation") for i, s, *_ in rows if (s or "").strip().lower()[:3] in ("val", "dev", "tes")}:
        if n := sum(e == i for _, e in pairs):
            p, d = out.get((s, name), (0, 0))
            out[s, name] = (p + n, d + 1)
    return out


def test_report_counts_what_expansion_gives(spark):
    """Copies, ids delivered with several contents and ids on both sides."""
    rnd = random.Random(9)
    base = [" ".join(rnd.choice("abcdefghijklmnopqrstuvw") for _ in range(rnd.randint(3, 12))) for _ in range(8)]
    rows = [(rnd.randint(0, 60), rnd.choice(["train", "train", "test", "val"]), [rnd.choice(base) + rnd.choice(["", " x", " y"])]) for _ in range(150)]
    df = spark.createDataFrame([(*r, "c", "k", 1, "w") for r in rows], SCHEMA)
    pairs = {tuple(r) for r in O.overlaps(df).collect()}
    assert {(min(p), max(p)) for p in pairs} == brute(rows)
    assert {(r["split"], r["dataset_name"]): (r["pairs"], r["dialogs"]) for r in O.report(df).collect()} == report_of(rows, pairs)


@pytest.mark.parametrize("share", [0.5, 0.6, 0.8, 1.0])
def test_random(spark, share):
    rnd = random.Random(4)
    base = [[rnd.choice(["the", "a", "is", *(f"w{k}" for k in range(40))]) for _ in range(rnd.randint(1, 40))] for _ in range(25)]
    rows = []
    for i in range(260):
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 1 + len(w) // 4)):
            k = rnd.randint(0, len(w))
            w[k : k + rnd.randint(0, 1)] = [f"w{rnd.randint(0, 60)}"] * rnd.randint(0, 1)
        rows.append((i, rnd.choice(["train", "train", "test", "val", "zzz"]), [" ".join(w)]))
    got, _ = run(spark, rows, share)
    want = brute(rows, share)
    assert got == want and len(want) > 50


def test_very_long(spark):
    w = [f"x{i}" for i in range(20_000)]
    rows = [(1, "train", [" ".join(w)]), (2, "test", [" ".join(w[2000:])]), (3, "test", [" ".join(w[:15_000])])]
    assert run(spark, rows)[0] == {(1, 2)}
