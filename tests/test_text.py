"""Golden strings of the clean-up chains, labels, paths."""

import re

import pytest
from pyspark.sql import functions as F

from turnweave.functions import text as X

#: What the clean-up chains must make of these texts.
CALLHOME = [
    ("hello &ibm {laugh} so %um ((i think)) (( )) and call <German Feldmessen>.", "hello ibm so um i think and call Feldmessen."),
    ("I ((sent her to)) ((Taiwan)) she was", "I sent her to Taiwan she was"),
    ("hello <German Feldmessen>. yes indeed <German Feldmessen>.", "hello Feldmessen. yes indeed Feldmessen."),
    (None, None),
    ("", ""),
]
SWITCHBOARD = [
    ("[laughter-hi]", "hi"), ("i- i really felt", "i i really felt"), ("{weatherwise}", "weatherwise"), ("[splace/space]", "space"), ("w[ent]", "went"), ("-[th]at", "that"), ("okay_1", "okay"),
    ("[noise] so [laughter]  well ", "so well"), ("[laughter-don't]", "don't"), ("é- école_2", "é école"), (None, None), ("", ""),
]


def column(spark, values, f):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").orderBy("i").select(f(F.col("x"))).collect()]


def test_callhome(spark):
    assert column(spark, [a for a, _ in CALLHOME], X.clean_callhome) == [b for _, b in CALLHOME]


def test_switchboard(spark):
    assert column(spark, [a for a, _ in SWITCHBOARD], X.clean_switchboard) == [b for _, b in SWITCHBOARD]


@pytest.mark.parametrize("rules,f", [(X.SWITCHBOARD_RULES, X.clean_switchboard), (X.CALLHOME_RULES, X.clean_callhome)])
def test_chain_equals_python(spark, rules, f):
    texts = ["a- b_1 [x/y] {z} ((q)) (( )) **w** +u+ &v %t -- <German no> //s//", "é- [laughter-été] {ß}", "\t a\t\tb  c ", "((a b)) [x] mid [y]", "<b_aside> hi", "-a b-"]
    want = []
    for t in texts:
        for p, n in rules:
            t = re.sub(p, n.replace("$1", r"\1").replace("$2", r"\2"), t)
        want.append(t)
    assert column(spark, texts, f) == want


def test_small_functions(spark):
    assert column(spark, ["\t a  b \n", None], X.strip) == ["a  b", None]
    assert column(spark, ["a\tb   c"], X.squeeze) == ["a b c"]
    assert column(spark, ["1-2-3 HELLO YOU", "x"], lambda c: X.split_once(c)[1]) == ["HELLO YOU", None]
    assert column(spark, ["p225_001_mic2"], lambda c: X.join_first(c, "_", 2)) == ["p225_001"]
    assert column(spark, ["a/b/c.d.wav"], X.stem) == ["c.d"]
    assert column(spark, ["a/b/c.wav"], X.dirname) == ["a/b"]
    assert column(spark, ["x.wav", "x.flac"], lambda c: X.swap_suffix(c, ".wav", "_f0.pt")) == ["x_f0.pt", "x.flac"]
    assert column(spark, ["A:", "B:", "agent", "user", "c", None], X.channel_of) == [0, 1, 0, 1, 1, None]
    assert column(spark, ["A:", "c"], lambda c: X.channel_of(c, strict=True)) == [0, None]
    assert column(spark, ["Uh-huh ", "no"], X.is_backchannel) == [True, False]
    assert column(spark, ["", "...", "é", "_"], X.has_word) == [False, False, True, True]
    assert column(spark, ["hold", "x"], X.label_index) == [2, None]


def test_fisher_discs(spark):
    n = [1, 799, 800, 1699, 1700, 5850]
    got = spark.createDataFrame([(x,) for x in n], "n int").select(X.fisher_disc(F.col("n")), X.zero_filled(F.col("n"), 5)).collect()
    assert [tuple(r) for r in got] == list(zip([1, 1, 2, 2, 3, 7], ["00001", "00799", "00800", "01699", "01700", "05850"]))
