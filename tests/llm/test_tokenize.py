"""Problem 6: exact against the library, and round trips."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from turnweave.llm import tokenize as T

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def bpe():
    with open(T.vocabulary_path(), "rb") as f:
        return T.Bpe(f.read())


@pytest.fixture(scope="module")
def library():
    import base64

    import tiktoken

    with open(T.vocabulary_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={})


FIXED = ["", " ", "\n\n  x", "a" * 5000, "Hello, world's 123  <|endoftext|>", "naïve 日本語 😀‍👩 ​\x00", "'S 'll don't\t\tx   ", "ſ" * 50, "éé é" * 40]


@pytest.mark.parametrize("text", FIXED)
def test_fixed(bpe, library, text):
    assert bpe.encode(text) == library.encode_ordinary(text)
    assert bpe.decode(bpe.encode(text)) == text


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=60) | st.text(alphabet=" ab'sl\n\tée1😀", max_size=200))
def test_any(bpe, library, text):
    assert bpe.encode(text) == library.encode_ordinary(text) and bpe.decode(bpe.encode(text)) == text


def test_cache_bound(bpe, monkeypatch):
    monkeypatch.setattr(T, "CACHE_PIECES", 3)
    text = "many different words stand here to fill it"
    assert bpe.encode(text) == bpe.encode(text)


def test_dataframe(spark, bpe):
    rows = [(1, "hi there", "en", 3), (2, None, None, 4), (3, "", "x", 5), (1, "hi there", "en", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n int")
    got = sorted(map(tuple, T.encode(df).collect()))
    assert got == sorted((i, l, n, bpe.encode(t)) for i, t, l, n in rows)
    assert [r["text"] for r in T.decode(T.encode(df)).orderBy("n").collect()] == ["hi there", "hi there", "", ""]
    assert {r["doc_id"]: r["n_tokens"] for r in T.count_tokens(df).collect()} == {1: 2, 2: 0, 3: 0}
    assert T.encode(df.limit(0)).count() == 0
    clash = T.encode(df.withColumnRenamed("lang", "IDS"))
    assert clash.columns == ["doc_id", "n", "ids"] and clash.where("doc_id = 1").first()["ids"] == bpe.encode("hi there")


def test_path_is_a_parameter(spark, tmp_path):
    import base64

    p = tmp_path / "v"
    p.write_bytes(b"\n".join(base64.b64encode(bytes([i])) + b" %d" % i for i in range(256)) + b"\n" + base64.b64encode(b"ab") + b" 256\n")
    assert T.encode(spark.createDataFrame([("abab",)], "text string"), path=str(p)).first()["ids"] == [256, 256]
    assert not os.path.exists("byte_bpe_50k.tiktoken")
