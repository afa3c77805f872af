"""Encoding of the whole corpus with a public byte-level BPE tokenizer (problem 6).

The vocabulary is read once on the driver from a rank file (a base64 token and its rank on each line; its path is a
parameter) and broadcast: its size doesn't depend on the data. Each text is split by the tokenizer's pattern; the
bytes of a piece form a doubly linked list of symbols, a priority queue holds the ranks of adjacent pairs, the lowest
rank is merged first and the leftmost among equals, and entries whose symbols have changed since are skipped. A piece
is encoded once for each Python worker and kept in a bounded dictionary.

Null and empty texts have the empty list of ids. Decoding concatenates the vocabulary's byte strings.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.runtime import ship

#: Fixed value: the pattern that splits a text into pieces before any merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RANKS = "byte_bpe_50k.tiktoken"
#: Pieces a worker remembers; the dictionary is emptied beyond, which changes the speed only.
CACHE_PIECES = 300_000
#: Longer pieces are not remembered.
CACHE_BYTES = 64


def vocabulary_path(name: str = RANKS) -> str:
    """Where the installed package of public tokenizers keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Bpe:
    """Encoder and decoder for a rank file's content."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN):
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.split = regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}
        self.strings: dict[int, bytes] | None = None

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece: merges by a heap over a linked list, stale entries skipped."""
        rank = self.ranks.get
        if (whole := rank(data)) is not None:
            return [whole]
        n = len(data)
        part = [data[i : i + 1] for i in range(n)]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank(data[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, size = heappop(heap)
            left = part[i]
            j = after[i]
            if left is None or j >= n or len(left) + len(part[j]) != size:
                continue  # stale: one of the two symbols has grown or gone
            part[i], part[j] = left + part[j], None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                pair = part[i] + part[k]
                if (r := rank(pair)) is not None:
                    heappush(heap, (r, i, len(pair)))
            if (h := before[i]) >= 0:
                pair = part[h] + part[i]
                if (r := rank(pair)) is not None:
                    heappush(heap, (r, h, len(pair)))
        return [self.ranks[x] for x in part if x is not None]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        known, out = self.known, []
        for p in self.split(text):
            ids = known.get(p)
            if ids is None:
                data = p.encode("utf-8", "surrogatepass")
                ids = self.piece(data)
                if len(data) <= CACHE_BYTES:
                    if len(known) >= CACHE_PIECES:
                        known.clear()
                    known[p] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        if self.strings is None:
            self.strings = {r: s for s, r in self.ranks.items()}
        return b"".join(self.strings[i] for i in ids).decode("utf-8", "surrogatepass")


_here: dict[tuple[int, str], Bpe] = {}


def bpe_of(content: Broadcast, pattern: str = PATTERN) -> Bpe:
    """The encoder of a broadcast rank file, built once in each worker."""
    ranks = content.value
    key = (hash(ranks), pattern)  # bytes keep their hash
    if key not in _here:
        _here.clear()
        _here[key] = Bpe(ranks, pattern)
    return _here[key]


def share_ranks(spark: SparkSession, path: str | None = None) -> Broadcast:
    ship(spark)
    with open(path or vocabulary_path(), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _map(docs: DataFrame, text: str, path: str | None, counts: bool, pattern: str) -> DataFrame:
    import pyarrow as pa

    content = share_ranks(docs.sparkSession, path)
    new, kind = ("n_tokens", "bigint") if counts else ("ids", "array<int>")
    kept = [c for c in docs.columns if c.lower() not in (text.lower(), new)]
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept), f"{new} {kind}"])
    docs = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_of(content, pattern)
        for b in batches:
            encoded = [bpe.encode(t) for t in b.column("_text").to_pylist()]
            col = pa.array([len(x) for x in encoded], pa.int64()) if counts else pa.array(encoded, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), col], names=[*kept, new])

    return docs.mapInArrow(run, fields)


def encode(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """``docs`` with the column ``text`` replaced by ``ids``; one pass without a shuffle, whole texts.

    Other columns stay as they are, but for one already named ``ids``, which is replaced. Rows, repeated ones too, stay
    one to one.
    """
    return _map(docs, text, path, False, pattern)


def count_tokens(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """As :func:`encode`, with ``n_tokens`` in place of the ids."""
    return _map(docs, text, path, True, pattern)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` with ``ids`` replaced by ``text``; null ids give null, ids outside the vocabulary raise."""
    content = share_ranks(encoded.sparkSession, path)

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        bpe = bpe_of(content)
        return ids.map(lambda x: None if x is None else bpe.decode(list(x)))

    return encoded.withColumn("text", text("ids")).drop("ids")
