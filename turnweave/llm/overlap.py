"""Same or near-same dialogues across splits (problem 5).

Two dialogues overlap if at least four fifths of the words of the longer one occur in the other in the same order:
LCS(x, y) >= 0.8 * max(|x|, |y|). The join is exact and needs no cross product:

* Dialogues with equal words form one class; everything up to the verified class pairs works on one row for each class.
* A common subsequence of L words is L words in common, as multisets. The shingles are therefore single words, repeated
  ones told apart by their number, in a common order by rarity. Of n words only the first n - ceil(0.8 n) + 1 are
  indexed, a fifth: two dialogues that overlap must have one of them in common (prefix filter). Rarity is taken from
  counts of all words of the corpus in a fixed number of hashed buckets.
* Evaluation prefixes are joined with training prefixes on the word; a word that holds many rows is spread over a grid.
  In the join itself a pair must pass the length filter, the positional filter (what stands behind the common word on
  both sides must suffice for L), and a bound on the words the two don't share, from 256-bit parity maps of their word
  multisets: every bit in which they differ stands for at least one unshared word. None loses a true pair, whatever the
  share.
* The pairs left are verified by the length of the longest common subsequence, bit-parallel.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.runtime import cut, lookup, release, salted_join, ship

SHARE = 0.8
#: Hashed buckets of word counts: the size of what is broadcast, whatever the corpus.
COUNT_BUCKETS = 1 << 20
#: Words whose hash a worker remembers; the dictionary is emptied beyond, which changes the speed only.
CACHE_WORDS = 500_000

#: How split names begin, letters only, lower case.
TRAIN_NAMES, EVAL_NAMES = ("train",), ("val", "dev", "test", "eval")


def side(split):
    """'train' or 'eval' for a split name read freely, null for null and other names."""
    letters = F.regexp_replace(F.lower(split), "[^a-z]", "")
    starts = lambda names: F.lit(False) if not names else _any([letters.startswith(n) for n in names])
    return F.when(starts(TRAIN_NAMES), F.lit("train")).when(starts(EVAL_NAMES), F.lit("eval"))


def _any(conds):
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Runs of letters or digits, without regard to case or accents."""
    t = text if text.isascii() else "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))
    return _WORD.findall(t.casefold())


def fraction(share: float) -> Fraction:
    """The share as written, so that needed lengths are whole-number arithmetic and alike everywhere."""
    out = Fraction(str(share))
    if not 0 < out <= 1:
        raise ValueError("the share must be above 0 and at most 1")
    return out


def needed(n: int, m: int, share: float = SHARE) -> int:
    """The least common subsequence that dialogues of n and m words must have."""
    f = fraction(share)
    return -(-max(n, m) * f.numerator // f.denominator)


def prefix_length(n, share: float = SHARE):
    """Words of a dialogue of n words of which one must be shared with any partner, rarest first."""
    f = fraction(share)
    return n - (-(-n * f.numerator // f.denominator)) + 1


def lcs(x: list[str], y: list[str]) -> int:
    """Length of the longest common subsequence, one bit for each word of x."""
    if len(x) > len(y):
        x, y = y, x
    at: dict[str, int] = {}
    for i, w in enumerate(x):
        at[w] = at.get(w, 0) | (1 << i)
    full = (1 << len(x)) - 1
    v = full
    for w in y:
        if m := at.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(x) - v.bit_count()


def classes(dialogs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, texts): members has (cls, dialog_id, side) without repetition, texts (cls, words) one row a class.

    A null or empty dialogue, null turns and turns without letters or digits add no word; dialogues without words and
    rows with a null id or a split that is no split are in no class. Where a dialog_id was delivered with several
    contents or splits, each counts.
    """
    import pyarrow as pa

    ship(dialogs.sparkSession)
    d = dialogs.select("dialog_id", side(F.col("split")).alias("side"), F.array_join("dialog", " ").alias("t"))
    d = d.where("dialog_id is not null and side is not null and t is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = [" ".join(words(x)) for x in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("dialog_id"), b.column("side"), pa.array(t, pa.string())], names=["dialog_id", "side", "words"])

    d = d.mapInArrow(run, "dialog_id bigint, side string, words string").where("words <> ''")
    d = cut(d.withColumn("cls", F.unhex(F.md5("words"))))
    return d.select("cls", "dialog_id", "side").distinct(), d.groupBy("cls").agg(
        F.first("words").alias("words"), F.max(F.col("side") == "train").alias("in_train"), F.max(F.col("side") == "eval").alias("in_eval")
    )


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def word_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all words of ``texts``: 64-bit hashes, a word's repetitions in one text told apart by their number."""
    known = _Hashes()
    parts = [t.split(" ") for t in texts]
    n = np.fromiter(map(len, parts), np.int64, len(parts))
    row = np.repeat(np.arange(len(parts)), n)
    h = np.fromiter((known[w] for p in parts for w in p), np.uint64, int(n.sum()))
    order = np.lexsort((h, row))
    r, k = row[order], h[order]
    new = np.ones(len(k), bool)
    new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
    start = np.flatnonzero(new)
    again = np.arange(len(k)) - np.repeat(start, np.diff(np.append(start, len(k))))
    key = (k ^ (again.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    return r, key ^ (key >> np.uint64(32))


def with_keys(texts: DataFrame) -> DataFrame:
    """``texts`` (cls, words, in_train, in_eval) with ``keys``, the word keys of each class."""
    import pyarrow as pa

    names = texts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, key = word_keys(b.column("words").to_pylist())
            ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=b.num_rows)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(key.view(np.int64)))], names=[*names, "keys"])

    return texts.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema) + ", keys array<bigint>")


def key_counts(texts: DataFrame, buckets: int = COUNT_BUCKETS) -> np.ndarray:
    """The number of word keys of all classes in each hashed bucket; at most ``buckets`` numbers reach the driver."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for b in batches:
            key = b.column("keys").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            np.add.at(n, (key % np.uint64(buckets)).astype(np.int64), 1)
        k = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n[k], pa.int64())], names=["bucket", "n"])

    got = texts.select("keys").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def prefixes(texts: DataFrame, counts: np.ndarray, share: float = SHARE) -> DataFrame:
    """(cls, in_train, in_eval, n, pos, m0 … m3, key): the rarest words of each class, as many as its length demands;
    ``pos`` is the word's place in the order by rarity, ``m`` the parity map of all words."""
    import pyarrow as pa

    shared = texts.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = shared.value
        for b in batches:
            keys = b.column("keys")
            n = np.diff(keys.offsets.to_numpy()).astype(np.int64)
            key = keys.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            row = np.repeat(np.arange(len(n)), n)
            odd = np.zeros((len(n), 256), np.uint8)
            np.add.at(odd, (row, (key >> np.uint64(20)).astype(np.int64) & 255), 1)
            maps = np.packbits(odd & 1, axis=1).view(np.int64)
            order = np.lexsort((key, count[(key % np.uint64(len(count))).astype(np.int64)], row))
            pos = np.arange(len(key)) - np.repeat(np.cumsum(n) - n, n)
            first = pos < prefix_length(n, share)[row]
            at = row[first]
            idx = pa.array(at)
            cols = [b.column(c).take(idx) for c in ("cls", "in_train", "in_eval")]
            cols += [pa.array(n[at].astype(np.int32)), pa.array(pos[first].astype(np.int32)), *(pa.array(maps[at, j]) for j in range(4)), pa.array(key[order][first].view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, names=["cls", "in_train", "in_eval", "n", "pos", "m0", "m1", "m2", "m3", "key"])

    return texts.select("cls", "in_train", "in_eval", "keys").mapInArrow(run, "cls binary, in_train boolean, in_eval boolean, n int, pos int, m0 bigint, m1 bigint, m2 bigint, m3 bigint, key bigint")


def candidates(texts: DataFrame, share: float = SHARE) -> DataFrame:
    """(a, b): pairs of different classes, a in train and b in evaluation, that pass the filters, perhaps repeated."""
    p = cut(prefixes(texts, key_counts(texts), share))
    name = lambda flag, s: p.where(flag).select(*(F.col(c).alias(f"{c}{s}") for c in ("cls", "n", "pos", "m0", "m1", "m2", "m3")), "key")
    f = fraction(share)
    need = F.expr(f"({f.numerator}L * greatest(na, nb) + {f.denominator - 1}L) div {f.denominator}L")  # whole numbers: rounding doubles is slow in the inner loop of the join
    apart = sum((F.bit_count(F.col(f"m{i}a").bitwiseXOR(F.col(f"m{i}b"))) for i in range(1, 4)), F.bit_count(F.col("m0a").bitwiseXOR(F.col("m0b"))))
    behind = F.least(F.col("na") - F.col("posa"), F.col("nb") - F.col("posb"))
    near = (F.least("na", "nb") >= need) & (behind >= need) & (apart <= F.col("na") + F.col("nb") - 2 * need) & (F.col("clsa") != F.col("clsb"))
    return salted_join(name("in_train", "a"), name("in_eval", "b"), "key", F.col("clsa"), F.col("clsb")).where(near).select(F.col("clsa").alias("a"), F.col("clsb").alias("b"))


def class_pairs(texts: DataFrame, share: float = SHARE) -> DataFrame:
    """(a, b): each pair of a training and an evaluation class that overlap, equal classes included."""
    cand = cut(candidates(texts, share).distinct())

    @F.pandas_udf("boolean")
    def holds(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for s, t in zip(x, y):
            s, t = s.split(" "), t.split(" ")
            out.append(lcs(s, t) >= needed(len(s), len(t), share))
        return pd.Series(out, dtype=bool)

    t = texts.select("cls", "words")
    both = lookup(lookup(cand, t.select(F.col("cls").alias("a"), F.col("words").alias("wa")), "a", "inner"), t.select(F.col("cls").alias("b"), F.col("words").alias("wb")), "b", "inner")
    near = both.where(holds("wa", "wb")).select("a", "b")
    return near.unionByName(texts.where("in_train and in_eval").select(F.col("cls").alias("a"), F.col("cls").alias("b")))


def _pairs(dialogs: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    """(members, class pairs), both written."""
    members, texts = classes(dialogs)
    texts = cut(with_keys(texts))
    pairs = cut(class_pairs(texts, share))
    members = cut(members)
    release(texts)
    return members, pairs


def _expand(pairs: DataFrame, train: DataFrame, evals: DataFrame) -> DataFrame:
    """(train_id, eval_id), once each; large classes and classes with many partners are spread over tasks."""
    tr, ev = train.select(F.col("cls").alias("a"), F.col("dialog_id").alias("train_id")), evals.select(F.col("cls").alias("b"), F.col("dialog_id").alias("eval_id"))
    one = cut(salted_join(pairs, tr, "a", F.col("b"), F.col("train_id")))  # read more than once below
    return salted_join(one, ev, "b", F.col("train_id"), F.col("eval_id")).where("train_id <> eval_id").select("train_id", "eval_id").distinct()


def overlaps(dialogs: DataFrame, share: float = SHARE) -> DataFrame:
    """(train_id, eval_id): each pair of one train and one validation or test dialogue that overlap, once.

    The members of the two classes of a pair are expanded at the very end; that many rows are asked for.
    """
    members, pairs = _pairs(dialogs, share)
    return _expand(pairs, members.where("side = 'train'"), members.where("side = 'eval'"))


def found(dialogs: DataFrame, share: float = SHARE) -> DataFrame:
    """(dialog_id_a, dialog_id_b), the smaller id first."""
    return overlaps(dialogs, share).select(F.least("train_id", "eval_id").alias("dialog_id_a"), F.greatest("train_id", "eval_id").alias("dialog_id_b")).distinct()


def report(dialogs: DataFrame, share: float = SHARE) -> DataFrame:
    """(split, dataset_name, pairs, dialogs): overlaps with train by the evaluation dialogue's split and source.

    ``split`` is ``validation`` or ``test``; ``dataset_name`` may be null. Only groups with an overlap have a row. Pairs
    are counted from the sizes of classes; only dialogues that stand in several classes or on both sides, whose pairs
    could be counted twice, are expanded.
    """
    members, pairs = _pairs(dialogs, share)
    several = members.groupBy("dialog_id").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1").select(F.col("dialog_id").alias("_id"))
    m = cut(members.join(several, F.col("dialog_id") == F.col("_id"), "left").select("cls", "dialog_id", "side", F.col("_id").isNotNull().alias("several")))
    side_of = lambda s, x: m.where((F.col("side") == s) & (F.col("several") == x))
    sizes = side_of("train", False).groupBy(F.col("cls").alias("a")).agg(F.count(F.lit(1)).alias("n"))
    of_class = lookup(pairs, sizes, "a", "inner").groupBy(F.col("b").alias("cls")).agg(F.sum("n").alias("n"))
    counted = lookup(side_of("eval", False), of_class, "cls", "inner").select(F.col("dialog_id").alias("eval_id"), "n")
    train, evals = (m.where(F.col("side") == s) for s in ("train", "eval"))
    listed = _expand(pairs, train.where("several"), evals).unionByName(_expand(pairs, train, evals.where("several"))).distinct()
    o = counted.unionByName(listed.groupBy("eval_id").agg(F.count(F.lit(1)).alias("n"))).groupBy("eval_id").agg(F.sum("n").alias("n"))
    letters = F.regexp_replace(F.lower("split"), "[^a-z]", "")
    d = dialogs.where(side(F.col("split")) == "eval").select(F.col("dialog_id").alias("eval_id"), F.when(letters.startswith("test"), "test").otherwise("validation").alias("split"), "dataset_name").distinct()
    return o.join(d, "eval_id").groupBy("split", "dataset_name").agg(F.sum("n").alias("pairs"), F.count(F.lit(1)).alias("dialogs"))
