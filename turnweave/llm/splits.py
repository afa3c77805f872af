"""Splits that keep related records together (problem 1).

Recordings that name the same session, or sessions declared the same call, form one group; whole groups go to train,
validation and test so that the target shares are met as nearly as possible.

Groups are the connected components of the sessions under the declared links. They are found by random-mate
contraction: in each round every vertex draws a coin from a hash; a vertex with tails that has a neighbour with heads
is collapsed into the smallest such neighbour; edges are rewritten, and the rounds end when no edge is left. Each
vertex is collapsed once, so the (vertex, mate) rows form a forest no deeper than the number of rounds, and the
labels are unwound by pointer doubling.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnweave.operators.cumulate import running_total
from turnweave.runtime import cut, hot_keys, lookup, release, union_all

#: Relations that declare two sessions the same call.
SAME_CALL = ("same_call", "rerelease_of", "copy_of")

#: How spelled dataset names begin, letters only, and the prefix of their sessions.
DATASET_PREFIXES = (("sw", "sw"), ("fi", "fe"), ("fs", "fe"), ("fe", "fe"), ("ca", "ch"), ("ch", "ch"), ("va", "vi"), ("vi", "vi"))

FULL_WIDTH, ASCII = "０１２３４５６７８９", "0123456789"

#: A group is placed by itself if it weighs more than this part of the smallest share.
HEAVY_PART = 0.01
#: Shares under it count as it when heavy groups are told apart, which bounds their number by 1 / (HEAVY_PART * LEAST_SHARE).
LEAST_SHARE = 0.001
#: split_targets has one row for each split; more than this many are refused.
MOST_TARGETS = 10_000


def dataset_prefix(name: Column) -> Column:
    """The session prefix of a dataset name however it is spelled; null for null and unknown names."""
    letters = F.regexp_replace(F.lower(name), "[^a-z]", "")
    out = F.lit(None).cast("string")
    for begin, prefix in reversed(DATASET_PREFIXES):
        out = F.when(letters.startswith(begin), F.lit(prefix)).otherwise(out)
    return out


def session_key(dataset: Column, session: Column, path: Column | None = None) -> Column:
    """The session that a (dataset, session) pair names, else the one that a telling ``audio_path`` names, else null.

    A prefix in the session itself decides; bare digits need the dataset. Case, blanks, separators, folders, file
    endings, channel letters, leading zeros and full-width digits make no difference. The key is the prefix, a colon
    and the digits without leading zeros.
    """
    s = F.lower(F.translate(session, FULL_WIDTH, ASCII))
    named = r"(?:^|[^a-z])(sw|fe|ch|vi)[ _-]*0*([0-9]+)"
    bare = r"^\s*0*([0-9]+)\s*$"
    filed = r"(?:^|/)(sw|fe_|ch_|vi_)0*([0-9]+)_[0-9]+\.[a-z0-9]+\s*$"
    key = lambda prefix, digits: F.concat(prefix, F.lit(":"), digits)
    out = F.when(s.rlike(named), key(F.regexp_extract(s, named, 1), F.regexp_extract(s, named, 2)))
    out = out.when(s.rlike(bare) & dataset_prefix(dataset).isNotNull(), key(dataset_prefix(dataset), F.regexp_extract(s, bare, 1)))
    if path is not None:
        p = F.lower(F.translate(path, FULL_WIDTH, ASCII))
        out = out.when(p.rlike(filed), key(F.regexp_extract(p, filed, 1).substr(1, 2), F.regexp_extract(p, filed, 2)))
    return out


def components(edges: DataFrame, u: str = "u", v: str = "v", seed: int = 1234) -> DataFrame:
    """(vertex, label) for every vertex that was collapsed into another; a vertex not listed is its own label.

    Loops, repeated and reversed edges and edges with a null end change nothing. Every round ends in a written table.
    Edges are distinct before they are rewritten, so a hot vertex has no more rows than it has neighbours; its join
    with the one row of its mate is split by adaptive execution.
    """
    e = _tidy(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null"))
    e = last = cut(e)
    mates: list[DataFrame] = []
    while not e.isEmpty():
        tails = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(seed + len(mates))), F.lit(2)) == 0  # noqa: B023, E731
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        mate = cut(both.where(tails("u") & ~tails("v")).groupBy("u").agg(F.min("v").alias("mate")))
        for c in ("u", "v"):
            m = mate.select(F.col("u").alias(c), "mate")
            e = e.join(m, c, "left").withColumn(c, F.coalesce("mate", c)).drop("mate")
        done, e = last, cut(_tidy(e))
        last = e
        release(done)
        mates.append(mate)
    if not mates:
        return e.select(F.col("u").alias("vertex"), F.col("v").alias("label"))
    parents = cut(union_all(mates).select(F.col("u").alias("vertex"), F.col("mate").alias("label")))
    release(*mates)
    for _ in range(ceil(log2(len(mates))) if len(mates) > 1 else 0):
        above = parents.select(F.col("vertex").alias("label"), F.col("label").alias("up"))
        done, parents = parents, cut(parents.join(above, "label", "left").select("vertex", F.coalesce("up", "label").alias("label")))
        release(done)
    return parents


def _tidy(e: DataFrame) -> DataFrame:
    return e.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def record_groups(recordings: DataFrame, session_links: DataFrame, seed: int = 1234) -> DataFrame:
    """(rec_id, group_id, rows, many): each rec_id with the smallest rec_id of its group, its number of delivered rows
    and whether the group has further rec_ids.

    A record that names no session is alone. Rows with a null rec_id are left out: they can't be told apart. Links
    with a half that names no session, or with another relation, are ignored.
    """
    rec = recordings.select("rec_id", session_key(F.col("dataset_name"), F.col("session"), F.col("audio_path")).alias("s")).where("rec_id is not null")
    rec = cut(rec.groupBy("rec_id", "s").agg(F.count(F.lit(1)).alias("rows")))
    links = session_links.where(F.lower(F.trim("relation")).isin(*SAME_CALL)).select(
        session_key(F.col("dataset_name"), F.col("session")).alias("u"), session_key(F.col("linked_dataset_name"), F.col("linked_session")).alias("v")
    )
    several = cut(rec.groupBy("rec_id").agg(F.min("s").alias("u"), F.max("s").alias("_x"), F.sum("rows").alias("rows")))
    joined = rec.join(several.where("u <> _x").select("rec_id", "u"), "rec_id").select("u", F.col("s").alias("v"))
    labels = components(links.unionByName(joined), seed=seed)
    by_session = rec.where("s is not null").groupBy("s").agg(F.min("rec_id").alias("lo"), F.max("rec_id").alias("hi"))
    grouped = by_session.join(labels, F.col("s") == F.col("vertex"), "left").select("s", "lo", "hi", F.coalesce("label", "s").alias("g"))
    groups = grouped.groupBy("g").agg(F.min("lo").alias("group_id"), F.max("hi").alias("hi"))
    of_session = lookup(grouped.select("s", "g"), groups, "g").select(F.col("s").alias("u"), "group_id", (F.col("group_id") < F.col("hi")).alias("many"))
    one = several.select("rec_id", "u", "rows")
    return lookup(one, of_session, "u").select("rec_id", F.coalesce("group_id", "rec_id").alias("group_id"), "rows", F.coalesce("many", F.lit(False)).alias("many"))


def assign_splits(groups: DataFrame, targets: DataFrame, seed: int = 1234) -> DataFrame:
    """(group_id, split) for groups with a ``weight``, so that the weights of the splits come near the shares.

    Groups heavier than HEAVY_PART of the smallest share (a number of groups bounded by the shares, not by the data)
    are placed one by one, heaviest first, where most is missing. All others stand in hashed order, and the running
    weight, in proportion to what each split still lacks, cuts that line into the splits. Shares that are null or not
    above 0 get nothing; the others are scaled to sum to 1. No targets: every split is null. No groups: no rows.
    """
    stated = targets.select("split", "share").limit(MOST_TARGETS + 1).collect()
    if len(stated) > MOST_TARGETS:
        raise ValueError("split_targets has one row for each split")
    shares = sorted(((r["split"], r["share"]) for r in stated if r["split"] is not None and r["share"] is not None and r["share"] > 0), key=lambda x: (-x[1], x[0]))
    if not shares:
        return groups.select("group_id", F.lit(None).cast("string").alias("split"))
    whole = sum(s for _, s in shares)
    total = groups.agg(F.sum("weight")).first()[0] or 0
    limit = total * HEAVY_PART * max(min(s for _, s in shares) / whole, LEAST_SHARE)
    missing = {name: total * s / whole for name, s in shares}
    placed = []
    for r in sorted(groups.where(F.col("weight") > limit).select("group_id", "weight").collect(), key=lambda r: (-r["weight"], r["group_id"])):
        name = max(missing, key=lambda k: missing[k])
        missing[name] -= r["weight"]
        placed.append((r["group_id"], name))
    spark = groups.sparkSession
    heavy = spark.createDataFrame(placed, groups.select("group_id", F.lit("").alias("split")).schema)
    light = groups.where(F.col("weight") <= limit).withColumn("_h", F.xxhash64(F.lit(seed), F.col("group_id")))
    light = running_total(light, [], "_h", "weight", "_before", ties=("group_id",))
    room = sum(max(m, 0) for m in missing.values()) or 1
    at, split = 0.0, F.lit(shares[0][0])
    middle = F.col("_before") + F.col("weight") / 2
    left = sum(m for m in missing.values())
    for name, _ in shares:
        split = F.when(middle >= F.lit(at * left / room), F.lit(name)).otherwise(split) if missing[name] > 0 else split
        at += max(missing[name], 0)
    return heavy.unionByName(light.select("group_id", split.alias("split")))


def split_records(recordings: DataFrame, session_links: DataFrame, targets: DataFrame, seed: int = 1234) -> DataFrame:
    """(rec_id, group_id, rows, split): one row for each rec_id."""
    rec = cut(record_groups(recordings, session_links, seed))
    groups = cut(rec.groupBy("group_id").agg(F.sum("rows").alias("weight")))
    return lookup(rec, assign_splits(groups, targets, seed), "group_id", hot=hot_keys(rec, "group_id")).select("rec_id", "group_id", "rows", "split")
