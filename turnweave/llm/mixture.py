"""Mixing sources to target weights (problem 7).

Sizes are tokens of the public byte-level BPE. Weights go down a tree of domain, source and language: a domain weighs
what its sources weigh, a source what its target says, a language what its documents hold. Budgets are shared out from
the root by weight; a node takes at most what its documents give when repeated as often as allowed, and what it can't
take goes to its siblings first (other languages of the source, then other sources of the domain) and to other domains
last. Languages stand below sources, because the targets are stated for sources.

Each leaf is filled from seeded epochs: whole epochs as often as they fit, then the prefix of a reshuffled epoch up to
the budget. An epoch's order is hashed; its running totals are taken in buckets of the hash, so no leaf is sorted in
one task.

The total is the caller's: either in tokens or as a number of passes over the targeted sources. It doesn't depend on
the scarcest source: what a source can't give is made up by its siblings, then by other domains, and the report says
what was reached.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnweave.llm.tokenize import count_tokens
from turnweave.operators.cumulate import running_total
from turnweave.runtime import cut

#: The domain of each source; a source not named here is a domain of its own.
DOMAINS = {
    "phone_transcripts": "speech", "interview_notes": "speech", "read_prompts": "speech", "subtitle_drafts": "speech",
    "task_chats": "written", "forum_posts": "written",
    "annotator_guides": "reference", "topic_cards": "reference", "corpus_pages": "reference",
}
#: Languages with a leaf of their own; all others, wrong and missing ones share a leaf.
LANGUAGES = ("en", "de", "fr", "es")
#: mix_targets has one row for each source; more than this many are refused.
MOST_TARGETS = 10_000


def source_key(name: Column) -> Column:
    """A source however it is spelled: lower case, letters and digits, one underscore for what stands between."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def fill(budget: float, nodes: dict[str, tuple[float, float]]) -> dict[str, float]:
    """``budget`` shared out to nodes (weight, capacity) by weight, none above its capacity, until all is placed or
    all are full."""
    got = dict.fromkeys(nodes, 0.0)
    open_ = {k for k, (w, c) in nodes.items() if w > 0 and c > 0}
    while open_ and budget > 1e-9:
        whole = sum(nodes[k][0] for k in open_)
        full = {k for k in open_ if got[k] + budget * nodes[k][0] / whole >= nodes[k][1]}
        if not full:
            for k in open_:
                got[k] += budget * nodes[k][0] / whole
            return got
        for k in full:  # these are filled; the others share again what is left
            budget -= nodes[k][1] - got[k]
            got[k] = nodes[k][1]
        open_ -= full
    return got


def budgets(leaves: list[tuple[str, str, int]], targets: dict[str, tuple[float, int]], total: float) -> dict[tuple[str, str], float]:
    """Token budget of each (source, language) leaf; ``leaves``: (source, language, tokens)."""
    tree: dict[str, dict[str, dict[str, int]]] = defaultdict(lambda: defaultdict(dict))
    for source, language, tokens in leaves:
        if source in targets:
            tree[DOMAINS.get(source, source)][source][language] = tokens
    for source in targets:
        tree[DOMAINS.get(source, source)][source]
    room = lambda source: sum(tree[DOMAINS.get(source, source)][source].values()) * targets[source][1]
    by_domain = fill(total, {d: (sum(targets[s][0] for s in ss), sum(room(s) for s in ss)) for d, ss in tree.items()})
    out = {}
    for d, sources in tree.items():
        by_source = fill(by_domain[d], {s: (targets[s][0], room(s)) for s in sources})
        for s, languages in sources.items():
            for language, b in fill(by_source[s], {k: (float(n), float(n * targets[s][1])) for k, n in languages.items()}).items():
                out[s, language] = b
    return out


def mix(docs: DataFrame, mix_targets: DataFrame, total_tokens: int | None = None, passes: float = 1.0, path: str | None = None, seed: int = 1234) -> tuple[DataFrame, DataFrame]:
    """(drawn, shares).

    drawn: (doc_id, source, lang, n_tokens, uses), one row for each document used, ``uses`` at most the source's
    ``max_repeats``. shares: (source, target_share, share, tokens, available_tokens, documents), one row for each
    source of ``mix_targets``, sources without documents included.

    The mixture has ``total_tokens`` tokens; without it, ``passes`` times as many as all documents of the targeted
    sources hold together. A source that can't give its share is used as often as it may be and the rest is
    redistributed; if all sources together can't fill the total, all are used up. Documents with null or empty texts
    and texts without tokens, and those whose source is null or not targeted, are never drawn. A doc_id delivered
    twice is used as the one with the most tokens. Targets with a null source, a share that is null or not above 0, or
    max_repeats below 1 give nothing; repeated targets count once, the largest share. Empty tables give no rows drawn.
    """
    goals: dict[str, tuple[float, int]] = {}
    stated = mix_targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats").limit(MOST_TARGETS + 1).collect()
    if len(stated) > MOST_TARGETS:
        raise ValueError("mix_targets has one row for each source")
    for r in stated:
        if r["source"] and r["target_share"] and r["target_share"] > 0:
            goals[r["source"]] = max(goals.get(r["source"], (0.0, 0)), (float(r["target_share"]), max(r["max_repeats"] or 0, 0)))
    lang = F.lower(F.trim("lang"))
    d = docs.select("doc_id", source_key(F.col("source")).alias("source"), F.when(lang.isin(*LANGUAGES), lang).otherwise("und").alias("lang"), "text")
    d = d.where(F.col("source").isin(*goals) & F.col("doc_id").isNotNull() & (F.col("text") != ""))
    sized = count_tokens(d, path=path).where("n_tokens > 0")
    sized = cut(sized.groupBy("doc_id").agg(F.max_by(F.struct("source", "lang", "n_tokens"), F.struct("n_tokens", "source", "lang")).alias("x")).select("doc_id", "x.*"))
    have = {(r["source"], r["lang"]): r["n"] for r in sized.groupBy("source", "lang").agg(F.sum("n_tokens").alias("n")).collect()}
    avail = defaultdict(int)
    for (s, _), n in have.items():
        avail[s] += n
    total = sum(avail.values()) * passes if total_tokens is None else total_tokens
    plan = budgets([(s, k, n) for (s, k), n in have.items()], goals, total)
    rows = [(s, k, int(b // have[s, k]), b - b // have[s, k] * have[s, k], goals[s][1]) for (s, k), b in plan.items() if have.get((s, k))]
    spark = docs.sparkSession
    leaf = spark.createDataFrame(rows, "source string, lang string, epochs int, rest double, most int")
    one = sized.join(F.broadcast(leaf), ["source", "lang"]).withColumn("_h", F.xxhash64(F.lit(seed), F.col("epochs"), F.col("doc_id")))
    cum = running_total(one, ["source", "lang"], "_h", "n_tokens", "_before", ties=("doc_id",))
    again = (F.col("_before") + F.col("n_tokens") / 2 <= F.col("rest")) & (F.col("epochs") < F.col("most"))
    drawn = cum.withColumn("uses", F.col("epochs") + again.cast("int")).where("uses > 0").select("doc_id", "source", "lang", "n_tokens", "uses")
    drawn = cut(drawn)
    got = drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.count(F.lit(1)).alias("documents"))
    want = spark.createDataFrame([(s, w, avail[s]) for s, (w, _) in goals.items()], "source string, target_share double, available_tokens bigint")
    whole = got.agg(F.sum("tokens").alias("_all"))
    shares = want.join(F.broadcast(got), "source", "left").crossJoin(F.broadcast(whole)).select(
        "source", "target_share", F.coalesce(F.round(F.col("tokens") / F.col("_all"), 6), F.lit(0.0)).alias("share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), "available_tokens", F.coalesce("documents", F.lit(0)).alias("documents")
    )
    return drawn, shares
