"""Queries of the operators for training data, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnweave.llm import mixture, overlap, pieces, residue, splits, tokenize, transcript
from turnweave.runtime import table

Query = Callable[[SparkSession, str], DataFrame]

#: Size of the mixture of the p7 queries in passes over the targeted sources. At more than one pass sources without
#: repeats run short, so that redistribution among siblings and between domains is part of what is run.
MIX_PASSES = 1.2


def _p1_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_records(table(spark, d, "recordings"), table(spark, d, "session_links"), table(spark, d, "split_targets"))


def _p1_shares(spark: SparkSession, d: str) -> DataFrame:
    got = _p1_splits(spark, d).groupBy("split").agg(F.sum("rows").alias("rows"), F.countDistinct("group_id").alias("groups"))
    whole = got.agg(F.sum("rows").alias("_all"))
    return got.crossJoin(F.broadcast(whole)).select("split", "rows", "groups", F.round(F.col("rows") / F.col("_all"), 6).alias("share"))


def _p1_kept(spark: SparkSession, d: str) -> DataFrame:
    """Records placed, groups torn apart, records in no split; in one row."""
    r = _p1_splits(spark, d)
    torn = r.groupBy("group_id").agg(F.countDistinct("split").alias("n")).agg(F.sum((F.col("n") > 1).cast("long")).alias("torn"))
    return r.agg(F.countDistinct("rec_id").alias("records"), F.sum(F.col("split").isNull().cast("long")).alias("unplaced")).crossJoin(F.broadcast(torn))


def _p2(spark: SparkSession, d: str, **more) -> DataFrame:
    return pieces.pieces(table(spark, d, "clips"), table(spark, d, "clip_limits"), **more)


def _p2_covered(spark: SparkSession, d: str) -> DataFrame:
    """Clips cut, pieces over the limit, and pieces that don't start the overlap before the end of the one before."""
    limits = table(spark, d, "clip_limits").select("dataset_name", "max_seconds", "overlap_seconds")
    of = table(spark, d, "clips").groupBy("clip_id").agg(F.max_by("dataset_name", "loaded_at").alias("dataset_name"))
    p = _p2(spark, d).join(of, "clip_id").join(F.broadcast(limits), "dataset_name")
    before = F.lag("end_sample").over(Window.partitionBy("clip_id").orderBy("piece"))  # a clip has few pieces
    p = p.withColumn("wrong", F.when(F.col("piece") == 0, F.col("start_sample") != 0).otherwise(F.col("start_sample") != before - F.ceil(F.col("overlap_seconds") * F.col("rate") - 1e-6)))
    long = F.col("end_sample") - F.col("start_sample") > F.col("max_seconds") * F.col("rate") + 1e-6
    return p.agg(F.countDistinct("clip_id").alias("clips"), F.sum(long.cast("long")).alias("too_long"), F.sum(F.col("wrong").cast("long")).alias("wrong"))


def _p2_samples(spark: SparkSession, d: str) -> DataFrame:
    """The pieces with their audio, summed up: channels, samples of the longest and energy."""
    p = _p2(spark, d, with_samples=True)
    energy = F.aggregate(F.flatten("samples"), F.lit(0.0), lambda a, v: a + F.coalesce(v * v, F.lit(0.0)))
    return p.select("clip_id", "piece", F.size("samples").alias("channels"), F.array_max(F.transform("samples", F.size)).alias("longest"), F.round(energy, 4).alias("energy"))


def _p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents, and those whose ids give their text again; null is read as empty."""
    t = table(spark, d, "documents").select("text", F.coalesce("text", F.lit("")).alias("original"))
    back = tokenize.decode(tokenize.encode(t))
    return back.agg(F.count(F.lit(1)).alias("documents"), F.sum((F.col("text") == F.col("original")).cast("long")).alias("equal"))


def _p7(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixture.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), passes=MIX_PASSES)


def _p7_sums(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of any mixture, in one row: sources and shares reported, draws beyond the limit or of other
    sources than their document's."""
    drawn, shares = _p7(spark, d)
    t = table(spark, d, "mix_targets").select(mixture.source_key(F.col("source")).alias("source"), "max_repeats")
    docs = table(spark, d, "documents").select("doc_id", mixture.source_key(F.col("source")).alias("of"))
    over = drawn.join(F.broadcast(t), "source").where("uses > max_repeats or uses < 1").agg(F.count(F.lit(1)).alias("over"))
    other = drawn.join(docs, "doc_id", "left").where("of is null or of <> source").agg(F.count(F.lit(1)).alias("other"))
    one = shares.agg(F.count(F.lit(1)).alias("sources"), F.round(F.sum("target_share"), 6).alias("target"), F.round(F.sum("share"), 4).alias("share"))
    return one.crossJoin(F.broadcast(over)).crossJoin(F.broadcast(other))


def queries() -> dict[str, Query]:
    t = table
    return {
        "p1_found": lambda s, d: splits.record_groups(t(s, d, "recordings"), t(s, d, "session_links")).where("many").select("rec_id", "group_id"),
        "p1_splits": _p1_splits,
        "p1_shares": _p1_shares,
        "p1_kept": _p1_kept,
        "p2_found": lambda s, d: pieces.found(t(s, d, "clips"), t(s, d, "clip_limits")),
        "p2_pieces": _p2,
        "p2_covered": _p2_covered,
        "p2_samples": _p2_samples,
        "p4_found": lambda s, d: transcript.turns(t(s, d, "transcripts"), with_text=False),
        "p4_turns": lambda s, d: transcript.turns(t(s, d, "transcripts")),
        "p5_found": lambda s, d: overlap.found(t(s, d, "text_dialogs")),
        "p5_report": lambda s, d: overlap.report(t(s, d, "text_dialogs")),
        "p6_ids": lambda s, d: tokenize.encode(t(s, d, "documents").select("doc_id", "text")),
        "p6_round_trip": _p6_round_trip,
        "p7_mix": lambda s, d: _p7(s, d)[0],
        "p7_shares": lambda s, d: _p7(s, d)[1],
        "p7_sums": _p7_sums,
        "p8_found": lambda s, d: residue.found(t(s, d, "documents")),
        "p8_report": lambda s, d: residue.report(t(s, d, "documents")),
    }


def _key_sql(dataset: str, session: str, path: str | None = None) -> str:
    s = f"lower(translate({session}, '０１２３４５６７８９', '0123456789'))"
    letters = f"regexp_replace(lower({dataset}), '[^a-z]', '', 'g')"
    prefix = f"CASE left({letters}, 2) WHEN 'sw' THEN 'sw' WHEN 'fi' THEN 'fe' WHEN 'fs' THEN 'fe' WHEN 'fe' THEN 'fe' WHEN 'ca' THEN 'ch' WHEN 'ch' THEN 'ch' WHEN 'va' THEN 'vi' WHEN 'vi' THEN 'vi' END"
    named, bare, filed = "(?:^|[^a-z])(sw|fe|ch|vi)[ _-]*0*([0-9]+)", r"^\s*0*([0-9]+)\s*$", r"(?:^|/)(sw|fe_|ch_|vi_)0*([0-9]+)_[0-9]+\.[a-z0-9]+\s*$"
    out = f"CASE WHEN regexp_matches({s}, '{named}') THEN regexp_extract({s}, '{named}', 1) || ':' || regexp_extract({s}, '{named}', 2) WHEN regexp_matches({s}, '{bare}') AND ({prefix}) IS NOT NULL THEN ({prefix}) || ':' || regexp_extract({s}, '{bare}', 1)"
    if path:
        p = f"lower(translate({path}, '０１２３４５６７８９', '0123456789'))"
        out += f" WHEN regexp_matches({p}, '{filed}') THEN left(regexp_extract({p}, '{filed}', 1), 2) || ':' || regexp_extract({p}, '{filed}', 2)"
    return out + " END"


#: Clips over their limit with limits in samples, and the stretches of boundaries that lie in a pause.
_CLIPS_SQL = """
last AS (SELECT * FROM clips QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY loaded_at DESC) = 1),
sized AS (SELECT clip_id, vad, waveform, coalesce(sample_rate, default_rate) AS rate, max_seconds, overlap_seconds, list_max(list_transform(waveform, lambda c: len(c))) AS n FROM last JOIN clip_limits USING (dataset_name) WHERE clip_id IS NOT NULL AND waveform IS NOT NULL),
over AS (SELECT *, CAST(floor(max_seconds * rate + 1e-6) AS BIGINT) AS most, CAST(ceil(overlap_seconds * rate - 1e-6) AS BIGINT) AS ov FROM sized WHERE n > max_seconds * rate + 1e-9)"""
_PAUSES_SQL = """
ch AS (SELECT clip_id, unnest(vad) AS segs FROM over WHERE vad IS NOT NULL), sg AS (SELECT clip_id, unnest(segs) AS s FROM ch),
pr AS (SELECT clip_id, greatest(least(s[1], s[2]), 0) AS a, greatest(s[1], s[2]) AS b FROM sg WHERE len(s) = 2 AND isfinite(s[1]) AND isfinite(s[2]) AND greatest(s[1], s[2]) > greatest(least(s[1], s[2]), 0)),
rk AS (SELECT *, coalesce(max(b) OVER (PARTITION BY clip_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto FROM pr),
quiet0 AS (SELECT clip_id, rate, waveform, unnest(range(n)) AS i FROM over WHERE vad IS NULL),
quiet1 AS (SELECT clip_id, rate, i FROM quiet0 WHERE len(list_filter(waveform, lambda c: len(c) > i AND coalesce(abs(c[i + 1]) >= CAST(0.01 AS FLOAT), true))) = 0),
quiet2 AS (SELECT clip_id, rate, i, i - row_number() OVER (PARTITION BY clip_id ORDER BY i) AS g FROM quiet1),
gap AS (SELECT clip_id, upto AS a, a AS b FROM rk WHERE a > upto
        UNION ALL SELECT o.clip_id, coalesce(m.b, 0), greatest(o.n / o.rate, coalesce(m.b, 0)) FROM over o LEFT JOIN (SELECT clip_id, max(b) AS b FROM pr GROUP BY clip_id) m USING (clip_id) WHERE o.vad IS NOT NULL
        UNION ALL SELECT clip_id, min(i) / max(rate), (max(i) + 1) / max(rate) FROM quiet2 GROUP BY clip_id, g),
pause AS (SELECT g.clip_id, CAST(ceil(a * rate - 1e-6) AS BIGINT) AS lo, CAST(floor(least(b * rate, n) + 1e-6) AS BIGINT) AS hi FROM gap g JOIN over o USING (clip_id) WHERE b - a >= 0.2 - 1e-9),
step AS (SELECT clip_id, CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS last FROM over WHERE ov < most
         UNION SELECT s.clip_id, max(least(p.hi, s.start + o.most)) - any_value(o.ov), max(least(p.hi, s.start + o.most)) FROM step s JOIN over o ON o.clip_id = s.clip_id JOIN pause p ON p.clip_id = s.clip_id
         WHERE o.n - s.start > o.most AND least(p.hi, s.start + o.most) >= greatest(p.lo, s.last + 1, o.ov) GROUP BY s.clip_id, s.start, s.last)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_kept": "SELECT count(DISTINCT rec_id) AS records, CAST(0 AS BIGINT) AS unplaced, CAST(0 AS BIGINT) AS torn FROM recordings WHERE rec_id IS NOT NULL",
        "p2_found": f"WITH RECURSIVE {_CLIPS_SQL}, {_PAUSES_SQL} SELECT o.clip_id, CASE WHEN bool_or(o.n - s.start <= o.most) THEN 'pause' ELSE 'forced' END AS kind FROM over o LEFT JOIN step s ON s.clip_id = o.clip_id GROUP BY o.clip_id",
        "p2_covered": f"WITH {_CLIPS_SQL} SELECT count(*) AS clips, CAST(0 AS BIGINT) AS too_long, CAST(0 AS BIGINT) AS wrong FROM over",
        "p6_round_trip": "SELECT count(*) AS documents, count(*) AS equal FROM documents",
        "p7_sums": "SELECT count(*) AS sources, round(sum(target_share), 6) AS target, CAST(1 AS DOUBLE) AS share, CAST(0 AS BIGINT) AS over, CAST(0 AS BIGINT) AS other FROM mix_targets",
        "p1_found": f"""
WITH RECURSIVE rec AS (SELECT DISTINCT rec_id, coalesce({_key_sql("dataset_name", "session", "audio_path")}, 'r' || rec_id) AS s FROM recordings WHERE rec_id IS NOT NULL),
link AS (SELECT u, v FROM (SELECT {_key_sql("dataset_name", "session")} AS u, {_key_sql("linked_dataset_name", "linked_session")} AS v FROM session_links
                           WHERE lower(trim(relation)) IN ('same_call', 'rerelease_of', 'copy_of')) WHERE u IS NOT NULL AND v IS NOT NULL
         UNION SELECT a.s, b.s FROM rec a JOIN rec b USING (rec_id) WHERE a.s <> b.s),
edge AS (SELECT u, v FROM link UNION SELECT v, u FROM link),
reach AS (SELECT s AS a, s AS b FROM rec UNION SELECT reach.a, edge.v FROM reach JOIN edge ON reach.b = edge.u),
grp AS (SELECT a AS s, min(rec_id) AS lo, max(rec_id) AS hi FROM reach JOIN rec ON reach.b = rec.s GROUP BY a)
SELECT DISTINCT rec_id, lo AS group_id FROM rec JOIN grp USING (s) WHERE lo < hi""",
    }
