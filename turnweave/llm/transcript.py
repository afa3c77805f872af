"""Speech transcripts into clean speaker turns (problem 4).

Each line is read once, before any shuffle: an Aho-Corasick automaton finds speaker labels, hesitations, known sound
marks and the openings of markup; rules on the surroundings decide what a match is (``uh`` in ``uh-huh`` is none,
``[a]`` is a label only at the head of a line, ``{word}`` is a coinage in one corpus and a sound in another); the
spans to leave out are subtracted from the text. What is shuffled is small: keys, speaker, times and clean text.

Of the rows with one session, reel and line_no the last loaded is kept; lines that give neither time nor speaker are
added to the line before; lines without a spoken word are dropped; runs of lines of one speaker in order of start
become turns. Reels are cut into buckets of line numbers and of time, so a reel of any length is shared by tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnweave.operators.islands import merge_runs
from turnweave.runtime import carry_over_buckets, cut, ship

LINES_IN_BUCKET = 1024
SECONDS_IN_BUCKET = 1800

#: Spellings of the two speakers, letters and digits only, lower case.
SPEAKER_A = ("a", "0", "speakera", "speaker0", "spka", "spk0", "ch0", "cha", "channel0", "channela", "agent")
SPEAKER_B = ("b", "1", "speakerb", "speaker1", "spkb", "spk1", "ch1", "chb", "channel1", "channelb", "user")

#: Labels at the head of a text, lower case: a letter before a colon or in brackets, a role likewise, and what names a
#: speaker or channel by letter or digit, however the two are joined. A digit alone is none: it may begin a clock time.
LABELS = {
    form: who
    for who, letter, digit, role in (("A", "a", "0", "agent"), ("B", "b", "1", "user"))
    for name in (letter, role, *(f"{stem}{sep}{x}" for stem in ("speaker", "spk", "channel", "ch") for sep in ("", " ", "_", "-") for x in (letter, digit)))
    for form in (f"{name}:", f"[{name}]", f"<{name}>", f"({name})", f"[{name}]:", f"<{name}>:", f"({name}):")
}

#: Sound marks of the corpora, lower case.
MARKS = (
    "[noise]", "[vocalized-noise]", "[laughter]", "[silence]", "[breathing]", "[sigh]", "[cough]", "[mn]", "[[skip]]", "[skip]",
    "[distortion]", "[static]", "[crosstalk]", "[pause]", "[background]", "[lipsmack]", "[breath]", "[sneeze]",
    "{breath}", "{laugh}", "{cough}", "{lipsmack}", "{sneeze}", "{sigh}", "(laughs)", "(laughter)", "(inaudible)", "(coughs)", "(sighs)",
    "*sigh*", "*sighs*", "*laughs*", "*laugh*", "*cough*", "*coughs*", "*breath*", "*clears throat*", "*sniff*", "*gasp*", "*chuckles*",
    "<cough>", "<laugh>", "<sneeze>", "<b_aside>", "<e_aside>", "//static//", "♪", "♫",
)

#: Sounds that stars enclose; any other word between stars is stressed.
STARRED = frozenset(m.strip("*") for m in MARKS if m[0] == "*")

#: What opens markup whose meaning its content decides.
OPENINGS = ("[", "{", "((", "(", "<", "//", "*")


def hesitations() -> list[str]:
    """um, uhm, uh, er, erm, hm, eh, mm with up to four repetitions of a letter."""
    r = range(1, 5)
    forms = {"u" * i + "h" * j + "m" * k for i in r for j in r for k in range(5)} | {"u" * i + "m" * j for i in r for j in r}
    forms |= {"e" * i + "r" * j + "m" * k for i in (1, 2, 3) for j in r for k in range(5)} | {"h" * i + "m" * j for i in (1, 2, 3) for j in r}
    forms |= {"e" * i + "h" * j + "m" * k for i in (1, 2) for j in (1, 2, 3) for k in range(4)} | {"m" * i for i in (2, 3, 4)}
    forms |= {"äh", "ähm", "öh", "euh"}
    return sorted(forms - {"err", "uhu"})


#: The same forms with any number of repetitions; the automaton holds those up to four.
_HESITATION = re.compile(r"(?<![^\W_])(?:u++(?:h++m*+|m++)|e++(?:r++|h++)m*+|h++m++|m{5,}+)")


@lru_cache(maxsize=1)
def _listed() -> frozenset[str]:
    return frozenset(hesitations()) | {"err"}


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for form, who in LABELS.items():
        a.add_word(form, ("label", len(form), who))
    for m in MARKS:
        a.add_word(m, ("mark", len(m), None))
    for h in hesitations():
        a.add_word(h, ("hesitation", len(h), None))
    for o in OPENINGS:
        a.add_word(o, ("open", len(o), o))
    a.make_automaton()
    return a


_CLOCK = r"(?:\d+:)?\d+:\d+(?:\.\d+)?"
_PAIRS = re.compile(
    rf"\s*(?:\[\s*({_CLOCK}|\d+\.\d+)\s*-->\s*({_CLOCK}|\d+\.\d+)\s*\]|<\s*({_CLOCK}|\d+(?:\.\d+)?)\s*-\s*({_CLOCK}|\d+(?:\.\d+)?)\s*>"
    rf"|\(\s*({_CLOCK})\s*-\s*({_CLOCK})\s*\)|(\d+\.\d+)\s+(\d+\.\d+)(?=\s|$))\s*"
)
_TIME = re.compile(rf"\s*(?:t\s*=\s*)?(?:{_CLOCK}|\d+(?:\.\d+)?)\s*s?\s*(?:-+>?\s*(?:{_CLOCK}|\d+(?:\.\d+)?)\s*)?s?\s*")
_SPACE = re.compile(r"\s+")
_NUMBERED = re.compile(r"(?<=\w)_\d+\b")
_CUT_OFF = re.compile(r"(?<=\w)-+(?=\s|$)|(?:^|(?<=\s))-+(?=\w)")
_SIGNS = re.compile(r"[&%+*\"“”„]|--+|(?:^|(?<=\s))[-–—.…,!?]+(?=\s|$)")
_END = re.compile(r"[,.…!?]*")
_STARRED = re.compile(r"\*([^*\s][^*]*)\*(?!\*)")


def seconds(clock: str) -> float:
    out = 0.0
    for part in clock.split(":"):
        out = out * 60 + float(part)
    return out


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def read_line(text: str, dataset: str) -> tuple[float | None, float | None, str | None, str, bool]:
    """(start, end, speaker, clean text, has a spoken word) of one raw line; what the text doesn't tell is None."""
    start = end = who = None
    at = 0
    if m := _PAIRS.match(text):
        start, end = (seconds(x) for x in m.groups() if x is not None)
        at = m.end()
    else:
        while at < len(text) and text[at].isspace():
            at += 1
    low = _lower(text)
    out: list[tuple[int, int]] = [(0, at)]
    head = at
    hits = [(e - v[1] + 1, e + 1, v) for e, v in automaton().iter(low)]
    hits += [(*m.span(), ("hesitation", len(m[0]), None)) for m in _HESITATION.finditer(low) if m[0] not in _listed()]
    found = sorted(hits, key=lambda x: (x[0], -x[1]))
    upto = at
    open_ended: set[str] = set()
    for s, e, (kind, _, value) in found:
        if s < upto:
            continue
        if kind == "label":
            if s == head and who is None:
                who, upto = value, e
                out.append((s, e))
        elif kind == "mark":
            out.append((s, e))
            upto = e
        elif kind == "hesitation":
            if (f := _hesitation(low, s, e)) is not None:
                out.append((s, f))
                upto = f
        else:
            if value in open_ended:
                out.append((s, e))
                upto = e
                continue
            spans, upto = _markup(low, s, value, dataset)
            if len(spans) == 1 and spans[0][1] - s == len(value) and value != "*":
                open_ended.add(value)  # it has no end, so no later one has
            out += spans
    kept, last = [], 0
    for s, e in sorted(out):
        if s > last:
            kept.append(text[last:s])
        elif s == last and e > s and last:
            kept.append("")
        last = max(last, e)
    kept.append(text[last:])
    clean = _NUMBERED.sub("", "".join(kept))
    if "-" in clean:
        clean = _CUT_OFF.sub("", clean)
    clean = _SPACE.sub(" ", _SIGNS.sub("", clean)).strip()
    return start, end, who, clean, any(c.isalnum() for c in clean)


def _hesitation(low: str, s: int, e: int) -> int | None:
    """Where a hesitation found at [s, e) ends with its punctuation, or None if it is part of a word."""
    before = low[s - 1] if s else " "
    if before.isalnum() or before in "_'’]}" or before == "-" and not low.endswith("[laughter-", 0, s) and s > 1 and low[s - 2].isalnum():
        return None
    n = len(low)
    f = e
    if f < n and low[f] == "_":
        while f < n and (low[f] == "_" or low[f].isdigit()):
            f += 1
    if f < n and low[f] == "-":
        if f + 1 < n and low[f + 1].isalnum():
            return None
        f += 1
    if f < n and (low[f].isalnum() or low[f] in "_'’[{" or low[f] == "/" and not low.startswith("//", f)):
        return None
    return _END.match(low, f).end()


def _markup(low: str, s: int, opening: str, dataset: str) -> tuple[list[tuple[int, int]], int]:
    """The spans to leave out of markup that opens at s, and where reading goes on."""
    n, o = len(low), len(opening)
    if opening == "*":
        if m := _STARRED.match(low, s):
            if m[1].strip() in STARRED:
                return [(s, m.end())], m.end()
        return [(s, s + 1)], s + 1
    if opening == "//":
        c = low.find("//", s + 2)
        return ([(s, c + 2)], c + 2) if c >= 0 else ([(s, s + 2)], s + 2)
    if opening == "((":
        c = low.find("))", s + 2)
        return ([(s, s + 2), (c, c + 2)], s + 2) if c >= 0 else ([(s, s + 2)], s + 2)
    close = {"[": "]", "{": "}", "(": ")", "<": ">"}[opening]
    c = low.find(close, s + 1)
    if c < 0:
        return [(s, s + 1)], s + 1
    inside = low[s + 1 : c]
    whole = [(s, c + 1)], c + 1
    if opening == "[":
        attached = s and (low[s - 1].isalnum() or low[s - 1] == "'")
        if s and low[s - 1] == "-" and (s == 1 or low[s - 2].isspace()):
            return [(s - 1, s + 1), (c, c + 1)], s + 1  # -[th]at
        if attached or c + 1 < n and low[c + 1].isalnum():
            return [(s, s + 1), (c, c + 1)], s + 1  # w[ent]
        if inside.startswith("laughter-") and len(inside) > 9:
            return [(s, s + 10), (c, c + 1)], s + 10
        said, slash, meant = inside.partition("/")
        if slash and said and meant and " " not in said:
            return [(s, s + 2 + len(said)), (c, c + 1)], s + 2 + len(said)
        if inside.startswith("["):
            c = low.find("]]", s)
            return ([(s, c + 2)], c + 2) if c >= 0 else whole
        return whole
    if opening == "{":
        return ([(s, s + 1), (c, c + 1)], s + 1) if dataset == "switchboard" and inside.isalnum() else whole
    if opening == "(":
        return whole if dataset == "vacation_interview" or _TIME.fullmatch(inside) else ([(s, s + 1), (c, c + 1)], s + 1)
    name, blank, rest = inside.partition(" ")
    if blank and name.isalpha() and rest.strip():
        return [(s, s + 1 + len(name)), (c, c + 1)], s + 1 + len(name)  # <German word>
    return whole


def speaker_of(label: Column) -> Column:
    """A or B for a label however it is spelled, null for others."""
    s = F.lower(F.regexp_replace(label, "[^A-Za-z0-9]", ""))
    return F.when(s.isin(*SPEAKER_A), F.lit("A")).when(s.isin(*SPEAKER_B), F.lit("B"))


def read_lines(transcripts: DataFrame, with_text: bool = True) -> DataFrame:
    """(session, reel, line_no, line_id, loaded_at, speaker, start, end, text, spoken) of every delivered row; without
    its text, which is then empty, a row takes little of the shuffles that follow."""
    import pyarrow as pa

    ship(transcripts.sparkSession)
    words = F.array_sort(F.filter("words", lambda w: w["word"].isNotNull()), lambda a, b: F.when(_less(a["start"], b["start"]), -1).when(_less(b["start"], a["start"]), 1).otherwise(0))
    number = lambda c: F.when(~F.isnan(c), F.col(c))
    t = transcripts.select(
        "session", "reel", "line_no", "line_id", "loaded_at", F.lower(F.trim("dataset_name")).alias("dataset"), speaker_of(F.col("speaker")).alias("speaker"),
        number("start").alias("cs"), number("end").alias("ce"), F.array_min(F.transform(words, lambda w: w["start"])).alias("ws"), F.array_max(F.transform(words, lambda w: w["end"])).alias("we"),
        F.coalesce("text", F.array_join(F.transform(words, lambda w: w["word"]), " "), F.lit("")).alias("raw"),
    )
    keep = ["session", "reel", "line_no", "line_id", "loaded_at", "speaker", "cs", "ce", "ws", "we"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in t.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [read_line(x, d or "") for x, d in zip(b.column("raw").to_pylist(), b.column("dataset").to_pylist())]
            cols = list(zip(*got)) if got else [()] * 5
            if not with_text:
                cols[3] = ("",) * len(got)
            new = [pa.array(c, k) for c, k in zip(cols, (pa.float64(), pa.float64(), pa.string(), pa.string(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *new], names=[*keep, "ts", "te", "label", "clean", "spoken"])

    r = t.mapInArrow(run, schema + ", ts double, te double, label string, clean string, spoken boolean")
    pick = lambda a, b: F.when(F.col(f"c{a}").isNotNull() & F.col(f"c{b}").isNotNull(), F.col(f"c{a}")).when(F.col(f"t{a}").isNotNull(), F.col(f"t{a}")).otherwise(F.coalesce(f"c{a}", f"w{a}", f"c{b}", f"w{b}"))
    return r.select(
        "session", "reel", "line_no", "line_id", "loaded_at", F.coalesce("speaker", "label").alias("speaker"),
        pick("s", "e").alias("start"), pick("e", "s").alias("end"), F.col("clean").alias("text"), "spoken",
    )


def _less(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(float("-inf"))) < F.coalesce(b, F.lit(float("-inf")))


def lines(transcripts: DataFrame, with_text: bool = True) -> DataFrame:
    """(session, reel, line_no, speaker, start, end, text): the lines that hold, continued lines joined.

    A spoken word somewhere, a speaker and a time are needed. Rows with a null line_no are lines of their own that
    continue nothing; null sessions and reels are keys like any other.
    """
    r = cut(read_lines(transcripts, with_text))  # read below in several ways, and the texts are to be read once
    numbered = r.where("line_no is not null").withColumn("b", F.floor(F.col("line_no") / LINES_IN_BUCKET))
    value = F.struct("speaker", "start", "end", "text", "spoken")
    k = ["session", "reel"]
    last = numbered.groupBy(*k, "b", "line_no").agg(F.max_by(value, F.struct("loaded_at", "line_id")).alias("v")).select(*k, "b", "line_no", "v.*")
    last = last.withColumn("head", F.when(F.col("speaker").isNotNull() | F.col("start").isNotNull(), F.col("line_no")))
    before = carry_over_buckets(last.groupBy(*k, "b").agg(F.max("head").alias("h")), k, "b", {"earlier": (F.col("h"), "last_before")})
    w = Window.partitionBy(*k, "b").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    held = last.withColumn("of", F.last("head", ignorenulls=True).over(w))
    held = held.join(before.select(F.col("session").alias("_s"), F.col("reel").alias("_r"), F.col("b").alias("_b"), "earlier"), F.col("session").eqNullSafe(F.col("_s")) & F.col("reel").eqNullSafe(F.col("_r")) & (F.col("b") == F.col("_b")))
    held = held.withColumn("of", F.coalesce("of", "earlier")).where("of is not null")
    is_head = F.col("head") == F.col("of")
    one = held.groupBy(*k, "of").agg(
        *(F.max(F.when(is_head, F.col(c))).alias(c) for c in ("speaker", "start", "end")),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("line_no", "text")))), lambda x: x["text"]), " ").alias("text"),
        F.max("spoken").alias("spoken"),
    )
    loose = r.where("line_no is null").select(*k, F.lit(None).cast(r.schema["line_no"].dataType).alias("of"), "speaker", "start", "end", "text", "spoken")
    return one.unionByName(loose).where("spoken and speaker is not null and start is not null").select(*k, F.col("of").alias("line_no"), "speaker", "start", F.greatest("start", F.coalesce("end", "start")).alias("end"), "text")


def turns(transcripts: DataFrame, with_text: bool = True) -> DataFrame:
    """(session, reel, speaker, start_ms, end_ms[, text]): maximal runs of lines of one speaker in order of start.

    Lines with one start stand in order of line_no. A turn reaches from its first start to its greatest end, in whole
    milliseconds, rounded. An empty table gives no rows; other columns of the input are ignored.
    """
    t = lines(transcripts, with_text)
    aggs = {"s": ("min", "start"), "e": ("max", "end")} | ({"text": ("text", "text")} if with_text else {})
    m = merge_runs(t, ["session", "reel"], ["start", "line_no"], "speaker", F.floor(F.col("start") / SECONDS_IN_BUCKET), aggs)
    return m.select("session", "reel", "speaker", *(F.round(F.col(c) * 1000).cast("long").alias(n) for c, n in (("s", "start_ms"), ("e", "end_ms"))), *(["text"] if with_text else []))
