"""String functions: annotation clean-up chains, splitting, labels and paths, all as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java flags under which \w and \s are Unicode classes and only \n ends a line.
FLAGS = "(?Ud)"

#: Ordered rewrites of Switchboard text.
SWITCHBOARD_RULES = (
    (r"\[noise\]", ""),
    (r"\[vocalized-noise\]", ""),
    (r"\[laughter\]", ""),
    (r"\[laughter-(\w*)\]", "$1"),
    (r"\[laughter-(\w*'*\w*)\]", "$1"),
    (r"(\w+)\[(\w*'*\w*)\]", "$1$2"),
    (r"-\[(\w*'*\w*)\](\w+)", "$1$2"),
    (r"(\w+)-\s", "$1 "),
    (r"(\w+)-$", "$1"),
    (r"(\w+)_\d", "$1"),
    (r"\[\w+/(\w+)\]", "$1"),
    (r"\{(\w*)\}", "$1"),
    (r"\s\s+", " "),
    (r"^\s+|\s+$", ""),
)

#: Ordered rewrites of Callhome text; the first three are greedy.
CALLHOME_RULES = (
    (r"\{.*\}", ""),
    (r"\[\[.*\]\]", ""),
    (r"\[.*\]", ""),
    (r"\(\(\s*\)\)", ""),
    (r"\(\((\w*)\)\)", "$1"),
    (r"\(\(", ""),
    (r"\)\)", ""),
    (r"-(\w+)", "$1"),
    (r"(\w+)-", "$1"),
    (r"\+(\w*)\+", "$1"),
    (r"\*\*(\w*)\*\*", "$1"),
    (r"&(\w+)", "$1"),
    (r"%(\w+)", "$1"),
    (r"--", ""),
    (r"<\w*\s(\w*\s*\w*)>", "$1"),
    (r"\s\s+", " "),
    (r"^\s", ""),
)

#: Tokens that are noise by themselves.
NOISE_TOKENS = ("[silence]", "[noise]", "[vocalized-noise]")

#: Short feedback that doesn't take the turn.
BACKCHANNELS = ("uh-huh", "um-hum", "yeah", "right", "oh", "okay", "really", "yes", "huh", "oh yeah", "hum", "i see")

#: Labels of a classified turn change.
LABELS = {"backchannel": 0, "shift": 1, "hold": 2}


def rewrite(c: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The rewrites applied one after the other; null stays null."""
    return reduce(lambda x, r: F.regexp_replace(x, FLAGS + r[0], r[1]), rules, c)


def clean_switchboard(c: Column) -> Column:
    return rewrite(c, SWITCHBOARD_RULES)


def clean_callhome(c: Column) -> Column:
    return rewrite(c, CALLHOME_RULES)


def squeeze(c: Column) -> Column:
    """Tabs as blanks, runs of blanks as one."""
    return F.regexp_replace(F.regexp_replace(c, "\t", " "), FLAGS + r"\s\s+", " ")


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def has_word(c: Column) -> Column:
    return c.rlike(r"(?U)\w")


def is_noise(c: Column) -> Column:
    return c.isin(*NOISE_TOKENS) | (c == "")


def split_once(c: Column, sep: str = " ") -> tuple[Column, Column]:
    """Head and rest of a line; the rest is null where ``sep`` is missing."""
    parts = F.split(c, _literal(sep), 2)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def field(c: Column, i: int, n: int = -1, sep: str = " ") -> Column:
    """Field ``i`` (from 0) of a line split at ``sep`` into at most ``n`` fields; null beyond the last."""
    return F.get(F.split(c, _literal(sep), n), F.lit(i))


def join_first(c: Column, sep: str, n: int) -> Column:
    """The first ``n`` fields joined again: ``a-b-c`` -> ``a-b``."""
    return F.array_join(F.slice(F.split(c, _literal(sep)), 1, n), sep)


def _literal(sep: str) -> str:
    return "".join("\\" + ch if ch in r".|?*+()[]{}^$\-" else ch for ch in sep)


def zero_filled(c: Column, width: int) -> Column:
    """Decimal digits filled with zeros; longer numbers stay whole."""
    s = c.cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def swap_suffix(path: Column, old: str, new: str) -> Column:
    return F.regexp_replace(path, _literal(old) + "$", new)


def stem(path: Column) -> Column:
    """File name without folder and ending."""
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def channel_of(label: Column, strict: bool = False) -> Column:
    """Channel of a speaker code: A 0, B 1. Agent counts as A, user as B, a trailing colon is dropped.

    Not strict, everything else is 1 as well; strict, it is null.
    """
    s = F.regexp_replace(F.upper(strip(label)), r"[:.]$", "")
    zero = s.isin("A", "AGENT", "0")
    return F.when(zero, 0).when(s.isin("B", "USER", "1"), 1).otherwise(F.lit(None).cast("int") if strict else F.when(s.isNotNull(), 1))


def label_index(label: Column) -> Column:
    return F.create_map(*(x for k, v in LABELS.items() for x in (F.lit(k), F.lit(v))))[label]


def label_name(index: Column) -> Column:
    return F.create_map(*(x for k, v in LABELS.items() for x in (F.lit(v), F.lit(k))))[index]


def is_backchannel(text: Column) -> Column:
    return F.lower(strip(text)).isin(*BACKCHANNELS)


def fisher_disc(number: Column) -> Column:
    """Disc that holds a Fisher session: 1 below 800, then 900 to a disc."""
    return F.when(number < 800, F.lit(1)).otherwise(F.floor((number - 800) / 900) + 2).cast("int")


def fisher_audio_path(number: Column, root: str = "", ext: str = ".wav") -> Column:
    """Audio path of a session; folder and file names are fixed values of the corpus:
    fisher_eng_tr_sp_d<disc>/audio/<first three digits>/fe_03_<number><ext>."""
    n = zero_filled(number, 5)
    return F.concat(F.lit(root), F.lit("fisher_eng_tr_sp_d"), fisher_disc(number).cast("string"), F.lit("/audio/"), n.substr(1, 3), F.lit("/fe_03_"), n, F.lit(ext))


def fisher_transcript_path(number: Column, root: str = "") -> Column:
    """Transcript path of a session; fixed values of the corpus: fe_03_p1_tran/data/trans/<digits>/fe_03_<number>.txt."""
    n = zero_filled(number, 5)
    return F.concat(F.lit(root), F.lit("fe_03_p1_tran/data/trans/"), n.substr(1, 3), F.lit("/fe_03_"), n, F.lit(".txt"))
