"""Template residue, filler, error pages and notices about scripts in place of content (problem 8).

One pass over the whole texts, without a shuffle. A text is read letter by letter without regard to case, accents,
digits and kinds of blanks, position for position, so that one multi-pattern automaton finds everything in a single
scan: phrases of errors, stubs, filler and notices in four languages, the vocabulary around them, and the openers of all
placeholder syntaxes.

Residue: a sentence counts if it has a telling phrase, or a fault said of a web object, or a demand about scripts,
cookies or the browser, and if matched patterns cover at least half of its words; advice such as "please reload the
page" counts beside such a sentence. A document is residue if these sentences hold at least three quarters of its
words, a heading at its start and short lines at its end aside. Content that quotes or explains an error has too little
of its words covered.

Placeholders: at an opener the syntax is matched in place; a word that stands for a missing value counts only in the
slot of a value. Markup of sounds and coinages is told apart by the names that stand in it, and a placeholder that is
talked about (a template explained, a label mentioned) by the words around it.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.llm import residue_lexicon as L
from turnweave.runtime import ship

SENTENCE_SHARE, DOCUMENT_SHARE = 0.5, 0.75
HEADING_WORDS, FOOTER_WORDS, FOOTERS = 6, 4, 3
#: Filler: words of a sentence at least, share of pseudo-Latin words, repetitions of one word.
FILLER_WORDS, LATIN_SHARE, REPEATED = 4, 0.7, 10

STRONG, OBJECT, FAULT, SCRIPT, DEMAND, ADVICE, WEAK, KEY, LATIN, OPENER = (1 << i for i in range(10))
#: What makes a document worth reading sentence by sentence: one of these, or both kinds of a pair.
ALONE, PAIRS = STRONG | KEY | LATIN, ((FAULT, OBJECT), (DEMAND, SCRIPT))


def _letters() -> dict[int, str]:
    """Every character up to Latin Extended-B as its lower-case base letter, digits as 9, blanks as a blank."""
    out = {}
    for c in range(0x250):
        base = unicodedata.normalize("NFKD", chr(c))[0].lower()
        out[c] = "9" if base.isdigit() else base if len(base) == 1 else chr(c)
    return out | {ord("ß"): "s", ord("ı"): "i", ord("\t"): " ", ord("\r"): "\n", ord(" "): " ", ord(" "): " ", ord("’"): "'", ord("‘"): "'", ord("“"): '"', ord("”"): '"'}


_FOLD = _letters()
_MOJIBAKE = re.compile("[ÂÃâ][\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ¡-¿]{1,2}")
_WIDE = re.compile(r"[^\S\n]{2,}")


def _repair(m: re.Match) -> str:
    try:
        return m[0].encode("cp1252").decode("utf-8")
    except UnicodeError:
        return m[0]


def read(text: str) -> tuple[str, str]:
    """(the text with damage of its encoding mended and runs of blanks made one, the same letter for letter folded)."""
    if not text.isascii():
        if "Ã" in text or "â" in text:
            text = _MOJIBAKE.sub(_repair, text)
        if "​" in text:
            text = text.replace("​", "")
        text = unicodedata.normalize("NFC", text)
    if "&nbsp;" in text:
        text = text.replace("&nbsp;", " ")
    if "  " in text or "\t" in text:
        text = _WIDE.sub(" ", text)
    return text, text.translate(_FOLD)


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    flags: dict[str, int] = {}
    lists = ((L.STRONG, STRONG), (L.OBJECTS, OBJECT | WEAK), (L.FAULTS, FAULT), (L.SCRIPTS, SCRIPT | WEAK), (L.DEMANDS, DEMAND | WEAK), (L.ADVICE, ADVICE), (L.USUAL, WEAK), (L.KEYS, KEY), (L.LATIN - L.COMMON_LATIN, LATIN), (L.OPENERS, OPENER))
    for words, flag in lists:
        for w in words:
            w = w.translate(_FOLD)
            flags[w] = flags.get(w, 0) | flag
    a = ahocorasick.Automaton()
    for w, f in flags.items():
        # the value: kinds, length, whether a word must begin and end there (a number may go on)
        a.add_word(w, (f, len(w), w[0].isalnum() and not f & OPENER, w[-1].isalnum() and w[-1] != "9" and not f & OPENER))
    a.make_automaton()
    return a


def scan(low: str) -> tuple[list[tuple[int, int, int]], list[int], int]:
    """([(start, end, kinds)] of vocabulary, [positions of openers], all kinds met) of a folded text."""
    vocabulary, openers, met = [], [], 0
    n = len(low)
    for last, (kind, length, first_open, last_open) in automaton().iter(low):
        s, e = last + 1 - length, last + 1
        if kind & OPENER:
            openers.append(s)
            if kind == OPENER:
                continue
        if first_open and s and low[s - 1].isalnum() or last_open and e < n and low[e].isalnum():
            continue
        vocabulary.append((s, e, kind))
        met |= kind
    return vocabulary, openers, met


_BREAK = re.compile(r"\n+|<br\s*/?>|(?<=[.!?…。])[\"'»”)]*\s+")
_WORDS = re.compile(r"[^\W_]+(?:'[^\W_]+)*")
#: A number or code, digits read as 9.
_CODE = re.compile(r"(?=.*9)[a-f9]{4,}")
_SAME = re.compile(rf"(?<![^\W_])([^\W_]++)(?:[^\w\n]++\1(?![^\W_])){{{REPEATED - 1}}}")
_HEADING = re.compile(r": | - | — | – ")
_NO_HEADING = ("error", "fehler", "erreur", "http", "noscript", "warning", "fatal")


def _sentences(low: str) -> list[tuple[int, int]]:
    """Bounds of sentences and lines that aren't blank; a heading may share its line with what follows."""
    out, at = [], 0
    for m in _BREAK.finditer(low):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, len(low)))
    out = [(a, b) for a, b in out if low[a:b].strip()]
    if out:
        a, b = out[0]
        if (m := _HEADING.search(low, a, b)) and low[m.end() : b].strip() and len(_WORDS.findall(low, a, m.start())) <= HEADING_WORDS and not any(x in low[a : m.start()] for x in _NO_HEADING):
            out[:1] = [(a, m.start()), (m.end(), b)]
    return out


def _filler(ws: list[str]) -> bool:
    if len(ws) < FILLER_WORDS:
        return False
    if sum(w in L.LATIN for w in ws) >= LATIN_SHARE * len(ws):
        return True
    kinds = set(ws)
    return len(kinds) <= 2 and kinds <= L.KEYS or len(ws) >= REPEATED and len(kinds) == 1


def _sentence(low: str, a: int, b: int, hits: list[tuple[int, int, int]]) -> tuple[int, int]:
    """(number of words, 2 for residue, 1 for advice, 0 for anything else); ``hits``: patterns inside the sentence."""
    at = [(m.start(), m.end(), m[0]) for m in _WORDS.finditer(low, a, b)]
    if not at:
        return 0, 0
    met = 0
    for _, _, k in hits:
        met |= k
    if _filler([w for *_, w in at]):
        return len(at), 2
    telling = bool(met & STRONG) or any(met & x and met & y for x, y in PAIRS)
    if not telling and not met & (ADVICE | DEMAND | FAULT):
        return len(at), 0
    spans: list[list[int]] = []
    for s, e, k in hits:
        if k & (KEY | LATIN) == k:
            continue
        if spans and s < spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], e)
        else:
            spans.append([s, e])
    covered = content = k = outside = 0
    for s, e, w in at:
        while k < len(spans) and spans[k][1] < e:
            k += 1
        inside = k < len(spans) and spans[k][0] <= s
        outside += not inside and not w.isdigit()
        if not inside and (w in L.STOP or w.isdigit() or _CODE.fullmatch(w)):
            continue
        content += 1
        covered += inside
    telling = telling or bool(met & FAULT) and not outside  # "Not found."
    return len(at), 0 if covered < SENTENCE_SHARE * content else 2 if telling else 1 if met & (ADVICE | DEMAND) else 0


def coverage(low: str, vocabulary: list[tuple[int, int, int]], met: int) -> float:
    """Share of a text's words that stand in residue sentences, heading and footers aside; 0 for blank texts."""
    if not (met & ALONE or any(met & x and met & y for x, y in PAIRS) or met & FAULT and len(low) < 80 or _SAME.search(low)):
        return 0.0
    vocabulary = sorted(vocabulary)
    starts = [s for s, _, _ in vocabulary]
    scored = [_sentence(low, a, b, vocabulary[bisect_left(starts, a) : bisect_left(starts, b)]) for a, b in _sentences(low)]
    scored = [x for x in scored if x[0]]
    if not any(k == 2 for _, k in scored):
        return 0.0
    if len(scored) > 1 and not scored[0][1] and scored[0][0] <= HEADING_WORDS:
        scored.pop(0)
    for _ in range(FOOTERS):
        if len(scored) > 1 and not scored[-1][1] and scored[-1][0] <= FOOTER_WORDS:
            scored.pop()
    if len(scored) > 1 and not scored[0][1] and scored[0][0] <= 2:
        scored.pop(0)  # Oops!
    n = sum(w for w, _ in scored)
    return sum(w for w, k in scored if k) / n if n else 0.0


# --- placeholders ----------------------------------------------------------------------------------------------------

_NAME = r"[^\W\d_][\w.\-]*(?:\s*\|\s*\w+)?"
_WORDY = r"[^<>\[\]{}()]*"
#: What can stand at an opener; each is tried in place, none searches.
_SYNTAX = re.compile(
    rf"(?<!\{{)\{{\{{++\s*{_NAME}(?:\s*\}}\}}+)?|\$\{{\s*{_NAME}\s*\}}|#\{{\s*{_NAME}\s*\}}|<%=?\s*{_NAME}\s*%>|\{{%\s*{_NAME}\s*%\}}|%\({_NAME}\)[sd]\b|\[\[\s*{_NAME}\s*\]\]|%[1-9]\$[sd]\b"
    rf"|(?<![\w%])%[A-Za-z][\w.\-]*%(?!\w)|(?<![\w@])@@?{_NAME}@@?(?![\w@])|(?<!\w)__[A-Za-z](?:[\w.\-]*[A-Za-z0-9])?__(?!\w)|(?<![\w~])~[A-Za-z][\w.\-]*~(?![\w~])|(?<![\w$])\$[A-Za-z][\w.\-]*\$(?![\w$])|\*\|\s*{_NAME}\s*\|\*"
    rf"|(?<![\w#])##?[A-Z][A-Z_]+##?(?![\w#])|<<\s*{_NAME}\s*>>|«\s*[A-Z][A-Z_]+\s*»|&lt;\s*{_NAME}\s*&gt;|\{{\d?\}}(?!\w)|(?<![\w%])%[sd](?![\w%])|\[object object\]",
    re.IGNORECASE,
)
#: Two at-signs or a sign on one side only aren't a pair.
_PAIRED = re.compile(r"@@.*@@|@[^@]+@|##.*##|#[^#]+#|[^@].*", re.DOTALL)
_BRACKETS = re.compile(rf"[\[{{<(]({_WORDY})[\]}}>)]")
_BARE = re.compile(r"[^\W\d_][\w.\-]*")
_TASKS = re.compile(r"\b(?:todo\s*:\s*(?:add|insert|fill|set|replace|write)|fixme|insert_[a-z_]+)\b", re.IGNORECASE)
_SEP = r"[ \t,:;(«\"']"
#: A stretch of separators is read once, from its first character, whatever its width.
BLANKS = re.compile(
    rf"(?<!{_SEP})(?:(?<=[^\s_.]){_SEP}++|[ \t]*+[,:;(«\"']{_SEP}++)(?:_{{5,}}+|\.{{6,}}+|…{{3,}}+)(?!\s*+\d)"
    r"|^[ \t]*+(?:_{5,}+|\.{6,}+)(?=[ \t,.:]++[^\W\d_])",
    re.MULTILINE,
)
#: Stands for a missing value, as programs write it.
_LITERAL = re.compile(r"(?<![\w/.@-])(?:undefined|null|NaN|[Xx]{4,}|\$[0-9](?![\d.,]*\d|\w))(?![\w/@-])")
_GREETING = re.compile(rf"(?:^|[\n.!?:]\s*)(?:\w+:\s*)?(?:{L.GREETINGS})$", re.IGNORECASE)
_SLOT = re.compile(rf"(?:^|[^\w])(?:{L.SLOTS})$", re.IGNORECASE)
_NAMED = re.compile(rf"(?:^|[^\w])(?:{L.NAMED})$", re.IGNORECASE)
_LABEL = re.compile(r"(?:^|[\n.,;!?(]\s*)[^\W\d_]+(?: [^\W\d_]+)?:$")
_GOES_ON = re.compile(rf"\s*(?:[,.:;!?)]|$|\n|(?:{L.AFTER_VALUE})(?!\w))", re.IGNORECASE)
_MONEY = re.compile(rf"\b(?:{L.PRICES})$", re.IGNORECASE)
_MENTION = re.compile(rf"\b(?:{L.MENTIONS})\b", re.IGNORECASE)
_END = re.compile(r"\n|[.!?] ")
#: The furthest a slot's words reach to the left of a value.
_LEFT = 40


def _is_field(name: str) -> bool:
    """Whether a bare name in brackets is one of a field: made of field words, or written as programs write names."""
    parts = [x for x in re.split(r"[_.\-]|(?<=[a-z0-9])(?=[A-Z])|(?<=\D)(?=\d)", name) if x]
    low = [x.translate(_FOLD) for x in parts]
    if any(x in L.SOUNDS for x in (*low, *re.split(r"[_.\-]", name.translate(_FOLD)))):
        return False
    if all(x in L.FIELDS or x.isdigit() for x in low):
        return any(not x.isdigit() for x in low)
    if any(x in L.FIELDS for x in low) and len(parts) > 1 and "-" not in name:
        return True
    whole = re.sub(r"\d+$", "", name.lower())  # two field names run together, as capitals do to nickName
    return any(whole[:i] in L.FIELDS and whole[i:] in L.FIELDS for i in range(2, len(whole) - 1))


def _are_fields(inside: str) -> bool:
    """Whether brackets hold several words, all of them names of fields or words between them."""
    ws = inside.translate(_FOLD).split()
    return 2 <= len(ws) and ws[0] in L.FIELDS and all(w in L.FIELDS or w in L.BETWEEN for w in ws)


def _is_request(inside: str) -> bool:
    """Whether words in brackets ask for a value: insert, your, … here, to be filled in, TBD."""
    ws = inside.translate(_FOLD).split()
    if not ws:
        return False
    if len(ws) == 1:
        return ws[0] in L.TO_DO
    if ws[0] in L.INSERT or ws[-1] in L.INSERT or inside.translate(_FOLD).endswith(L.TO_FILL):
        return True
    if ws[0] in L.YOUR:
        return any(_is_field(w) for w in ws[1:])
    return ws[-1] in L.HERE and (any(_is_field(w) or w in L.INSERT for w in ws[:-1]) or ws[-2] in ("goes", "comes", "va", "kommt"))


def _before(text: str, at: int) -> tuple[str, int]:
    """What stands to the left of ``at`` without the blanks between, and where it ends."""
    e = at
    while e and text[e - 1] in " \t":
        e -= 1
    return text[max(0, e - _LEFT) : e], e


class Mentions:
    """Whether the sentence around a placeholder talks about it; each text is cut once, each sentence searched once."""

    def __init__(self, text: str):
        self.text, self.ends, self.known = text, None, (0, -1, [])

    def __call__(self, start: int, end: int) -> bool:
        if self.ends is None:
            self.ends = [m.end() for m in _END.finditer(self.text)]
        a, b, found = self.known
        if not (a <= start and end <= b):
            i, j = bisect_right(self.ends, start), bisect_left(self.ends, end + 1)
            a, b = self.ends[i - 1] if i else 0, self.ends[j] if j < len(self.ends) else len(self.text)
            found = [m.span() for m in _MENTION.finditer(self.text, a, b)]
            self.known = a, b, found
        k = bisect_left(found, (start, start))
        return k > 0 and found[0][1] <= start or any(x >= end for x, _ in found[-1:])


def unfilled(text: str, low: str, openers: list[int]) -> bool:
    """Whether a placeholder was left unfilled where a value belongs."""
    blanks = False
    upto = 0
    mentioned = Mentions(text)
    for at in openers:
        if at < upto:
            continue
        c = low[at]
        if c in "_.…" and not low.startswith("__", at) or low.startswith("_____", at):
            blanks = True
            continue
        if m := _SYNTAX.match(text, at):
            upto = m.end()
            inner = m[0][2:-2].strip()
            if not _PAIRED.fullmatch(m[0]) or m[0].startswith("[[") and inner.lower() in L.SOUNDS or m[0][0] in "@#" and m[0][1] != "{" and not _is_field(m[0].strip("@#")):
                continue
            if not mentioned(*m.span()):
                return True
            continue
        if c in "[{<(":
            m = _BRACKETS.match(text, at)
            if m is None:
                continue
            if m[0][0] in "[{<" and "/" not in m[1]:
                bare = _BARE.fullmatch(m[1].strip())
                if not bare and _are_fields(m[1]) and not mentioned(*m.span()):
                    return True
                left = _before(text, at)[0]
                if at and (text[at - 1].isalnum()) or m.end() < len(text) and text[m.end()].isalnum():
                    continue
                if bare and m[0][0] != "<" and (_is_field(m[1].strip()) or _GREETING.search(left) and m[1].translate(_FOLD) not in L.SOUNDS) and not mentioned(*m.span()):
                    return True
            if _is_request(m[1]) and not mentioned(*m.span()):
                return True
            continue
        if c in "tfi":
            m = _TASKS.match(text, at)
        elif (m := _LITERAL.match(text, at)) and not _in_slot(text, m):
            m = None
        if m and not mentioned(*m.span()):
            return True
    return blanks and any(not mentioned(*m.span()) for m in BLANKS.finditer(text))


def _in_slot(text: str, m: re.Match) -> bool:
    """Whether a word stands where a value belongs: after a greeting, a label or a word that leads to a name, and then
    nothing but the end of the clause or a word that can follow a name."""
    left, _ = _before(text, m.start())
    if m[0] == "NaN":
        return True
    if m[0][0] == "$" and _MONEY.search(left):
        return False
    if _NAMED.search(left):
        return True
    return bool(_GOES_ON.match(text, m.end())) and bool(_GREETING.search(left) or _SLOT.search(left) or _LABEL.search(left))


def judge(text: str | None) -> str | None:
    """'placeholder', 'residue', or None for real content, null and blank texts."""
    if not text:
        return None
    text, low = read(text)
    vocabulary, openers, met = scan(low)
    if openers and unfilled(text, low, openers):
        return "placeholder"
    return "residue" if coverage(low, vocabulary, met) >= DOCUMENT_SHARE else None


def mark(docs: DataFrame, text: str = "text", out: str = "residue") -> DataFrame:
    """``docs`` with the column ``out``: ``placeholder``, ``residue`` or null for content to keep.

    Every row stays, repeated ones and those with null, empty or blank texts too (they are no cases); other columns
    stay as they are, but for one already named ``out``, which is replaced.
    """
    import pyarrow as pa

    ship(docs.sparkSession)
    names = [c for c in docs.columns if c.lower() != out.lower()]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names) + f", `{out}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array([judge(t) for t in b.column(text).to_pylist()], pa.string())], names=[*names, out])

    return docs.mapInArrow(run, schema)


def found(docs: DataFrame) -> DataFrame:
    return mark(docs.select("doc_id", "text")).where("residue is not null").select("doc_id").distinct()


def clean(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows found."""
    return mark(docs, out="_residue").where("_residue is null").drop("_residue")


def report(docs: DataFrame) -> DataFrame:
    """(source, kind, documents) with kind ``kept``, ``placeholder`` or ``residue``; source as spelled, null included."""
    return mark(docs.select("source", "text")).groupBy("source", F.coalesce("residue", F.lit("kept")).alias("kind")).agg(F.count(F.lit(1)).alias("documents"))
