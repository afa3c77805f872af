"""Problem 4: lines, and turns against a loop in plain Python."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from turnweave.llm import transcript as X

SCHEMA = "line_id long, dataset_name string, session string, reel int, line_no int, speaker string, start double, end double, text string, words array<struct<word string, start double, end double>>, loaded_at timestamp, spoken int, of string, b int"

LINES = [
    ("callhome", "hello &ibm {laugh} so %um ((i think)) (( )) and call <German Feldmessen>.", (None, None, None, "hello ibm so i think and call Feldmessen.", True)),
    ("switchboard", "[laughter-hi] i- i {weatherwise} [splace/space] w[ent] -[th]at okay_1", (None, None, None, "hi i i weatherwise space went that okay", True)),
    ("switchboard", "[laughter-um] uh_1 [noise] <b_aside> [NOISE]", (None, None, None, "", False)),
    ("callhome", "23.59 24.55 B: %uhm <German no> %erm", (23.59, 24.55, "B", "no", True)),
    ("callhome", "[00:01:05.380 --> 01:00:06.330] (( )) %uhh true", (65.38, 3606.33, None, "true", True)),
    ("fisher", "<1.5-2> A: [[skip]] [mn] yeah", (1.5, 2.0, "A", "yeah", True)),
    ("fisher", "(1:21.09 - 1:23.13) [B] th- the", (81.09, 83.13, "B", "th the", True)),
    ("vacation_interview", '*sigh* uh-huh *really* (laughs) ♪ "so" [pause 1.2] mm-hm (126.1s) <t=3.4>', (None, None, None, "uh-huh really so mm-hm", True)),
    ("fisher", "<B> [00:40] hm.", (None, None, "B", "", False)),
    ("fisher", "it's about 122 -- hers, erm, yes... Uhh", (None, None, None, "it's about 122 hers, yes...", True)),
    ("fisher", "... -- ? [] —", (None, None, None, "", False)),
    ("", "", (None, None, None, "", False)),
    ("callhome", "[unclosed {x ((y", (None, None, None, "unclosed x y", True)),
    ("", "summer hummed a drum uhura", (None, None, None, "summer hummed a drum uhura", True)),
]


@pytest.mark.parametrize("dataset,text,want", LINES)
def test_line(dataset, text, want):
    assert X.read_line(text, dataset) == want


def test_long_line():
    text = "[noise] um well " * 30_000
    assert X.read_line(text, "fisher")[3] == " ".join(["well"] * 30_000)


@pytest.mark.parametrize("sign", ["[", "{", "((", "(", "<", "//", "*", "[[", "**"])
def test_unclosed(sign):
    assert X.read_line(f"so {sign} it", "fisher")[3:] == ("so it", True)
    X.read_line(sign * 200_000, "fisher")


def test_speakers(spark):
    v = ["A", " b", "A.", "SPEAKER_B", "spk_A", "ch1", "channel 0", "speaker a:", "user", "agent", "?", "", None, "0", "C"]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, x string").orderBy("i").select(X.speaker_of(F.col("x"))).collect()]
    assert got == ["A", "B", "A", "B", "A", "B", "A", "A", "B", "A", None, None, None, "A", None]


T = datetime(2024, 1, 1)


def row(i, n, speaker=None, start=None, end=None, text=None, words=None, day=0, session="s", reel=0, dataset="fisher"):
    return (i, dataset, session, reel, n, speaker, start, end, text, words, T + timedelta(days=day), 1, "x", 2)


def turns(spark, rows, **kw):
    return sorted(map(tuple, X.turns(spark.createDataFrame(rows, SCHEMA), **kw).collect()), key=str)


def test_cases(spark):
    rows = [
        row(1, 1, "A", 1.0, 2.0, "old", day=0), row(2, 1, "B", 1.0, 2.0, "new", day=1),
        row(3, 2, text="and more"), row(4, 3, text="[noise]"),
        row(5, 4, "B", 2.5, 9.0, "yes"), row(6, 5, "A", 3.0, 3.5, "um [cough]"), row(7, 6, "B", 3.2, 3.3, None, [("ok", 5.0, 6.0), ("so", 4.0, 5.0)]),
        row(8, 7, None, None, None, "10.5 11.0 A: hm"), row(9, 8, text="well"),
        row(10, 9, "A", None, None, None, [("b", 13.0, 14.0), ("a", 12.0, 12.5), None, (None, 1.0, 20.0)]),
        row(11, 10, "A", None, None, "no time at all"), row(12, 11, None, 50.0, 51.0, "nobody"), row(13, None, "A", 60.0, 61.0, "loose"), row(14, 1, "A", 1.0, 2.0, "other reel", reel=1), row(15, 1, text="stray", reel=2),
    ]
    got = turns(spark, rows)
    assert got == sorted([("s", 0, "B", 1000, 9000, "new and more yes so ok"), ("s", 0, "A", 10500, 61000, "well a b loose"), ("s", 1, "A", 1000, 2000, "other reel")], key=str)
    assert [g[:5] for g in got] == turns(spark, rows, with_text=False)
    assert turns(spark, []) == []


def loop(rows):
    last = {}
    for r in rows:
        k = (r[2], r[3], r[4])
        if k not in last or (r[10], r[0]) > (last[k][10], last[k][0]):
            last[k] = r
    reels = {}
    for k in sorted(last):
        r = last[k]
        s, e, who, text, spoken = X.read_line(r[8], r[1])
        who = {"A": "A", "B": "B"}.get(r[5]) or who
        s, e = (r[6], r[7]) if r[6] is not None else (s, e)
        lines = reels.setdefault(k[:2], [])
        if who is None and s is None:
            if lines:
                lines[-1][4] |= spoken
        else:
            lines.append([s, k[2], who, e, spoken])
    out = []
    for k, lines in reels.items():
        run = None
        for s, _, who, e, spoken in sorted(x for x in lines if x[4] and x[2] and x[0] is not None):
            if run and run[2] == who:
                run[4] = max(run[4], e)
            else:
                run = [*k, who, s, e]
                out.append(run)
    return sorted((*r[:3], round(r[3] * 1000), round(r[4] * 1000)) for r in out)


def test_random_and_buckets(spark, monkeypatch):
    rnd = random.Random(7)
    rows = []
    for i in range(700):
        head = rnd.random() < 0.8
        n, t = rnd.randint(0, 60), round(rnd.uniform(0, 90), 1)
        who = rnd.choice("AB") if head else None
        text = rnd.choice(["yes", "um", "[noise]", "so well", "uh-huh"])
        style = rnd.random()
        if head and style < 0.2:
            rows.append(row(i, n, None, None, None, f"{t:.2f} {t + 1:.2f} {who}: {text}", day=rnd.randint(0, 3), reel=rnd.randint(0, 4)))
        else:
            rows.append(row(i, n, who, t if head else None, t + rnd.choice([0.5, 30]) if head else None, text, day=rnd.randint(0, 3), reel=rnd.randint(0, 4)))
    want = loop(rows)
    for a, b in ((1024, 1800), (7, 10), (1, 1)):
        monkeypatch.setattr(X, "LINES_IN_BUCKET", a)
        monkeypatch.setattr(X, "SECONDS_IN_BUCKET", b)
        got = turns(spark, rows, with_text=False)
        assert sorted(got) == want, (a, b)
