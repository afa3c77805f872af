"""Periods and gaps against merging in plain Python, with every kind of bad input."""

import math
import random

from turnweave.operators.intervals import periods_and_gaps, sweep

SCHEMA = "list_id long, session string, reel int, time_unit string, vad array<array<array<double>>>, kind string, b int"


def brute(rows):
    seg = {}
    for _, s, r, unit, vad, *_ in rows:
        for c, channel in enumerate(vad or []):
            for x in channel or []:
                if x is None or len(x) != 2 or any(v is None or math.isnan(v) or math.isinf(v) for v in x):
                    continue
                a, b = sorted(round(v * (1 if (unit or "").strip().lower() == "ms" else 1000), 3) for v in x)
                a = max(a, 0)
                if b > a:
                    seg.setdefault((s, r, c), []).append((a, b))
    out = set()
    for k, l in seg.items():
        per = []
        for a, b in sorted(l):
            if per and a <= per[-1][1]:
                per[-1][1] = max(per[-1][1], b)
            else:
                per.append([a, b])
        out |= {(*k, "period", round(a), round(b)) for a, b in per}
        out |= {(*k, "gap", round(p[1]), round(q[0])) for p, q in zip(per, per[1:])}
    return out


def check(spark, rows, **kw):
    got = periods_and_gaps(spark.createDataFrame(rows, SCHEMA), **kw).collect()
    assert len(got) == len(set(map(tuple, got)))
    assert set(map(tuple, got)) == brute(rows)
    return got


def test_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, "s", 0, "s", [[[1.0, 2.0], [2.0, 3.0], [5.0, 4.0], [4.5, 4.6], [7.0, 7.0], [-2.0, -1.0], [-1.0, 0.5]], [[0.0, 1.0]]], "x", 1),
        (2, "s", 0, "ms", [[[8000.0, 9000.0], [8000.0, 9000.0]], None], "x", 1),
        (3, "s", 0, None, [[None, [], [1.0], [1.0, 2.0, 3.0], [nan, 1.0], [None, 2.0], [inf, 3.0]]], "x", 1),
        (4, None, None, "s", [[[1.0, 2.0], [3.0, 4.0]]], None, None),
        (5, "s", 1, " MS ", None, "x", 1),
        (6, "s", 1, "s", [], "x", 1),
    ]
    assert check(spark, rows)


def test_empty(spark):
    assert check(spark, []) == []


def test_random_and_split_by_time(spark):
    rnd = random.Random(1)
    rows = [(i, f"s{rnd.randint(0, 2)}", rnd.randint(0, 1), rnd.choice(["s", None]), [[[t := round(rnd.uniform(-1, 60), 2), round(t + rnd.uniform(-1, 20), 2)] for _ in range(rnd.randint(0, 6))] for _ in range(2)], "x", 0) for i in range(60)]
    for us in (500_000, 7_000_000, 3_600_000_000):
        check(spark, rows, bucket_us=us)


def test_sweep_takes_any_keys(spark):
    df = spark.createDataFrame([("x", 1, 1, 5), ("x", 1, 3, 4), ("x", 1, 9, 10), ("x", None, 2, 2), ("x", 2, 7, 3)], "t string, kind int, b int, e int")
    got = sweep(df.withColumnRenamed("kind", "k"), ["t", "k"], "b", "e")
    assert sorted(map(tuple, got.collect())) == [("x", 1, "gap", 5, 9), ("x", 1, "period", 1, 5), ("x", 1, "period", 9, 10)]


def test_far_future(spark):
    """Times past the last microsecond of a long are cut off there, not dropped with their segment."""
    rows = [(1, "s", 0, "s", [[[1.0, 2.0], [1e12, 2e12], [5e12, 1e300], [1e14, 1e15]], [[9e14, 9e14 + 5]]], "x", 1), (2, "s", 0, "ms", [[], [[9e14, 9e14 + 5]]], "x", 1)]
    got = set(map(tuple, periods_and_gaps(spark.createDataFrame(rows, SCHEMA)).collect()))
    end = 9_200_000_000_000_000
    assert got == {
        ("s", 0, 0, "period", 1000, 2000), ("s", 0, 0, "gap", 2000, 10**15), ("s", 0, 0, "period", 10**15, 2 * 10**15), ("s", 0, 0, "gap", 2 * 10**15, 5 * 10**15), ("s", 0, 0, "period", 5 * 10**15, end),
        ("s", 0, 1, "period", 9 * 10**14, 9 * 10**14 + 5),
    }
