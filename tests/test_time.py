"""Intervals of any length, overlaps and temporal duplicates against loops."""

import random

import numpy as np
from pyspark.sql import functions as F

from lodeworks.operators import greedy, intervals


def test_aligned_cells_cover_a_range_once(spark):
    rng = random.Random(1)
    ranges = [(0, 0), (5, 4), (-7, 9), (1, 1_000_000), (3, 52_560_003)] + [tuple(sorted((rng.randrange(-5000, 5000), rng.randrange(-5000, 5000)))) for _ in range(60)]
    rows = spark.createDataFrame(ranges, "a long, b long").select("a", "b", intervals.aligned_cells(F.col("a"), F.col("b")).alias("c")).collect()
    for r in rows:
        held = sorted((c["cell"] << c["level"], (c["cell"] + 1) << c["level"]) for c in r["c"])
        assert len(held) <= 2 * max(r["b"] - r["a"], 1).bit_length() + 1
        assert all(x[1] == y[0] for x, y in zip(held, held[1:]))
        assert (held[0][0], held[-1][1] - 1) == (r["a"], r["b"]) if r["a"] <= r["b"] else not held


def test_a_century_costs_some_rows(spark):
    cells = spark.range(1).select(F.size(intervals.aligned_cells(F.lit(1), F.lit(100 * 366 * 24 * 60))).alias("n")).first()["n"]
    assert cells <= 50


def test_first_interval_of_any_length(spark):
    rng = random.Random(2)
    points = [(i, rng.choice(["a", "a", "b", "c"]), rng.choice([rng.uniform(-900, 5000), float(rng.randrange(0, 5000, 60))])) for i in range(300)]
    held = []
    for i in range(120):
        a = rng.choice([rng.uniform(-1000, 4000), float(rng.randrange(0, 4000, 60))])
        held.append((rng.choice(["a", "b"]), i, a, a + rng.choice([0.0, 5.0, 60.0, 700.0, 3e9, -5.0])))
    held += [("b", 900, float("nan"), 5.0), ("b", 901, float("-inf"), 100.0), ("c", 902, None, 1e9)]
    p = spark.createDataFrame(points, "point_id long, key string, moment_ double")
    s = spark.createDataFrame(held, "key string, seg_idx int, start_sec double, end_sec double")
    for tolerance, unit in ((0.0, 60.0), (30.0, 60.0), (0.0, 7.0)):
        got = {r["point_id"]: r["seg_idx"] for r in intervals.first_interval(p, s, "key", "moment_", tolerance, unit).collect()}
        assert got == {i: min((n for k2, n, a, b in held if k2 == k and a is not None and a - tolerance <= t <= b + tolerance and b >= a), default=None) for i, k, t in points}


def test_overlapping_pairs(spark):
    rng = random.Random(3)
    held = [(rng.choice([1, 1, 2, None]), float(a := rng.randrange(60)), float(a + rng.choice([0, 0, 1, 5, 40]))) for _ in range(200)] + [(9, 1.0, 2.0), (9, 2.0, 3.0), (1, 5.0, 4.0), (1, None, 4.0)]
    got = {r["key"]: r["pairs"] for r in intervals.overlapping_pairs(spark.createDataFrame(held, "key long, a double, b double"), "key", "a", "b").collect()}
    want = {}
    for k in (1, 2, None, 9):
        own = [(a, b) for key, a, b in held if key == k and a is not None and b >= a]
        n = sum(x[0] < y[1] and y[0] < x[1] for i, x in enumerate(own) for y in own[:i])
        want |= {k: n} if n else {}
    assert got == want


def test_repeats_over_pieces(spark):
    rng = np.random.default_rng(4)
    rows = []
    for key, n in (("a", 260), (None, 60), ("b", 3)):
        at, v = 0.0, rng.normal(size=3)
        for i in range(n):
            at += float(rng.choice([0.0, 0.5, 2.0, 4.0]))
            v = v + rng.normal(size=3) * (0.25 if i % 40 else 3)
            rows.append((key, i, at, [float(x) for x in v]))
    want = {}
    for key in ("a", None, "b"):
        kept = []
        for _, i, at, v in [r for r in rows if r[0] == key]:
            u = np.array(v) / np.linalg.norm(v)
            like = max([0.0, *(float(w @ u) for t, w in kept if at - t <= 10)])
            want[key, i] = (like < 0.9, round(like, 6))
            kept += [(at, u)] if like < 0.9 else []
    frame = spark.createDataFrame([*rows, ("a", 999, None, [1.0]), ("a", 998, 1.0, None)], "media string, frame_id long, at double, vector array<double>").repartition(3)
    for seconds in (10.0, 25.0, 1e6):
        got = {(r["media"], r["frame_id"]): (r["kept"], r["similarity"]) for r in greedy.without_repeats(frame, "media", seconds).collect()}
        assert got == want and 20 < sum(k for k, _ in got.values()) < 300
