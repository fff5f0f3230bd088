"""Folds in stretches against folds in a loop."""

import random

import pytest
from pyspark.sql import functions as F

from lodeworks.operators import greedy, scans


def test_functions_compose_over_levels(spark):
    rng = random.Random(1)
    fs = [[(rng.randrange(3), rng.randrange(4)) for _ in range(3)] for _ in range(40)]
    frame = spark.createDataFrame([(i, f) for i, f in enumerate(fs)], f"stretch long, f {scans.FUNCTION}")
    for fan in (2, 3, 7, 64):
        state, n, want = 1, 0, []
        for i, f in enumerate(fs):
            want.append((i, state, n))
            state, more = f[state]
            n += more
        assert sorted(map(tuple, scans.entered(frame, 3, 1, fan).collect())) == want
    assert scans.entered(frame.limit(0), 3).count() == 0


def filled(sizes, most_items, most_size):
    out, batch, items, total = [], 0, 0, 0
    for s in sizes:
        s = max(s or 0, 0)
        if items and (items >= most_items or total + s > most_size):
            batch, items, total = batch + 1, 0, 0
        items, total = items + 1, total + s
        out.append(batch)
    return out


@pytest.mark.parametrize(("most_items", "most_size", "length"), [(4, 50, 8), (7, 30, 7), (1, 10, 5), (5, 0, 16), (3, 10**9, 4)])
def test_batches_over_all_rows(spark, most_items, most_size, length):
    rng = random.Random(most_size)
    sizes = [rng.choice([0, 0, 3, 9, 20, 60, None, -1]) for _ in range(150)]
    rows = [(i, s) for i, s in enumerate(sizes)]
    rng.shuffle(rows)
    old, scans.FAN = scans.FAN, 3
    try:
        got = scans.batches(spark.createDataFrame(rows, "id long, n long").repartition(5), "id", "n", most_items, most_size, length).collect()
    finally:
        scans.FAN = old
    assert [r["batch"] for r in sorted(got)] == filled(sizes, most_items, most_size)


def test_batches_of_nothing_and_of_one(spark):
    frame = spark.createDataFrame([(None, 5)], "id string, n int")
    assert [tuple(r) for r in scans.batches(frame, "id", "n", 3, 1).collect()] == [(None, 0)]
    assert scans.batches(frame.limit(0), "id", "n", 3, 1).collect() == []


def test_short_segments_of_a_key_with_most_rows(spark):
    rng = random.Random(3)
    rows = [(1 if i % 2 else rng.randrange(2, 9), i, i / 2, i / 2 + 1, rng.choice(["", " ", "a b", "one two three four", "x " * 40, None])) for i in range(400)]
    frame = spark.createDataFrame(rows, "key long, id long, start double, end double, text string")
    want = []
    for key in range(1, 9):
        held = None
        for _, i, a, b, t in sorted(r for r in rows if r[0] == key):
            held = (key, held[1], b, held[3] + [t or ""], held[4] + [i]) if held else (key, a, b, [t or ""], [i])
            if len(" ".join(held[3]).split()) >= 30:
                want.append(held)
                held = None
        want += [held] if held else []
    want = sorted((k, a, b, " ".join(t).strip(" "), i) for k, a, b, t, i in want)
    old, scans.FAN = scans.FAN, 4
    try:
        for length in (8, 1024):
            numbered = scans.glued(frame, "key", ["start"], F.size(greedy.words(F.coalesce("text", F.lit("")))), 30, "unit", length)
            units = {}
            for r in numbered.collect():
                units.setdefault((r["key"], r["unit"]), []).append(r["id"])
            assert sorted(sorted(x) for x in units.values()) == sorted(w[4] for w in want)
    finally:
        scans.FAN = old
    got = sorted(tuple(r) for r in greedy.merged_segments(frame.repartition(3), "key", "id").collect())
    assert got == want
