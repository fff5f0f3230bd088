"""Vector codes against plain Python integers."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeworks.llm import vectorcodes

from ..conftest import DATA

COLUMNS = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error, label_error, digest) of each row, by loops over integers."""
    rows = sorted((i is None, i or 0, [float(np.float32(c)) for c in v], label) for i, v, label in rows if v and all(c is not None and math.isfinite(np.float32(c)) for c in v))
    x = [[math.floor(4096 * c) for c in r[2]] for r in rows]
    w = len(x[0]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for v in x]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def best(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for c in cut:
                held[best(c[p], books[p])[1]].append(c[p])
            books[p] = [[sum(s) // len(held[e]) for s in zip(*held[e])] if e in held else b for e, b in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(n) for b in books for c in b for n in c).encode()).hexdigest()
    found = [[best(c[p], books[p]) for p in range(parts)] for c in cut]
    per = defaultdict(int)
    for r, f in zip(rows, found):
        per[r[3]] += sum(d for d, _ in f)
    return sorted((r[0], r[1], "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), per[r[3]], digest) for r, f in zip(rows, found))


def got(spark, rows):
    out = vectorcodes.compressed(spark.createDataFrame(rows, COLUMNS)).collect()
    return sorted((r["vec_id"] is None, r["vec_id"] or 0, r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in out)


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for width, most in ((1, 1 << 27), (8, 1 << 27), (64, 1 << 27), (300, 5000), (8, 3), (0, 1)):
        a, b = (rng.integers(-most, most, (n, width), endpoint=True) for n in (50, 16))
        if width:
            a[0], b[0], a[1], b[1] = most, -most, -most, most
        want = [[sum(int(x) * int(y) for x, y in zip(r, c)) for c in b] for r in a]
        assert vectorcodes.products(a, b).tolist() == want
        at, far = vectorcodes.nearest(a, b)
        for i, r in enumerate(a):
            d = [sum((int(x) - int(y)) ** 2 for x, y in zip(r, c)) for c in b]
            assert far[i] == min(d) and at[i] == d.index(min(d))


def test_ties_go_to_the_first():
    book = np.array([[2], [0], [2], [4]])
    at, far = vectorcodes.nearest(np.array([[1], [3], [2]]), book)
    assert at.tolist() == [0, 0, 0] and far.tolist() == [1, 1, 0]


@pytest.mark.parametrize("n", [1, 5, 16, 200])
def test_against_loops(spark, n):
    rng = np.random.default_rng(n)
    rows = [(int(i), [float(np.float32(c)) for c in rng.normal(size=16).round(2)], [None, 1, 2][i % 3]) for i in rng.permutation(n)]
    rows += rows[: n // 4]
    assert got(spark, rows) == plain(rows)


def test_hot_label_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=8)], 1 if i % 3 else None) for i in range(1500)]
    odd = [(-1, None, 1), (-2, [1.0] * 7 + [None], 1), (-3, [float("nan")] * 8, 1), (-4, [float("inf")] + [0.0] * 7, None), (-5, [], 1), (-6, [1.0] * 7, 1), (9000, [1.0] * 16, 1)]
    assert got(spark, rows + odd) == plain(rows)
    null = [(None, [0.5] * 8, 3)]
    assert got(spark, rows[:20] + null) == plain(rows[:20] + null)


def test_huge_components_and_no_rows(spark):
    rows = [(i, [3e38 if i % 2 else -3e38] * 8, 1) for i in range(8)]
    out = got(spark, rows)
    assert len(out) == 8 and all(r[3] == 0 for r in out)
    assert got(spark, []) == [] and got(spark, [(1, None, 1)]) == []
    clash = spark.createDataFrame([(1, [1.0] * 8, 1, "x", "y")], COLUMNS + ", code string, x string")
    assert [r["code"] for r in vectorcodes.compressed(clash).collect()] == ["00" * 8]


def test_layout_does_not_matter(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    a = sorted(map(tuple, vectorcodes.compressed(table.repartition(1)).collect()))
    assert a == sorted(map(tuple, vectorcodes.compressed(table.repartition(7, F.rand(1))).collect()))
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table.collect()]
    assert [(False, *r) for r in a] == plain(rows)


def test_sql(spark):
    import duckdb

    from lodeworks.llm import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    want = con.execute(queries.ORACLES["op12_vectorcodes"])
    names = [c[0] for c in want.description]
    rows = queries.QUERIES["op12_vectorcodes"](spark, DATA)
    assert sorted(tuple(r[c] for c in names) for r in rows.collect()) == sorted(want.fetchall())
