"""The field over lines against enumeration, and its scores on labels that it has not seen."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeworks.llm import quality

from ..conftest import DATA

LARGER = DATA.replace("sf0.001", "sf0.01")


def enumerated(s, moves):
    """The chance of good of each line, by all labellings."""
    total, good = 0.0, np.zeros(len(s))
    for y in itertools.product((0, 1), repeat=len(s)):
        w = math.exp(sum(a * b for a, b in zip(s, y)) + sum(moves[a, b] for a, b in zip(y, y[1:])))
        total += w
        good += w * np.array(y)
    return good / total


def test_forward_backward():
    rng = np.random.default_rng(1)
    for n in range(1, 9):
        s, moves = rng.normal(size=n) * 2, rng.normal(size=(2, 2))
        assert np.allclose(quality.marginals(s, moves), enumerated(s, moves))
    far = quality.marginals(np.array([1e4, -1e4, 1e4]), np.zeros((2, 2)))
    assert far[0] > 0.99 and far[1] < 0.01 and np.isfinite(far).all()


def test_gradient_of_the_likelihood():
    rng = np.random.default_rng(2)
    chains = quality._Chains([rng.integers(0, quality.BINS, (n, quality.FEATURES)).astype(np.uint8) for n in (5, 3, 3, 1)])
    weights, moves, bias = rng.normal(size=(3, quality.FEATURES, quality.BINS)) * 0.3, rng.normal(size=(2, 2)), 0.2
    y = rng.integers(0, 2, len(chains.bins))

    def loss(weights, bias, moves):
        s, out = chains.potentials(weights, bias), 0.0
        for a, n in zip(chains.at, chains.n):
            own, z = s[a : a + n], 0.0
            for v in itertools.product((0, 1), repeat=n):
                z += math.exp(sum(p * q for p, q in zip(own, v)) + sum(moves[i, j] for i, j in zip(v, v[1:])))
            v = y[a : a + n]
            out += sum(p * q for p, q in zip(own, v)) + sum(moves[i, j] for i, j in zip(v, v[1:])) - math.log(z)
        return out

    good, pairs = chains.expected(chains.potentials(weights, bias), moves)
    for a, n in zip(chains.at, chains.n):
        assert np.allclose(good[a : a + n], enumerated(chains.potentials(weights, bias)[a : a + n], moves))
        assert np.allclose(chains.potentials(weights, bias)[a : a + n], quality.potentials(chains.bins[a : a + n], weights, bias))
    by_weight, by_move, tiny = chains.gradient(y - good), chains.moved(y) - pairs, 1e-6
    for at in ((0, 2, 3), (1, 0, 0), (2, 5, 7)):
        more = weights.copy()
        more[at] += tiny
        assert abs((loss(more, bias, moves) - loss(weights, bias, moves)) / tiny - by_weight[at]) < 1e-3
    for at in itertools.product((0, 1), repeat=2):
        more = moves.copy()
        more[at] += tiny
        assert abs((loss(weights, bias, more) - loss(weights, bias, moves)) / tiny - by_move[at]) < 1e-3


def test_lines_are_described_whole():
    bins, lengths = quality.described("One two two.\nABC !!! ###\n\n" + "One two two.")
    assert lengths.tolist() == [13, 12, 1, 13] and bins.shape == (4, quality.FEATURES)
    assert bins[0].tolist() == bins[3].tolist() and bins[0][9] == 1 and bins[1][0] == 7 and bins[2].tolist()[7:] == [0, 0, 0, 4]
    long = quality.described("x" * 4999 + "\n" + "y")
    assert long[1].tolist() == [2001, 2001, 1000, 2]
    assert quality.described(None)[1].tolist() == [1] and quality.described("\ud800é\U0001f600")[1].tolist() == [4]


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string, score string, label string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def got(spark, docs, labels):
    return [tuple(r) for r in quality.rated(*frames(spark, docs, labels)).collect()]


def test_learns_by_the_folds(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    rows = {r["doc_id"]: r for r in quality.rated(docs, labels).collect()}
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows.values())
    seen = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [(rows[d]["predicted"], q) for d, q in seen.items() if rows[d]["held_out"]]
    assert len(held) > 40 and sum(p == q for p, q in held) >= 0.9 * len(held)
    # labels of the fold held out, other columns and the layout change nothing
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    moved = docs.withColumns({"lang": F.lit("x"), "source": F.lit(None).cast("string")}).repartition(7)
    again = {r["doc_id"]: r["score"] for r in quality.rated(moved, turned).collect()}
    assert again == {d: r["score"] for d, r in rows.items()}


def test_part_of_a_document_may_be_bad():
    rng = np.random.default_rng(4)

    def line(bad):
        words = ["".join(rng.choice(list("abcdeo"), 5)) for _ in range(8)]
        return " ".join(w + "###" for w in words) if bad else " ".join(words).capitalize() + "."

    rows = []
    for i in range(400):
        k = i % 2
        text = "\n".join(line(k == 0 and 2 <= j < 6) for j in range(8))
        rows.append((int(rng.integers(2**62)), k, *quality.described(text), 1.0))
    model = quality.fitted(rows)
    bins, _ = quality.described("\n".join(line(2 <= j < 6) for j in range(8)))
    p = quality.marginals(quality.potentials(bins, model.weights, model.bias), model.moves)
    assert (p[2:6] < 0.5).all() and p[0] > 0.5 and p[-1] > 0.5
    assert quality.scored("\n".join(line(True) for _ in range(8)), model) < 0.1 < 0.9 < quality.scored("\n".join(line(False) for _ in range(8)), model)


@pytest.mark.parametrize(("labels", "score"), [([], 0.5), ([(1, 1, 0), (2, 1, 0)], 1.0), ([(1, 0, 0)], 0.0), ([(1, None, 0), (2, 5, 0), (3, 1, 0), (3, 0, 0), (None, 1, 0)], 0.5), ([(77, 1, 0), (78, 0, 0)], 0.5)])
def test_little_to_learn_from(spark, labels, score):
    docs = [(1, "a", "s", "l"), (1, "a", "s", "l"), (2, None, None, None), (None, "b", "s", "l")]
    assert sorted(got(spark, docs, labels), key=str) == sorted([(d[0], d[0] is not None and quality.zlib.crc32(str(d[0]).encode()) % 5 == 0, score, int(score >= 0.3)) for d in docs], key=str)


def test_odd_rows(spark):
    ids = [i for i in range(60) if quality.zlib.crc32(str(i).encode()) % 5]
    docs = [(i, ("Fine words, one by one.\n" if n % 2 else "#### $$$$ ####\n") * 3, "s", "l") for n, i in enumerate(ids)]
    docs += [(ids[0], docs[0][1], "s", "l")] * 300  # one id of most rows
    docs += [(900, None, None, None), (901, "", "", ""), (902, "word " * 300_000, "", ""), (903, "Line.\n" * 100_000, "", ""), (None, " \n ", "", "")]
    rows = got(spark, docs, [(i, n % 2, 0) for n, i in enumerate(ids)])
    assert len(rows) == len(docs) and all(0 <= r[2] <= 1 for r in rows)
    score = {r[0]: r[2] for r in rows}
    assert score[900] == score[901] and score[ids[0]] < 0.3 < score[ids[1]]
    assert got(spark, [], []) == []
