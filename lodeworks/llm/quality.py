"""Document quality: a linear-chain conditional random field labels every line good or bad.

A line is described by a few counts of its characters and words, each put into one of eight bins; its potential adds up the weights of
its own bins and of those of the lines before and after, and transitions tie neighbours together. Forward-backward gives each
line's chance of being good; their mean, weighted by the lines' lengths, is calibrated into the document's score.

Labels are those of documents alone. So the lines of a good document are good, and those of a bad one start as bad and are labelled anew
by the model between rounds of training; at least one of them stays bad.

The model is fitted in one task on about FIT_ROWS labelled documents of either label, chosen by a hash of their id, of each of which
at most FIT_STRETCHES runs of STRETCH lines, chosen by a hash of their text, take part. Every document is scored as a whole.

Defined results. A null text is an empty one; an empty text is one line without words. A line ends at a line feed; one longer than
LINE_CHARS code points is taken as several, so memory follows a document's number of lines (a dozen bytes and some numbers each). A null
doc_id is not held out, has no label, and is scored. Repeated rows are scored alike. A document whose labels differ, or are neither 0 nor 1,
teaches nothing. Where nothing teaches, every score is 0.5; where one label alone does, it is 1 or 0. An empty table gives an empty
result. Columns beyond doc_id, text and quality are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import handed_back, shipped

FOLDS = 5
FIT_ROWS, STRETCH, FIT_STRETCHES, LINE_CHARS = 3000, 200, 10, 2000
#: A document is predicted good from this score on.
GOOD = 0.3
FEATURES, BINS = 11, 8
#: Shares fall into bins by these bounds.
SHARES = np.array([0.005, 0.02, 0.06, 0.15, 0.3, 0.5, 0.8])
#: Classes of characters.
SPACE, UPPER, LOWER, DIGIT, MARK, SYMBOL, OTHER = range(7)
MARKS = ".,;:?'\"()-…¿¡«»“”’"
STEPS, RATE, PENALTY = 120, 0.1, 0.1


def _class(c: str) -> int:
    if c.isspace():
        return SPACE
    if c.isalpha():
        return UPPER if c.isupper() else LOWER
    return DIGIT if c.isdigit() else MARK if c in MARKS else SYMBOL


#: Of the code points up to the end of general punctuation; those above are letters or OTHER.
CLASSES = np.array([_class(chr(i)) for i in range(0x2070)], np.uint8)


def lines_of(text: str) -> list[str]:
    lines = text.split("\n")
    if max(map(len, lines)) <= LINE_CHARS:
        return lines
    return [x[i : i + LINE_CHARS] for x in lines for i in range(0, max(len(x), 1), LINE_CHARS)]


def described(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(bins by line and feature, length of each line)."""
    lines = lines_of(text or "")
    n = len(lines)
    lengths = np.fromiter(map(len, lines), np.int64, n)
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.where(points < len(CLASSES), CLASSES[np.minimum(points, len(CLASSES) - 1)], OTHER)
    by = np.bincount(np.repeat(np.arange(n), lengths) * 7 + kinds, minlength=n * 7).reshape(n, 7)
    words = [x.split() for x in lines]
    count = np.fromiter(map(len, words), np.int64, n)
    distinct = np.fromiter((len(set(w)) for w in words), np.int64, n)
    again = np.fromiter((sum(map(eq, w, w[1:])) for w in words), np.int64, n)
    seen = Counter(lines)
    copies = np.fromiter((seen[x] if x else 1 for x in lines), np.int64, n)
    ends = np.fromiter(((x[-1] in ".!?…") * 2 + x[0].isupper() if x else 4 for x in map(str.strip, lines)), np.int64, n)
    letters, tokens = by[:, UPPER] + by[:, LOWER], np.maximum(count, 1)
    shares = np.stack(
        [
            by[:, UPPER] / np.maximum(letters, 1),
            by[:, DIGIT] / np.maximum(lengths, 1),
            by[:, MARK] / tokens,
            by[:, SYMBOL] / tokens,
            1 - distinct / tokens * (count > 0),
            again / tokens,
            by[:, OTHER] / np.maximum(lengths, 1),
        ],
        1,
    )
    size = np.minimum(np.log2(count + 1), BINS - 1).astype(np.uint8)
    width = np.minimum(lengths / tokens / 2, BINS - 1).astype(np.uint8)
    repeated = np.minimum(np.log2(copies), BINS - 1).astype(np.uint8)
    return np.column_stack([np.searchsorted(SHARES, shares, "right").astype(np.uint8), size, width, repeated, ends.astype(np.uint8)]), lengths + 1


@dataclass(frozen=True)
class Model:
    """weights: by neighbour (before, own, after), feature and bin; moves: log potentials by the labels (0 bad, 1 good) of two lines in
    turn; slope and shift calibrate the log odds of the mean."""

    weights: np.ndarray
    bias: float
    moves: np.ndarray
    slope: float
    shift: float


def potentials(bins: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """How much more the features speak for good than for bad, line by line."""
    before, own, after = (w[np.arange(FEATURES), bins].sum(1) for w in weights)
    out = own + bias
    out[1:] += before[:-1]
    out[:-1] += after[1:]
    return out


def _passed(odds: float, to_good: tuple[float, float], to_bad: tuple[float, float]) -> float:
    """The log odds of the next line's labels before its own potential, from those of a line."""
    p = math.exp(min(max(odds, -500.0), 500.0))
    return math.log((p * to_good[1] + to_good[0]) / (p * to_bad[1] + to_bad[0]))


def marginals(s: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The chance of being good of each line, by forward-backward in log odds."""
    e = np.exp(moves)
    n, potential = len(s), s.tolist()
    forward = [potential[0]]
    to = ((e[0, 1], e[1, 1]), (e[0, 0], e[1, 0]))
    for t in range(1, n):
        forward.append(potential[t] + _passed(forward[-1], *to))
    backward = [0.0] * n
    back = ((e[1, 0], e[1, 1]), (e[0, 0], e[0, 1]))
    for t in range(n - 2, -1, -1):
        backward[t] = _passed(potential[t + 1] + backward[t + 1], *back)
    return 1 / (1 + np.exp(-np.clip(np.array(forward) + backward, -500, 500)))


def mean_odds(p: np.ndarray, lengths: np.ndarray) -> float:
    m = float(np.clip((p * lengths).sum() / lengths.sum(), 1e-4, 1 - 1e-4))
    return math.log(m / (1 - m))


def scored(text: str | None, model: Model | float) -> float:
    """The document's chance of being good."""
    if isinstance(model, float):
        return model
    bins, lengths = described(text)
    odds = mean_odds(marginals(potentials(bins, model.weights, model.bias), model.moves), lengths)
    return 1 / (1 + math.exp(-min(max(model.slope * odds + model.shift, -500.0), 500.0)))


class _Chains:
    """Sequences of lines side by side, the longest first, so that a step of forward-backward is one operation over all."""

    def __init__(self, chains: list[np.ndarray]):
        self.n = np.array([len(c) for c in chains])
        self.at = np.concatenate([[0], np.cumsum(self.n)[:-1]])
        self.bins = np.concatenate(chains)
        self.first = np.zeros(len(self.bins), bool)
        self.first[self.at] = True
        self.last = np.roll(self.first, -1)
        self.alive = [int((self.n > t).sum()) for t in range(int(self.n.max()))]
        self.codes = self.bins.astype(np.int64) + np.arange(FEATURES) * BINS

    def potentials(self, weights: np.ndarray, bias: float) -> np.ndarray:
        before, own, after = (w.ravel()[self.codes].sum(1) for w in weights)
        return own + bias + np.where(self.first, 0, np.roll(before, 1)) + np.where(self.last, 0, np.roll(after, -1))

    def gradient(self, d: np.ndarray) -> np.ndarray:
        """Of the weights, from that of the potentials."""
        shifted = (np.where(self.last, 0, np.roll(np.where(self.first, 0, d), -1)), d, np.where(self.first, 0, np.roll(np.where(self.last, 0, d), 1)))
        return np.stack([np.bincount(self.codes.ravel(), np.repeat(x, FEATURES), FEATURES * BINS) for x in shifted]).reshape(3, FEATURES, BINS)

    def expected(self, s: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(chance of good by line, expected number of moves)."""
        e = np.exp(moves)
        forward, backward = s.copy(), np.zeros_like(s)
        for t in range(1, len(self.alive)):
            i = self.at[: self.alive[t]] + t
            p = np.exp(np.clip(forward[i - 1], -50, 50))
            forward[i] += np.log((p * e[1, 1] + e[0, 1]) / (p * e[1, 0] + e[0, 0]))
        for t in range(len(self.alive) - 1, 0, -1):
            i = self.at[: self.alive[t]] + t
            p = np.exp(np.clip(s[i] + backward[i], -50, 50))
            backward[i - 1] = np.log((p * e[1, 1] + e[1, 0]) / (p * e[0, 1] + e[0, 0]))
        good = 1 / (1 + np.exp(-np.clip(forward + backward, -50, 50)))
        j = np.flatnonzero(~self.first)
        a, b = np.clip(forward[j - 1], -50, 50), np.clip(s[j] + backward[j], -50, 50)
        pairs = np.stack([np.zeros_like(a) + moves[0, 0], b + moves[0, 1], a + moves[1, 0], a + b + moves[1, 1]])
        pairs = np.exp(pairs - pairs.max(0))
        return good, (pairs / pairs.sum(0)).sum(1).reshape(2, 2)

    def moved(self, y: np.ndarray) -> np.ndarray:
        j = np.flatnonzero(~self.first)
        return np.bincount(y[j - 1] * 2 + y[j], minlength=4).reshape(2, 2).astype(float)


def fitted(rows: list[tuple[int, int, np.ndarray, np.ndarray, float]]) -> Model:
    """The model of stretches (document, label, bins, lengths, weight), every fourth document of which is kept for calibration."""
    rows = sorted(rows, key=lambda r: (-len(r[2]), r[0], r[1], r[2].tobytes()))
    apart = [r for r in rows if r[0] % 4 == 3]
    own = [r for r in rows if r[0] % 4 != 3] or rows
    if len({r[1] for r in apart}) < 2:
        apart = rows
    chains = _Chains([r[2] for r in own])
    label = np.repeat([r[1] for r in own], chains.n)
    weights, bias, moves = np.zeros((3, FEATURES, BINS)), np.zeros(1), np.zeros((2, 2))
    y, n = label.copy(), len(label)
    for turn in range(3):
        # the first turn tells lines by themselves; then neighbours and moves have their say
        own_alone = np.array([0.0, 1.0, 0.0] if turn == 0 else [1.0, 1.0, 1.0])[:, None, None]
        state = [(x, np.zeros_like(x), np.zeros_like(x)) for x in (weights, bias, moves)]
        for step in range(1, STEPS + 1):
            good, pairs = chains.expected(chains.potentials(weights, bias[0]), moves)
            d = (y - good) / n
            slopes = (chains.gradient(d) * own_alone - PENALTY * weights / n, np.array([d.sum()]), (chains.moved(y) - pairs) / n if turn else np.zeros((2, 2)))
            for (x, m, v), g in zip(state, slopes, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                x += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        if turn < 2:
            good, _ = chains.expected(chains.potentials(weights, bias[0]), moves)
            y = np.where(label == 1, 1, good >= 0.5).astype(np.int64)
            worst = np.array([a + int(np.argmin(good[a : a + k])) for a, k in zip(chains.at, chains.n, strict=True)])
            y[worst] = label[worst]
    per: dict[tuple[int, int], list] = {}
    for doc, k, bins, lengths, w in apart:
        p = marginals(potentials(bins, weights, bias[0]), moves)
        held = per.setdefault((doc, k), [0.0, 0.0, w])
        held[0] += float((p * lengths).sum())
        held[1] += float(lengths.sum())
    means = np.clip([a / b for a, b, _ in per.values()], 1e-4, 1 - 1e-4)
    slope, shift = calibrated(np.log(means / (1 - means)), np.array([k for _, k in per]), np.array([w for *_, w in per.values()]))
    return Model(weights, float(bias[0]), moves, slope, shift)


def calibrated(odds: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through the labels, by Newton's method with a slight pull to the identity."""
    x = np.column_stack([odds, np.ones_like(odds)])
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        pull = np.array([w[0] - 1, w[1]]) * 0.5
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(2)
        move = np.linalg.solve(h, x.T @ (weight * (y - p)) - pull)
        w = w + np.clip(move, -1, 1)
        if np.abs(move).max() < 1e-9:
            break
    return max(float(w[0]), 1e-3), float(w[1])


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))


def teaching(labels: DataFrame) -> DataFrame:
    """(doc_id, label) of the ids that may teach."""
    agreed = labels.where(~held_out() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("most"))
    return agreed.where("label = most and label in (0, 1)").select("doc_id", F.col("label").cast("int").alias("label"))


def trained(docs: DataFrame, labels: DataFrame) -> Model | float:
    """The model of the documents that may teach; a score for all where one label alone teaches, or none."""
    shipped(docs.sparkSession)
    agreed = teaching(labels)
    per = {r["label"]: r["count"] for r in agreed.groupBy("label").count().collect()}
    if len(per) < 2:
        return float(next(iter(per))) if per else 0.5
    share = {k: min(1.0, FIT_ROWS / n) for k, n in per.items()}
    chosen = agreed.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000)) < F.when(F.col("label") == 1, share[1] * 1_000_000).otherwise(share[0] * 1_000_000))
    # about 2 * FIT_ROWS ids, each of which teaches by one of its texts
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))

    def stretched(batches):
        for batch in batches:
            out: list[tuple] = []
            for key, label, text in zip(*(batch.column(c).to_pylist() for c in ("key", "label", "text")), strict=True):
                bins, lengths = described(text)
                begins = list(range(0, len(bins), STRETCH))
                if len(begins) > FIT_STRETCHES:
                    begins.sort(key=lambda b, bins=bins: (zlib.crc32(bins[b : b + STRETCH].tobytes()), b))
                    begins = begins[:FIT_STRETCHES]
                out += [(key, label, bins[b : b + STRETCH].tobytes(), lengths[b : b + STRETCH].tolist()) for b in begins]
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())), strict=True)], names=["key", "label", "bins", "lengths"])

    def fit(batches):
        held = []
        for batch in batches:
            for key, label, bins, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append((key, label, np.frombuffer(bins, np.uint8).reshape(-1, FEATURES), np.array(lengths, np.float64), 1 / share[label]))
        if held:
            m = fitted(held)
            handed_back()
            yield pa.RecordBatch.from_arrays([pa.array([m.weights.tobytes()]), pa.array([m.bias]), pa.array([m.moves.tobytes()]), pa.array([m.slope]), pa.array([m.shift])], names=["weights", "bias", "moves", "slope", "shift"])

    keyed = sample.select(F.xxhash64("doc_id").alias("key"), "label", "text")
    stretches = keyed.mapInArrow(stretched, "key long, label int, bins binary, lengths array<long>")
    m = stretches.repartition(1).mapInArrow(fit, "weights binary, bias double, moves binary, slope double, shift double").first()
    if m is None:
        return sum(k * n for k, n in per.items()) / sum(per.values())
    return Model(np.frombuffer(m["weights"]).reshape(3, FEATURES, BINS), m["bias"], np.frombuffer(m["moves"]).reshape(2, 2), m["slope"], m["shift"])


def with_scores(docs: DataFrame, model: Model | float, name: str) -> DataFrame:
    """``docs`` with the column ``name``, the chance that a document is good."""
    shipped(docs.sparkSession)

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([scored(t.as_py(), model) for t in texts], pa.float64())

    return docs.withColumn(name, of("text"))


def rated(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each document: doc_id, held_out, score, predicted."""
    rows = with_scores(docs.select("doc_id", "text"), trained(docs, labels), "score")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
