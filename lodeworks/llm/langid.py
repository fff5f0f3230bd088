"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the 1- to 3-grams of the lower-cased text's characters, hashed to ``BUCKETS``
buckets, with logarithmic counts, inverse document frequencies over all rows that may teach,
and unit length. The model is fitted by follow-the-regularised-leader with elastic-net
penalties on a bounded sample of the labelled rows, then calibrated by one temperature on the
part of the sample that the fit did not see; copies of a text are on one side. One task holds the
sample and fits, and the driver gets nothing but the model's weights.

Rows whose crc32(doc_id as text) mod ``FOLDS`` is 0 are held out: nothing is learned from them.

Defined results: a text that is null or has no letter is ``und`` with score 0, and so is every
text where no labelled row teaches; a null lang or null doc_id teaches nothing; a null doc_id is
not held out; ties go to the first label in order; repeated rows get the same prediction; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import handed_back, shipped, unused

FOLDS = 5
BUCKETS = 1 << 14
#: Labelled rows of each language that the model is fitted on, about (all, if there are fewer), and of all languages at most, about.
FIT_ROWS, FIT_TOTAL = 1500, 12_000
EPOCHS = 4
ALPHA, BETA, LASSO, RIDGE = 0.3, 1.0, 0.02, 0.1
UNKNOWN = "und"
#: Rows are accepted from the score that ``KEPT`` of the labelled rows reach, or so many times a blind guess, if that is less.
KEPT, GUESS = 0.999, 1.25
BINS = 10_000
#: Characters that are counted at once.
CHUNK = 1 << 18
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


class Model(NamedTuple):
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray  # bucket x label
    temperature: float


def counts(text: str) -> np.ndarray:
    """How often each bucket's n-grams occur in the text."""
    held = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros(BUCKETS, np.int64)
    for i in range(0, len(held), CHUNK):
        part, run = held[i : i + CHUNK + 2], np.zeros((), np.uint32)
        for n in range(3):
            run = (run[: len(part) - n] if n else run) * np.uint32(31) + part[n:] * _MULTIPLIERS[n] + np.uint32(n)
            own = run[:CHUNK]  # those that begin in this chunk
            out += np.bincount((own * np.uint32(0x9E3779B1)) >> np.uint32(32 - 14), minlength=BUCKETS)
    return out


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def features(count: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(count)
    x = np.log1p(count[at]) * idf[at]
    return at, x / max(np.sqrt(x @ x), 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fitted(rows: list[tuple[np.ndarray, np.ndarray, int, bool]], labels: list[str], idf: np.ndarray) -> Model:
    """rows: buckets, features and label of each text, and whether it is for calibration, in the order of learning."""
    z, n = np.zeros((BUCKETS, len(labels))), np.zeros((BUCKETS, len(labels)))
    one_hot = np.eye(len(labels))

    def weights(at):
        return np.where(np.abs(z[at]) <= LASSO, 0, (np.sign(z[at]) * LASSO - z[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + RIDGE))

    kept, taught = [r for r in rows if r[3]] or rows, [r for r in rows if not r[3]] or rows
    for _ in range(EPOCHS):
        for at, x, label, _ in taught:
            w = weights(at)
            g = np.outer(x, softmax(x @ w) - one_hot[label])
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(slice(None))
    logits, own = np.array([x @ w[at] for at, x, *_ in kept]), np.array([r[2] for r in kept])
    tried = np.exp(np.linspace(np.log(0.05), np.log(5), 60))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(own)), own], 1e-12)).mean() for t in tried]
    return Model(labels, idf, w.astype(np.float32), float(tried[int(np.argmin(loss))]))


def teaching(docs: DataFrame) -> DataFrame:
    """The rows that may teach: id, text and label."""
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), "text", F.col("lang").alias("label"))
    return rows.where((F.crc32(F.col("id").cast("binary")) % FOLDS != 0) & F.col("label").isNotNull() & F.col("text").isNotNull())


def trained(docs: DataFrame) -> Model | None:
    """The model of the rows that may teach; None where none does."""
    shipped(docs.sparkSession)
    rows = teaching(docs)
    per_label = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not per_label:
        return None
    labels = sorted(per_label)

    def frequencies(batches):
        seen = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                seen += counts(text.as_py()) > 0
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["bucket", "n"])

    found = rows.select("text").mapInArrow(frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # BUCKETS rows at most
    often = np.zeros(BUCKETS)
    for r in found:
        often[r["bucket"]] = r["n"]
    idf = np.log((1 + sum(per_label.values())) / (1 + often)) + 1

    most = max(1, min(FIT_ROWS, FIT_TOTAL // len(labels)))
    share = F.create_map(*[F.lit(x) for k, v in per_label.items() for x in (k, min(1.0, most / v))])
    picked = F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1_000_000)) < 1_000_000 * share[F.col("label")]
    if rows.where(picked).count() > 2 * most * len(labels) + 1000:  # an id of many rows is among them: tell its rows apart
        picked = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(1_000_000)) < 1_000_000 * share[F.col("label")]
    sample = rows.withColumn("picked", picked).where("picked").select("text", "label", F.xxhash64("id", F.lit("order")).alias("order"), (F.pmod(F.xxhash64("text"), F.lit(5)) == 4).alias("apart"))

    def sparse(batches):
        for batch in batches:
            made = [features(counts(text.as_py()), idf) for text in batch.column("text")]
            at = pa.array([at.astype(np.int16) for at, _ in made], pa.list_(pa.int16()))
            x = pa.array([x.astype(np.float32) for _, x in made], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column("order"), at, x, batch.column("label"), batch.column("apart")], ["order", "at", "x", "label", "apart"])

    def fit(batches):
        number, held = {k: i for i, k in enumerate(labels)}, []
        for batch in batches:
            columns = [batch.column(c) for c in ("order", "at", "x", "label", "apart")]
            # views of the batch: the sample is held once, without copies
            held += [(o.as_py(), at.values.to_numpy(), x.values.to_numpy(), number[k.as_py()], apart.as_py()) for o, at, x, k, apart in zip(*columns, strict=True)]
        if held:
            held.sort(key=lambda r: (r[0], r[3], len(r[1]), r[1].tobytes()))  # the same for each run, whatever order the shuffle gives
            model = fitted([r[1:] for r in held], labels, idf)
            held.clear()
            columns = batch = None
            handed_back()
            yield pa.RecordBatch.from_arrays([pa.array([model.temperature]), pa.array([model.weights.tobytes()])], ["temperature", "weights"])

    vectors = sample.mapInArrow(sparse, "order long, at array<smallint>, x array<float>, label string, apart boolean")
    model = vectors.repartition(1).mapInArrow(fit, "temperature double, weights binary").first()  # FIT_TOTAL rows, about
    if model is None:
        return None
    return Model(labels, idf, np.frombuffer(model["weights"], np.float32).reshape(BUCKETS, len(labels)), model["temperature"])


def predict(text: str | None, model: Model | None) -> tuple[str, float]:
    if model is None or not has_letter(text):
        return UNKNOWN, 0.0
    at, x = features(counts(text), model.idf)
    p = softmax((x @ model.weights[at]) / model.temperature)
    best = int(np.argmax(p))
    return model.labels[best], float(p[best])


def identified(docs: DataFrame, model: Model | None, name: str = "predicted") -> DataFrame:
    """``docs`` with the column ``name``: lang_pred and score."""
    shipped(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([predict(t, model) for t in texts], columns=["lang_pred", "score"])
            handed_back()

    return docs.withColumn(name, of("text"))


def predictions(docs: DataFrame) -> DataFrame:
    """One row per document: whether it is held out, its language and the score."""
    model = trained(docs)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))
    rows = identified(docs.select(F.col("doc_id").cast("long"), "text"), model)
    return rows.select("doc_id", held_out.alias("held_out"), "predicted.lang_pred", "predicted.score")


def bound(docs: DataFrame, model: Model) -> float:
    """The least score of an accepted row, learned over all rows that may teach and whose label is predicted."""
    rows = identified(teaching(docs).select("text", "label"), model).where(F.col("predicted.lang_pred") == F.col("label"))
    bins = {r["bin"]: r["count"] for r in rows.groupBy(F.floor(F.col("predicted.score") * BINS).alias("bin")).count().collect()}  # BINS rows at most
    least = GUESS / len(model.labels)
    missed, allowed = 0, sum(bins.values()) * (1 - KEPT)
    for k in sorted(bins):
        missed += bins[k]
        if missed > allowed:
            return min(least, k / BINS)
    return 0.0


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text has a letter and a language that is no mere guess; where nothing teaches, all that have a letter."""
    model = trained(docs)
    if model is None:
        lettered = F.pandas_udf(lambda texts: texts.map(has_letter).astype(bool), "boolean")
        return docs.where(lettered("text"))
    name = unused(docs, "predicted")
    found = F.col(name)
    return identified(docs, model, name).where((found["lang_pred"] != UNKNOWN) & (found["score"] >= bound(docs, model))).drop(name)
