"""Vector codes: product quantization in exact integers, by GEMM over limbs.

Components become integers, vectors are cut into equal parts, and each part is coded by the nearest entry of its codebook. Distances
come from dot products: both sides are split into limbs so short that a float64 BLAS product of two limbs stays below 2**53 and
is exact; the limbs' products are put together in 64-bit integers, and the first least distance wins. So codes hang neither on
the order of rows nor on the machine.

Each round is one pass over the staged integers: a task sums its parts entry by entry, Spark adds the tasks' sums up, and the
driver divides (parts x entries rows, however many vectors there are).

Defined results. Vectors that are null, or hold null or components that are not finite, take no part; nor do empty vectors, those whose
length is not a multiple of the parts, and those that are not as long as the one with the smallest vec_id. An integer component beyond
what keeps errors within 64 bits (2**27 for vectors of up to 64 components) counts as that bound; a label's error beyond 64
bits is null. Null vec_ids come last and are coded as others; ties of vec_id go to the lesser vector; repeated rows are coded alike
and count as often as they are there. With fewer vectors than entries there are fewer entries. An empty table gives an empty
result. Other columns than vec_id, embedding and label are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined, shipped, staged

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Rows that are multiplied at once.
BLOCK = 4096


def bound(length: int) -> int:
    """The largest magnitude of integers whose squared distances over ``length`` components fit into 62 bits."""
    return min(1 << 27, 1 << ((60 - max(length - 1, 0).bit_length()) // 2))


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """``x`` as float64 arrays with x = sum(limb * 2**(bits * i)); all but the last are in [0, 2**bits), the last is signed and as short."""
    out = []
    while True:
        if x.size == 0 or max(int(x.max()), -int(x.min())) < 1 << bits:
            return [*out, x.astype(np.float64)]
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact dot products of the rows of two int64 matrices."""
    bits = (52 - max(a.shape[1] - 1, 0).bit_length()) // 2
    out = np.zeros((a.shape[0], b.shape[0]), np.int64)
    for i, x in enumerate(limbs(a, bits)):
        for j, y in enumerate(limbs(b, bits)):
            out += (x @ y.T).astype(np.int64) << (bits * (i + j))
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first nearest entry, squared distance) of each row."""
    far = (book * book).sum(1)[None, :] - 2 * products(x, book)
    at = far.argmin(1)
    return at, far[np.arange(len(x)), at] + (x * x).sum(1)


def _matrices(batches: Iterable[pa.RecordBatch], column: str, length: int):
    """(batch, its int64 matrix) in blocks."""
    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK):
            block = batch.slice(i, BLOCK)
            yield block, block.column(column).flatten().to_numpy(zero_copy_only=False).reshape(block.num_rows, length)


def integers(vectors: DataFrame, parts: int = PARTS, scale: int = SCALE) -> tuple[DataFrame, int]:
    """The staged (vec_id, label, x) of the vectors that take part, and their length."""
    x = F.col("embedding").cast("array<double>")
    whole = F.col("embedding").isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    n = F.size("embedding")
    fit = vectors.where(F.coalesce(whole, F.lit(False)) & (n > 0) & (n % parts == 0))
    first = fit.select("vec_id", n.alias("n"), "embedding").orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("n").limit(1).collect()
    length = first[0]["n"] if first else 0
    most = bound(length)
    held = F.transform(x, lambda v: F.greatest(F.least(F.floor(F.least(F.greatest(v, F.lit(-1e12)), F.lit(1e12)) * scale), F.lit(most)), F.lit(-most)))
    label = F.col("label").cast("string") if "label" in vectors.columns else F.lit(None).cast("string")
    rows = fit.where(n == length).select("vec_id", label.alias("label"), held.alias("x"))
    return staged(rows, "integers"), length


def seeds(rows: DataFrame, entries: int = ENTRIES) -> np.ndarray:
    """The vectors of the smallest vec_ids, in their order."""
    held = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    return np.array([r["x"] for r in held], np.int64)


def _sums(rows: DataFrame, books: np.ndarray) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """By part and entry: how many vectors' parts are nearest to it, and their sums."""
    parts, entries, width = books.shape

    def summed(batches):
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for _, m in _matrices(batches, "x", parts * width):
            for p in range(parts):
                x = m[:, p * width : (p + 1) * width]
                at, _ = nearest(x, books[p])
                np.add.at(total[p], at, x)
                count[p] += np.bincount(at, minlength=entries)
        used = np.argwhere(count)
        if len(used):
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([int(p) for p, _ in used], pa.int32()), "entry": pa.array([int(e) for _, e in used], pa.int32()), "k": pa.array([int(count[p, e]) for p, e in used], pa.int64()), "s": pa.array([total[p, e].tolist() for p, e in used], pa.list_(pa.int64()))}
            )

    each = rows.select("x").mapInArrow(summed, "part int, entry int, k long, s array<long>")
    added = each.groupBy("part", "entry").agg(F.sum("k").alias("k"), F.array(*[F.sum(F.col("s")[i]) for i in range(width)]).alias("s"))
    return {(r["part"], r["entry"]): (r["k"], r["s"]) for r in added.collect()}


def trained(rows: DataFrame, length: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks (part, entry, component) after all rounds."""
    first = seeds(rows, entries)
    books = np.stack([first[:, p * (length // parts) : (p + 1) * (length // parts)] for p in range(parts)])
    for _ in range(rounds):
        for (p, e), (count, sums) in _sums(rows, books).items():
            books[p, e] = [s // count for s in sums]
    return books


def coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of each vector."""
    parts, entries, width = books.shape

    def codes(batches):
        for block, m in _matrices(batches, "x", parts * width):
            found = [nearest(m[:, p * width : (p + 1) * width], books[p]) for p in range(parts)]
            marks = np.stack([at for at, _ in found], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [block.column("vec_id"), block.column("label"), pa.array([r.tobytes().hex() for r in marks], pa.string()), pa.array(sum(e for _, e in found), pa.int64())], names=["vec_id", "label", "code", "error"]
            )

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(codes, f"vec_id {kind}, label string, code string, error long")


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """For each vector: vec_id, code, error, label_error, codebooks_sha256."""
    shipped(vectors.sparkSession)
    rows, length = integers(vectors, parts, scale)
    if rows.isEmpty():
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    books = trained(rows, length, parts, entries, rounds)
    out = staged(coded(rows, books), "codes").withColumn("label", _keyed(F.col("label")))
    per = out.groupBy("label").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("k"))
    with_sums = joined(out, per.drop("k"), ["label"], ["vec_id", "code"], counts=per.select("label", "k"))
    return with_sums.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _keyed(label: Column) -> Column:
    """A label as a key that null has too."""
    return F.coalesce(F.concat(F.lit("="), label), F.lit(""))
