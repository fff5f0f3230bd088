"""Exact top-k search by inner product with pivot-table elimination.

Every vector keeps its distances to a number of pivots. By the triangle inequality the largest
difference of two vectors' entries is a lower bound of their distance, and so an upper bound of
their inner product. A query's candidates are evaluated in the order of that bound, and the
search stops once the next bound lies below the k-th best score: the result is exact. No part of
the table starts from nothing: the k-th best score of a query among the sample that the pivots
come from is a floor that all of them share.

Queries are dealt into blocks and candidates into parts, both of bounded bytes; each task holds
one block against one part and passes on k rows per query at most.

Defined results: a vector that is null, empty, or holds null, NaN or infinity takes no part, nor
does a row with a null vec_id; scores are between vectors of one length; a query's own row is
left out, but a repeated row (same vec_id) is a candidate like any other, and each such row asks
its own query; ties go to the smaller vec_id; fewer than k candidates give fewer rows; an empty
table gives an empty result; other columns are ignored. Scores beyond a long are its largest or
smallest value.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shipped, staged

PIVOTS = 24
#: Vectors that the pivots are chosen from (any choice gives exact results).
PIVOT_SAMPLE = 1000
#: Bytes of the queries of a block and of the candidates of a part, about, and rows of a part at least where there are cores for more parts.
BLOCK_BYTES, PART_BYTES, PART_ROWS = 16 << 20, 16 << 20, 2048
#: Queries whose bounds are held at once.
AT_ONCE = 64
#: Candidates that are evaluated between two looks at the bound.
STEP = 256
#: Slack of a bound for rounding: of a distance, and shares of distances and of squares.
SLACK, SHARE_OF_DISTANCE, SHARE_OF_SQUARE = 0.05, 1e-12, 1e-9
_LONG = (1 << 63) - 1


def whole(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def _matrix(column: pa.ChunkedArray | pa.Array, kind) -> np.ndarray:
    held = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return held.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(held), -1)


def spread(vectors: np.ndarray, n: int) -> np.ndarray:
    """n of the vectors, each as far from those before it as can be."""
    if not len(vectors):
        return vectors
    chosen, far = [0], np.linalg.norm(vectors - vectors[0], axis=1)
    while len(chosen) < min(n, len(vectors)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(vectors - vectors[chosen[-1]], axis=1))
    return vectors[chosen]


def _products(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in a type in which their inner products are exact: doubles, or whole numbers of any size."""
    wide = x.shape[1] * float(np.abs(q).max(initial=1)) * float(np.abs(x).max(initial=1)) >= 2.0**52
    return (q.astype(object), x.astype(object)) if wide else (q.astype(np.float64), x.astype(np.float64))


def best(q: np.ndarray, qp: np.ndarray, q_row: np.ndarray, floor: np.ndarray, x: np.ndarray, xp: np.ndarray, x_row: np.ndarray, x_id: np.ndarray, k: int):
    """(query, candidates, scores, how many were evaluated) of each query's k best candidates that reach its floor.
    q, x: whole components; qp, xp: distances to pivots."""
    q2, x2 = ((y.astype(np.float64) ** 2).sum(axis=1) for y in (q, x))
    q, x = _products(q, x)
    for a in range(0, len(q), AT_ONCE):
        low = np.zeros((len(q[a : a + AT_ONCE]), len(x)))
        for p in range(qp.shape[1]):
            one, other = qp[a : a + AT_ONCE, p, None], xp[None, :, p]
            np.maximum(low, np.abs(one - other) - SHARE_OF_DISTANCE * (one + other), out=low)
        low = np.maximum(low - SLACK, 0)
        squares = q2[a : a + AT_ONCE, None] + x2[None, :]
        bound = (squares - low * low) / 2 + SHARE_OF_SQUARE * squares
        for i in range(a, min(a + AT_ONCE, len(q))):
            order = np.argsort(-bound[i - a], kind="stable")
            bounds, done = bound[i - a][order], 0
            at, score = np.empty(0, np.int64), np.empty(0, x.dtype)
            least = floor[i]
            for s in range(0, len(order), STEP):
                if bounds[s] < least - 0.5:
                    break
                part = order[s : s + STEP]
                part = part[x_row[part] != q_row[i]]
                done += len(part)
                found = x[part] @ q[i]
                near = found >= floor[i]
                at, score = np.concatenate((at, part[near])), np.concatenate((score, found[near]))
                first = np.lexsort((x_id[at], -score))[:k]
                at, score = at[first], score[first]
                if len(at) == k:
                    least = max(least, float(score[k - 1]))
            yield i, at, score, done


def floors(q: np.ndarray, q_row: np.ndarray, x: np.ndarray, x_row: np.ndarray, k: int) -> np.ndarray:
    """What each query's k-th best score is at least: its k-th best among x, some of the candidates."""
    out = np.full(len(q), -np.inf)
    if len(x) > k:
        q, x = _products(q, x)
        for i in range(len(q)):
            found = np.sort(x[x_row != q_row[i]] @ q[i])
            out[i] = np.nextafter(float(found[-k]), -np.inf)
    return out


FOUND = "query_id long, query_row long, vec_id long, score long"


def searched(vectors: DataFrame, every: int = 100, k: int = 10, scale: int = 1024) -> DataFrame:
    """The k best of all rows for each row whose vec_id is divisible by ``every``: query_id, rank, vec_id, score."""
    shipped(vectors.sparkSession)
    fine = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    part_of = vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & fine)
    rows = part_of.select(F.col("vec_id").cast("long"), F.monotonically_increasing_id().alias("row"), whole(F.col("embedding"), scale).alias("x"))
    rows = rows.withColumn("asked", F.col("vec_id") % every == 0)
    sample = rows.orderBy(F.xxhash64("vec_id"), "row").limit(PIVOT_SAMPLE).select("row", "x").toArrow()
    by_length: dict[int, list] = {}
    for r, v in zip(sample["row"].to_pylist(), sample["x"].to_pylist(), strict=True):
        by_length.setdefault(len(v), []).append((r, v))
    known = {n: (np.array([r for r, _ in held]), np.array([v for _, v in held], np.int64)) for n, held in by_length.items()}
    pivots = {n: spread(v.astype(np.float64), PIVOTS) for n, (_, v) in known.items()}

    def measured(batches):
        for batch in batches:
            far, least = [], []
            for v, row, asked in zip(batch.column("x"), batch.column("row").to_pylist(), batch.column("asked").to_pylist(), strict=True):
                v = np.asarray(v.values, np.int64)
                near = pivots.get(len(v))
                far.append([] if near is None else np.linalg.norm(near - v, axis=1))
                held = known.get(len(v))
                least.append(float(floors(v[None], np.array([row]), held[1], held[0], k)[0]) if asked and held else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(far, pa.list_(pa.float64())), pa.array(least, pa.float64())], [*batch.schema.names, "p", "floor"])

    index = staged(rows.mapInArrow(measured, "vec_id long, row long, x array<long>, asked boolean, p array<double>, floor double"), "pivot-table")
    size = 8 * (F.size("x") + F.size("p"))
    total = index.agg(F.count("*").alias("n"), F.sum(size).alias("size"), F.sum(F.when(F.col("asked"), size)).alias("asked")).first()
    blocks = max(1, -(-(total["asked"] or 0) // BLOCK_BYTES))
    parts = max(1, -(-(total["size"] or 0) // PART_BYTES), min(vectors.sparkSession.sparkContext.defaultParallelism, -(-total["n"] // PART_ROWS)))
    queries = index.where("asked").withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>")))
    others = index.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[list] = [[], [], [], []]
        for n in pc.list_value_length(left["x"]).unique().to_pylist():
            q = left.filter(pc.equal(pc.list_value_length(left["x"]), n))
            x = right.filter(pc.equal(pc.list_value_length(right["x"]), n))
            if not len(x):
                continue
            ids, q_ids, q_rows = x["vec_id"].to_numpy(), q["vec_id"].to_numpy(), q["row"].to_numpy()
            floor = q["floor"].to_numpy(zero_copy_only=False).astype(np.float64)
            floor[np.isnan(floor)] = -np.inf
            for i, at, score, _ in best(_matrix(q["x"], np.int64), _matrix(q["p"], np.float64), q_rows, floor, _matrix(x["x"], np.int64), _matrix(x["p"], np.float64), x["row"].to_numpy(), ids, k):
                for column, values in zip(found, ([q_ids[i]] * len(at), [q_rows[i]] * len(at), ids[at], [max(-_LONG - 1, min(_LONG, int(s))) for s in score]), strict=True):
                    column.extend(values)
        return pa.table([pa.array(c, pa.int64()) for c in found], ["query_id", "query_row", "vec_id", "score"])

    pairs = queries.groupBy("block", "part").cogroup(others.groupBy("block", "part")).applyInArrow(met, FOUND)
    first = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
