"""Filtered exact nearest neighbours by cosine, with quotas per source.

Queries are dealt into blocks, the corpus into parts, both of bounded size; a task multiplies one
block with one part and passes on each query's best candidates of each source, and a window over
what is left makes the final cut. Nothing is collected or broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries in a block and corpus rows in a part, about.
BLOCK, PART = 512, 8192
#: Decimals that a score is rounded to before it is ranked, so that engines agree on ties.
DIGITS = 6


def nearest(queries: DataFrame, corpus: DataFrame, quota: int | dict[str, int]) -> DataFrame:
    """(query_id, id, source, score, source_rank): each query's best ``quota`` of each source, its own id left out.
    queries: query_id, vector; corpus: id, source, vector. Filters belong on the corpus, before."""
    blocks, parts = max(1, -(-queries.count() // BLOCK)), max(1, -(-corpus.count() // PART))
    left = queries.select("query_id", "vector", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>")).alias("part"))
    right = corpus.select("id", F.col("source").cast("string").alias("source"), "vector", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")).alias("block"))
    most = max(quota.values()) if isinstance(quota, dict) else quota

    def met(q: pa.Table, x: pa.Table) -> pa.Table:
        def unit(t):
            m = t["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(t), -1)
            length = np.linalg.norm(m, axis=1, keepdims=True)
            return np.divide(m, length, out=np.zeros_like(m), where=length > 0)

        columns: list[list] = [[], [], [], []]
        if len(q) and len(x):
            scores = np.round(unit(q) @ unit(x).T, DIGITS)
            ids, sources, asked = x["id"].to_numpy(), np.array(x["source"].to_pylist(), object), q["query_id"].to_numpy()
            for source in dict.fromkeys(sources):
                own = np.flatnonzero(sources == source)
                for i in range(len(asked)):
                    s = scores[i, own]
                    cut = min(most + 1, len(own))  # one more, for the query's own row
                    kept = own[s >= np.partition(s, -cut)[-cut]]
                    kept = kept[ids[kept] != asked[i]]
                    kept = kept[np.lexsort((ids[kept], -scores[i, kept]))][:most]
                    for column, values in zip(columns, ([asked[i]] * len(kept), ids[kept], [source] * len(kept), scores[i, kept]), strict=True):
                        column.extend(values)
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.float64())], ["query_id", "id", "source", "score"])

    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(met, "query_id long, id long, source string, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "source").orderBy(F.desc("score"), "id"))
    allowed = F.lit(quota) if isinstance(quota, int) else F.create_map(*[F.lit(v) for kv in quota.items() for v in kv])[F.col("source")]
    return found.withColumn("source_rank", rank).where(F.col("source_rank") <= allowed)


def search(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, score): each query's k best of the corpus."""
    one = corpus.select("id", F.lit("all").alias("source"), "vector")
    return nearest(queries, one, k).select("query_id", F.col("source_rank").alias("rank"), "id", "score")
