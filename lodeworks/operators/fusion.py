"""Grouping, rank fusion, diversification and re-ranking of candidates. All ranks have a tie-break by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the ranking rules.
RRF_CONSTANT, PER_POST, MOMENTS = 60, 3, 3
TERM_BOOST, MOST_BOOST = 0.02, 0.08
DEFAULT_K, MOST_K = 5, 50


def resolved_k(k: Column) -> Column:
    return F.least(F.coalesce(k, F.lit(DEFAULT_K)), F.lit(MOST_K))


def above(candidates: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """The candidates that reach their source's threshold; to be asked before anything is grouped or fused."""
    t = F.create_map(*[F.lit(v) for kv in thresholds.items() for v in kv])
    return candidates.where(F.col("score") >= F.coalesce(t[F.col("source")], F.lit(0.0)))


def by_entity(candidates: DataFrame, entity: str) -> DataFrame:
    """Best score of each entity per query and source, and how many candidates it has."""
    return candidates.groupBy("query_id", "source", entity).agg(F.max("score").alias("score"), F.count("*").alias("hits"))


def source_ranks(groups: DataFrame, entity: str) -> DataFrame:
    w = Window.partitionBy("query_id", "source").orderBy(F.desc("score"), entity)
    return groups.withColumn("source_rank", F.row_number().over(w))


def fused(ranked: DataFrame, entity: str, weights: dict[str, float] | None = None) -> DataFrame:
    """Reciprocal rank fusion: the sum of weight / (constant + rank) over the sources, and the fused rank."""
    weight = F.coalesce(F.create_map(*[F.lit(v) for kv in weights.items() for v in kv])[F.col("source")], F.lit(1.0)) if weights else F.lit(1.0)
    sums = ranked.groupBy("query_id", entity).agg(F.round(F.sum(weight / (RRF_CONSTANT + F.col("source_rank"))), 9).alias("fused_score"))
    return sums.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("fused_score"), entity)))


def diversified(ranked: DataFrame, key: str, most: int = PER_POST) -> DataFrame:
    """At most ``most`` rows of a key in order; the others follow after all of these."""
    nth = F.row_number().over(Window.partitionBy("query_id", key).orderBy("rank"))
    again = Window.partitionBy("query_id").orderBy(F.col("nth") > most, "rank")
    return ranked.withColumn("nth", nth).withColumn("new_rank", F.row_number().over(again)).drop("nth")


def apart_in_time(events: Column, most: int = MOMENTS) -> Column:
    """Of an array of (score, start, end) the best ones that do not overlap, at most ``most``, by start.
    Best first, ties by start; a fold over the array, whose result is short."""
    best = F.array_sort(events, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))
    none = F.slice(best, 1, 0)

    def step(kept: Column, x: Column) -> Column:
        free = ~F.exists(kept, lambda k: (k["start"] < x["end"]) & (x["start"] < k["end"]))
        return F.when((F.size(kept) < most) & free, F.array_append(kept, x)).otherwise(kept)

    return F.array_sort(F.aggregate(best, none, step), lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))


def reranked(candidates: DataFrame, k: int) -> DataFrame:
    """Boosted by terms shared with the query, equal contents once (the first), k best; ties to the earlier position.
    candidates: query_id, rank, id, score, query_terms, terms, content."""
    first = F.row_number().over(Window.partitionBy("query_id", "content").orderBy("rank"))
    once = candidates.where(F.col("content") != "").withColumn("nth", first).where("nth = 1")
    boost = F.least(F.size(F.array_intersect("query_terms", "terms")) * TERM_BOOST, F.lit(MOST_BOOST))
    out = once.withColumn("boosted", F.round(F.col("score") + boost, 6))
    return out.withColumn("new_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("boosted"), "rank"))).where(F.col("new_rank") <= k).select("query_id", "new_rank", "id", "boosted")
