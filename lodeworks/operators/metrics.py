"""Measures of retrieval quality over rankings (query_id, rank, id) and judgements (query_id, id, gain)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def judged(rankings: DataFrame, judgements: DataFrame) -> DataFrame:
    """The rankings with the gain of each row, 0 where it is not judged."""
    return rankings.join(judgements, ["query_id", "id"], "left").withColumn("gain", F.coalesce("gain", F.lit(0)))


def class_gains(rankings: DataFrame, asked: DataFrame, rows: DataFrame, by: str = "label") -> DataFrame:
    """``judged`` where the judgements of a query (asked: query_id, class) are all rows of its class (rows: id, class, gain) but its own: they are
    told from the classes, and never made, as they grow with the square of the rows."""
    placed = rankings.join(asked, "query_id", "left")
    return placed.join(rows.select("id", by, "gain"), ["id", by], "left").drop(by).withColumn("gain", F.when(F.col("id") == F.col("query_id"), 0).otherwise(F.coalesce("gain", F.lit(0))))


def class_counts(asked: DataFrame, rows: DataFrame, by: str = "label") -> DataFrame:
    """(query_id, n_rel): how many rows of its class are relevant for a query, its own left out; only where there are any."""
    held = rows.where("gain > 0")
    own = held.groupBy(F.col("id").alias("query_id"), by).agg(F.count("*").alias("own"))
    every = asked.join(held.groupBy(by).agg(F.count("*").alias("n")), by).join(own, ["query_id", by], "left")
    return every.select("query_id", (F.col("n") - F.coalesce("own", F.lit(0))).alias("n_rel")).where("n_rel > 0")


def class_first(asked: DataFrame, rows: DataFrame, n: int, *order: str | Column, by: str = "label") -> DataFrame:
    """(query_id, id, gain, place): the first ``n`` rows of its class for each query, its own left out; so n + 1 of a class are enough."""
    of_class = rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place") <= n + 1).drop("place")
    others = asked.join(of_class, by).where("id <> query_id").drop(by)
    return others.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("place") <= n)


def per_query_by_class(rankings: DataFrame, asked: DataFrame, rows: DataFrame, k: int = 5, cap: int = 10, by: str = "label") -> DataFrame:
    """``per_query`` with the judgements of ``class_gains``."""
    top = class_first(asked, rows, cap, F.desc("gain"), "id", by=by)
    return _measured(class_gains(rankings, asked, rows, by), class_counts(asked, rows, by), top, k, cap)


def per_query(rankings: DataFrame, judgements: DataFrame, k: int = 5, cap: int = 10) -> DataFrame:
    """recall_at_k (by what k can hold), recall_of_all, reciprocal rank (uncapped and capped), and graded and binary nDCG."""
    relevant = judgements.where("gain > 0").groupBy("query_id").agg(F.count("*").alias("n_rel"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gain"), "id"))
    top = judgements.withColumn("place", place).where(F.col("place") <= cap)
    return _measured(judged(rankings, judgements), relevant, top, k, cap)


def _measured(rows: DataFrame, relevant: DataFrame, top: DataFrame, k: int, cap: int) -> DataFrame:
    discount = F.log2(F.col("place") + F.lit(1.0))
    ideal = top.groupBy("query_id").agg(F.sum(F.col("gain") / discount).alias("ideal"), F.sum(F.when(F.col("gain") > 0, 1 / discount).otherwise(0.0)).alias("ideal_binary"))
    hit, seen = F.col("gain") > 0, F.log2(F.col("rank") + F.lit(1.0))
    found = rows.groupBy("query_id").agg(
        F.count_if(hit & (F.col("rank") <= k)).alias("hits"),
        F.min(F.when(hit, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("rank") <= cap, F.col("gain") / seen).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(hit & (F.col("rank") <= cap), 1 / seen).otherwise(0.0)).alias("dcg_binary"),
    )
    every = found.join(relevant, "query_id", "left").join(ideal, "query_id", "left")

    def share(a: Column, b: Column) -> Column:
        return F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)

    return every.select(
        "query_id",
        share(F.col("hits"), F.least("n_rel", F.lit(k))).alias("recall_at_k"),
        share(F.col("hits"), F.col("n_rel")).alias("recall_of_all"),
        share(F.lit(1.0), F.col("first")).alias("reciprocal_rank"),
        share(F.when(F.col("first") <= cap, 1.0), F.col("first")).alias("reciprocal_rank_capped"),
        share(F.col("dcg"), F.col("ideal")).alias("ndcg"),
        share(F.col("dcg_binary"), F.col("ideal_binary")).alias("ndcg_binary"),
    )

