"""Counts of what a corpus holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_counts(rows: DataFrame, key: str, label: str) -> DataFrame:
    """Per key its labels with their counts: by label, and as a line by falling count."""
    n = rows.groupBy(key, label).agg(F.count("*").alias("n"))
    g = n.groupBy(key).agg(F.collect_list(F.struct(F.col(label).alias("l"), "n")).alias("c"))
    by_label = F.transform(F.array_sort("c"), lambda x: F.concat(x["l"], F.lit("="), x["n"].cast("string")))
    by_count = F.transform(F.array_sort(F.transform("c", lambda x: F.struct((-x["n"]).alias("m"), x["l"].alias("l")))), lambda x: F.concat(x["l"], F.lit(" x"), (-x["m"]).cast("string")))
    return g.select(key, F.array_join(by_label, ",").alias("histogram"), F.array_join(by_count, ", ").alias("prompt"))


def zero_filled(rows: DataFrame, column: str, keys: list[str], name: str) -> DataFrame:
    """The count of each key of a fixed list, 0 for those that do not occur."""
    fixed = rows.sparkSession.createDataFrame([(k,) for k in keys], f"{name} string")
    n = rows.groupBy(F.col(column).alias(name)).agg(F.count("*").alias("n"))
    return F.broadcast(fixed).join(n, name, "left").select(name, F.coalesce("n", F.lit(0)).alias("n"))


def duplicate_report(rows: DataFrame, by: Column, also_by: Column) -> DataFrame:
    """Groups of equal content, their files, surplus copies, and whether another digest finds as many groups; both digests in one pass."""
    digests = rows.select(F.explode(F.array(F.struct(F.lit(1).alias("kind"), by.alias("h")), F.struct(F.lit(2).alias("kind"), also_by.alias("h")))).alias("d")).select("d.*")
    found = digests.groupBy("kind", "h").agg(F.count("*").alias("n")).where("n > 1")
    first = F.col("kind") == 1
    sums = found.agg(F.count_if(first).alias("groups"), F.coalesce(F.sum(F.when(first, F.col("n"))), F.lit(0)).alias("files"), F.coalesce(F.sum(F.when(first, F.col("n") - 1)), F.lit(0)).alias("surplus"), F.count_if(~first).alias("other"))
    return sums.select("groups", "files", "surplus", (F.col("groups") == F.col("other")).alias("agree"))


def merged_counters(parts: DataFrame, key: str, counters: str) -> DataFrame:
    """Per key the sums of map-valued counters, and of all of them."""
    n = parts.select(key, F.explode(counters).alias("name", "n")).groupBy(key, "name").agg(F.sum("n").alias("n"))
    g = n.groupBy(key).agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("name", "n"))).alias("c"))
    return g.select(key, "total", F.array_join(F.transform("c", lambda x: F.concat_ws("=", x["name"], x["n"].cast("string"))), ",").alias("merged"))


def bounding_box(points: Column) -> Column:
    """(x1, y1, x2, y2) of an array of (x, y)."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))
