"""Ordered groups: numbered contexts, fingerprints, bounded lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed


def numbered_context(rows: DataFrame, key: str, order: list[str], label: str, text: str) -> DataFrame:
    """Per key one text of numbered blocks ``[i] (label) text``, an empty line between them."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    block = F.format_string("[%d] (%s) %s", n, F.col(label), F.col(text))
    blocks = rows.select(key, n.alias("n"), block.alias("block"))
    return blocks.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.struct("n", "block")))["block"], "\n\n").alias("context"))


def tree_fingerprint(rows: DataFrame, key: str, place: str, text: str, bits: int = 10, levels: int = 4) -> DataFrame:
    """Per key the first 16 digits of a digest of its texts in the order of ``place`` (a long, different in each row of
    a key). Digests of 2**bits neighbouring places are digested again, level by level, so that no group is larger than
    that however many rows a key has; places beyond bits * levels meet at the last level."""
    held = rows.select(key, F.col(place).alias("place"), F.concat_ws("\0", F.col(place).cast("string"), F.col(text)).alias("digest"))
    for level in range(levels):
        above = F.shiftright("place", bits) if level < levels - 1 else F.lit(0).cast("long")
        ordered = F.array_sort(F.collect_list(F.struct("place", "digest")))
        held = held.groupBy(key, above.alias("above")).agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["digest"]), "\0"), 256).alias("digest")).withColumnRenamed("above", "place")
    return held.select(key, F.left("digest", F.lit(16)).alias("fingerprint"))


def bounded_list(rows: DataFrame, key: str, order: list[str], value: str, head: int, tail: int, name: str) -> DataFrame:
    """Per key the first and last values in order, comma-joined, with an ellipsis where there are more."""
    w = Window.partitionBy(key)
    ends = rows.withColumn("i", F.row_number().over(w.orderBy(*order))).withColumn("n", F.count("*").over(w))
    kept = ends.where((F.col("i") <= head) | (F.col("i") > F.col("n") - tail))
    g = kept.groupBy(key).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", F.col(value).alias("v")))).alias("c"))
    values = F.transform("c", lambda x: x["v"])
    short = F.concat(F.slice(values, 1, head), F.array(F.lit("…")), F.slice(values, -tail, tail))
    return g.select(key, F.array_join(F.when(F.col("n") > head + tail, short).otherwise(values), ",").alias(name))


def global_rank(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """The place of each row in the order of all, from 1, without one task for all: rows are sorted into ranges,
    numbered within each, and shifted by the sizes of the ranges before."""
    # checkpointed, so that the sizes and the rows are those of the same ranges
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id()).withColumn("within", F.monotonically_increasing_id() % (1 << 33))
    placed = checkpointed(placed)
    sizes = placed.groupBy("range").agg(F.count("*").alias("size"))  # a row for each partition
    before = sizes.withColumn("before", F.sum("size").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)))
    return placed.join(F.broadcast(before.drop("size")), "range").select(*rows.columns, (F.coalesce("before", F.lit(0)) + F.col("within") + 1).alias(name))


def quantiles(rows: DataFrame, key: str, value: str, share: float, name: str) -> DataFrame:
    """(key, name): of each key's values the one at place ceil(share * n), exact and without a key's values in one task:
    all rows are ranked together by key and value, and each key's place follows from the keys' counts."""
    ranked = global_rank(rows.where(F.col(value).isNotNull()).select(key, value), [key, value], "place")
    first = ranked.groupBy(key).agg(F.min("place").alias("first"), F.count("*").alias("n"))
    wanted = first.select(key, (F.col("first") - 1 + F.greatest(F.ceil(F.lit(share) * F.col("n")), F.lit(1))).alias("place"))
    return ranked.join(wanted, [key, "place"]).select(key, F.col(value).alias(name))
