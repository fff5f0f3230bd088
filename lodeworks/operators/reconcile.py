"""Differences of two versions of a table by hash trees over ranges of ids, so that only ranges that differ are read.

A snapshot holds its rows in folders by range, and a digest for each range, for each ``FAN`` ranges, and so on up to one for all. Two snapshots are
compared from the top: children are looked at only where their parents differ. A difference in a few ranges costs these ranges and a few
digests, whatever the tables' size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .merge import index_actions

#: Children of a node; ranges up to which they are named in the filter of the read (beyond, they are joined).
FAN, NAMED = 64, 4096


@dataclass(frozen=True)
class Snapshot:
    spark: SparkSession
    folder: str

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/rows")

    def digests(self) -> DataFrame:
        return self.spark.read.schema("level int, node long, digest long").parquet(f"{self.folder}/digests")

    def scopes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/scopes")


def snapshot(rows: DataFrame, folder: str, key: str, compared: list[str], scope: str, width: int) -> Snapshot:
    """``rows`` (a whole number as key, without null) as a snapshot; ``width`` keys make a range. The order of rows does not matter to
    digests, and rows that are there twice count twice."""
    ranged = rows.where(F.col(key).isNotNull()).select(key, *dict.fromkeys([*compared, scope]), F.floor(F.col(key) / width).cast("long").alias("range"))
    ranged.repartition("range").write.partitionBy("range").parquet(f"{folder}/rows")
    out = Snapshot(rows.sparkSession, folder)
    held = out.rows()
    held.select(scope).distinct().write.parquet(f"{folder}/scopes")
    digest = lambda x: F.xxhash64(F.count("*"), F.sum(x.cast("decimal(38,0)")))
    leaf = F.xxhash64(key, *compared, *[F.col(c).isNull() for c in compared])
    held.groupBy(F.col("range").cast("long").alias("node")).agg(digest(leaf).alias("digest")).select(F.lit(0).alias("level"), "node", "digest").write.parquet(f"{folder}/digests/level=0")
    level, below = 0, _level(out, 0)
    while True:
        ends = below.agg(F.min("node"), F.max("node")).first()
        if ends[0] is None or ends[0] == ends[1]:
            return out
        level += 1
        # around the middle, so that negative keys have a top as well
        below.groupBy(F.floor(F.col("node") / FAN).cast("long").alias("up")).agg(digest(F.xxhash64("node", "digest")).alias("digest")).select(F.col("up").alias("node"), "digest").write.parquet(f"{folder}/digests/level={level}")
        below = _level(out, level)
        if ends[0] < 0 <= ends[1] and ends[1] - ends[0] == 1:  # -1 and 0 never meet
            return out


def _level(s: Snapshot, level: int) -> DataFrame:
    return s.digests().where(F.col("level") == level).select("node", "digest")


def differing(old: Snapshot, new: Snapshot) -> DataFrame:
    """(range) of the ranges whose rows differ."""
    tops = [s.digests().agg(F.max("level")).first()[0] for s in (old, new)]
    level = min(t if t is not None else 0 for t in tops)
    nodes = None
    while level >= 0:
        a, b = (_level(s, level) for s in (old, new))
        if nodes is not None:
            up = F.floor(F.col("node") / FAN).cast("long")
            a, b = (x.withColumn("up", up).join(nodes.withColumnRenamed("node", "up"), "up", "left_semi").drop("up") for x in (a, b))
        both = a.withColumnRenamed("digest", "a").join(b.withColumnRenamed("digest", "b"), "node", "full")
        nodes = both.where(~F.col("a").eqNullSafe(F.col("b"))).select("node")
        level -= 1
    return nodes.withColumnRenamed("node", "range")


def differences(old: Snapshot, new: Snapshot, key: str, compared: list[str], scope: str) -> DataFrame:
    """(key, action) of the rows that differ: insert, update, delete, or out of scope for old rows of scopes that no new row has. What is the same
    is not listed."""
    ranges = differing(old, new)
    few = ranges.limit(NAMED + 1).collect()  # NAMED rows at most
    a, b = old.rows(), new.rows()
    if len(few) <= NAMED:
        named = F.col("range").isin([r["range"] for r in few])
        a, b = a.where(named), b.where(named)
    else:
        a, b = a.join(ranges, "range", "left_semi"), b.join(ranges, "range", "left_semi")
    return index_actions(a, b, key, compared, scope, new.scopes()).where("action <> 'unchanged'")
