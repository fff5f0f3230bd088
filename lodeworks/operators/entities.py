"""Series, occurrences and aliases of things that recur."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def occurrence_label(given: Column, year: Column, posted: Column, years: tuple[int, int] = (2000, 2200)) -> Column:
    """A given label, else a year, else the year of posting; years beyond the bounds do not count."""
    own = F.when(F.year(posted).between(*years), F.year(posted))
    return F.coalesce(F.nullif(F.trim(given), F.lit("")), F.when(year.between(*years), year).cast("string"), own.cast("string"))


def alias_owners(claims: DataFrame) -> DataFrame:
    """(alias, target, claims): the first claim owns an alias, unless one that may override comes later; of these the last.
    claims: alias, target, override, seq."""
    last = F.struct(F.when(F.col("override"), 0).otherwise(1).alias("a"), F.when(F.col("override"), -F.col("seq")).otherwise(F.col("seq")).alias("b"), "target")
    return claims.groupBy("alias").agg(F.min(last).alias("m"), F.count("*").alias("claims")).select("alias", "m.target", "claims")


def with_last_primary(links: DataFrame, key: str, seq: str, asked: str) -> DataFrame:
    """The links with is_primary: of each key the last that asked to be."""
    last = links.where(asked).groupBy(key).agg(F.max(seq).alias("last"))
    return links.join(last, key, "left").withColumn("is_primary", F.coalesce(F.col(seq) == F.col("last"), F.lit(False))).drop("last")


def first_reason(*reasons: tuple[str, Column]) -> Column:
    """The name of the first condition that holds, else the empty text."""
    out = F.lit("")
    for name, condition in reversed(reasons):
        out = F.when(condition, name).otherwise(out)
    return out
