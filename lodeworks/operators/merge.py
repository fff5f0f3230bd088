"""Merges of new rows into old ones, as plans that give the table after the merge."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, keys: list[str], keep_if_null: Iterable[str] = (), immutable: Iterable[str] = ()) -> DataFrame:
    """Rows of both by key. New values overwrite, but a null does not overwrite the columns ``keep_if_null``, and
    nothing overwrites an ``immutable`` column that has a value."""
    keep, fixed = set(keep_if_null), set(immutable)
    values = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.struct(*values).alias("o"))
    n = new.select(*keys, F.struct(*values).alias("n"))
    both = o.join(n, keys, "full")

    def merged(c: str):
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in fixed:
            return F.coalesce(a, b)
        return F.coalesce(b, a) if c in keep else F.when(F.col("n").isNotNull(), b).otherwise(a)

    return both.select(*keys, *[merged(c).alias(c) for c in values]).select(*old.columns)


def replaced_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All child rows of each parent in ``new`` are replaced by its rows there."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def index_actions(old: DataFrame, new: DataFrame, key: str, compared: list[str], scope: str, scopes: DataFrame | None = None) -> DataFrame:
    """(key, action): insert, update, unchanged, or delete for old rows of the scopes that the new rows cover (``scopes``, where these are
    not all new rows)."""
    o = old.select(key, F.struct(*compared).alias("o"), F.col(scope).alias("old_scope"))
    n = new.select(key, F.struct(*compared).alias("n"))
    covered = (new if scopes is None else scopes).select(F.col(scope).alias("old_scope")).distinct().withColumn("covered", F.lit(True))
    both = o.join(covered, "old_scope", "left").join(n, key, "full")
    action = F.when(F.col("o").isNull(), "insert").when(F.col("n").isNull() & F.coalesce("covered", F.lit(False)), "delete").when(F.col("n").isNull(), "out of scope").when(F.col("o") == F.col("n"), "unchanged").otherwise("update")
    return both.select(key, action.alias("action"))


def updated_where(rows: DataFrame, condition, values: dict) -> DataFrame:
    """The columns of ``values`` set where the condition holds; None clears them."""
    return rows.select(*[F.when(condition, F.lit(values[c]) if values[c] is None or not hasattr(values[c], "alias") else values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns])


def synced(local: DataFrame, remote: DataFrame, key: str, size: str) -> DataFrame:
    """(key, action) of a sync by size: upload, replace, same, or extra for what only the remote side has."""
    a, b = local.select(key, F.col(size).alias("a")), remote.select(key, F.col(size).alias("b"))
    both = a.join(b, key, "full")
    return both.select(key, F.when(F.col("b").isNull(), "upload").when(F.col("a").isNull(), "extra").when(F.col("a") != F.col("b"), "replace").otherwise("same").alias("action"))


def violations(**checks: DataFrame) -> DataFrame:
    """(rule, n): how many rows break each rule; a check is the rows that do."""
    every = [rows.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n") for rule, rows in checks.items()]
    out = every[0]
    for x in every[1:]:
        out = out.unionByName(x)
    return out
