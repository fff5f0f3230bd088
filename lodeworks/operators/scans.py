"""Folds over an order of all rows, without one task for all.

A fold whose state is one of a few values is the composition of one small function per row: from the state before it to the state after it.
Functions of stretches of rows are composed in their tasks, those of the stretches level by level (as many as ``FAN`` of them meet in
one group), and on the way down each stretch learns the state that it is entered in. So an order of any length, be it of one key or of all
rows, is folded in two passes over the rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequences import global_rank

#: Rows of a stretch; functions that are composed in one group.
STRETCH, FAN = 1024, 256
#: From each state: the state after, and what was counted on the way.
FUNCTION = "array<struct<to:int,n:bigint>>"


def stretches(rows: DataFrame, order: list[str], length: int = STRETCH) -> DataFrame:
    """``rows`` with their place in the order of all (from 0) and the number of their stretch."""
    place = F.col("place") - 1
    return global_rank(rows, order, "place").withColumn("place", place).withColumn("stretch", F.floor(F.col("place") / length).cast("long"))


def composed(functions: Column, states: int) -> Column:
    """An array of functions, the first applied first, as one."""
    same = F.transform(F.sequence(F.lit(0), F.lit(states - 1)), lambda s: F.struct(s.cast("int").alias("to"), F.lit(0).cast("long").alias("n")))

    def then(done: Column, f: Column) -> Column:
        return F.transform(done, lambda d: F.struct(F.get(f, d["to"])["to"].alias("to"), (d["n"] + F.get(f, d["to"])["n"]).alias("n")))

    return F.aggregate(functions, same, then)


def entered(functions: DataFrame, states: int, start: int = 0, fan: int = FAN) -> DataFrame:
    """(stretch, state, before): the state that each stretch is entered in and what was counted before it. functions: (stretch, f), the
    stretches numbered from 0 without a gap, f being FUNCTION."""
    last = functions.agg(F.max("stretch")).first()[0] or 0
    levels = [functions.select(F.col("stretch").alias("i"), "f")]
    while last > 0:
        held = levels[-1].groupBy(F.floor(F.col("i") / fan).cast("long").alias("up")).agg(F.array_sort(F.collect_list(F.struct("i", "f"))).alias("each"))
        levels[-1] = held
        levels.append(held.select(F.col("up").alias("i"), composed(F.transform("each", lambda x: x["f"]), states).alias("f")))
        last //= fan
    at = levels.pop().select("i", F.lit(start).alias("state"), F.lit(0).cast("long").alias("before"))
    while levels:
        first = F.struct(F.col("state").cast("int").alias("to"), F.col("before").alias("n"), F.expr("cast(array() as array<struct<i:bigint,state:int,before:bigint>>)").alias("out"))

        def walk(a: Column, x: Column) -> Column:
            put = F.struct(x["i"].alias("i"), a["to"].alias("state"), a["n"].alias("before"))
            f = F.get(x["f"], a["to"])
            return F.struct(f["to"].alias("to"), (a["n"] + f["n"]).alias("n"), F.array_append(a["out"], put).alias("out"))

        down = levels.pop().join(at.withColumnRenamed("i", "up"), "up")
        at = down.select(F.inline(F.aggregate("each", first, walk, lambda a: a["out"])))
    return at.withColumnRenamed("i", "stretch")


def _exits(after: np.ndarray, own: int, length: int, states: int) -> list[dict]:
    """From each place that the first batch of a stretch may begin at: the place in the next stretch, and how many batches begin here."""
    to, n = np.zeros(own, np.int64), np.ones(own, np.int64)
    for i in range(own - 1, -1, -1):
        if after[i] < own:
            to[i], n[i] = to[after[i]], n[after[i]] + 1
        elif own == length:
            to[i] = after[i] - length
    return [{"to": int(to[s]), "n": int(n[s])} if s < own else {"to": 0, "n": 0} for s in range(states)]


def batches(rows: DataFrame, id_: str, size: str, most_items: int, most_size: int, length: int = STRETCH) -> DataFrame:
    """(id, batch): all rows in the order of their ids, filled into batches of at most ``most_items`` rows and ``most_size`` in sum, numbered from 0;
    a larger row is alone. A null or negative size counts as 0. A batch that begins in a stretch ends in it or within ``most_items``
    rows of the next, so a stretch with these has all that its batches need, and its function goes from the place where its first batch
    begins to that of the next stretch."""
    length = max(length, most_items)
    clean = rows.select(id_, F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("size"))
    placed = stretches(clean, [id_, "size"], length)
    reach = F.when((F.col("place") % length < most_items) & (F.col("stretch") > 0), F.array(F.col("stretch"), F.col("stretch") - 1)).otherwise(F.array("stretch"))
    dealt = placed.withColumn("stretch", F.explode(reach))

    def following(group: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, int]:
        group = group.sort_values("place")
        first = int(group["stretch"].iloc[0]) * length
        own = int((group["place"] < first + length).sum())
        filled = np.concatenate([[0], np.cumsum(group["size"].to_numpy(np.int64))])
        i = np.arange(len(group))
        return group, np.minimum(i + most_items, np.maximum(i + 1, np.searchsorted(filled, filled[:-1] + most_size, "right") - 1)), own

    def function(group: pd.DataFrame) -> pd.DataFrame:
        group, after, own = following(group)
        return pd.DataFrame({"stretch": [group["stretch"].iloc[0]], "f": [_exits(after, own, length, most_items)]})

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group, after, own = following(group)
        i, batch = int(group["state"].iloc[0]), int(group["before"].iloc[0])
        number = np.full(len(group), -1, np.int64)
        while i < own:
            number[i : after[i]] = batch
            i, batch = int(after[i]), batch + 1
        return pd.DataFrame({id_: group[id_], "batch": number})[number >= 0]

    functions = dealt.groupBy("stretch").applyInPandas(function, f"stretch long, f {FUNCTION}")
    at = entered(functions, most_items)
    kind = dict(rows.dtypes)[id_]
    return dealt.join(at, "stretch").groupBy("stretch").applyInPandas(fill, f"{id_} {kind}, batch long")


def glued(rows: DataFrame, key: str, order: list[str], tokens: Column, short: int, name: str, length: int = STRETCH) -> DataFrame:
    """``rows`` with the number ``name`` of their group: in the order of ``order``, a group of fewer than ``short`` tokens takes in the next row of
    its key until it has enough; the last of a key may stay short. States: no group is open, or one with so many tokens."""
    placed = stretches(rows.withColumn("tokens", F.greatest(F.coalesce(tokens.cast("int"), F.lit(0)), F.lit(0))), [key, *order], length)
    begins = placed.groupBy(key).agg(F.min("place").alias("place")).select("place", F.lit(True).alias("begins"))
    steps = placed.select("stretch", "place", "tokens").join(begins, "place", "left")
    held = steps.groupBy("stretch").agg(F.array_sort(F.collect_list(F.struct("place", "tokens", F.coalesce("begins", F.lit(False)).alias("begins")))).alias("xs"))

    def step(state: Column, n: Column, x: Column) -> tuple[Column, Column]:
        """The state after a row, and the groups begun up to it."""
        s = F.when(x["begins"], 0).otherwise(state)
        total = F.greatest(s - 1, F.lit(0)) + F.least(x["tokens"], F.lit(short))
        return F.when(total < short, total + 1).otherwise(0).cast("int"), n + F.when(s == 0, 1).otherwise(0)

    def function(done: Column, x: Column) -> Column:
        def moved(d: Column) -> Column:
            to, n = step(d["to"], d["n"], x)
            return F.struct(to.alias("to"), n.cast("long").alias("n"))

        return F.transform(done, moved)

    same = F.transform(F.sequence(F.lit(0), F.lit(short)), lambda s: F.struct(s.cast("int").alias("to"), F.lit(0).cast("long").alias("n")))
    at = entered(held.select("stretch", F.aggregate("xs", same, function).alias("f")), short + 1)
    first = F.struct(F.col("state").cast("int").alias("to"), F.col("before").alias("n"), F.expr(f"cast(array() as array<struct<place:bigint,{name}:bigint>>)").alias("out"))

    def number(a: Column, x: Column) -> Column:
        to, n = step(a["to"], a["n"], x)
        return F.struct(to.alias("to"), n.cast("long").alias("n"), F.array_append(a["out"], F.struct(x["place"].alias("place"), n.cast("long").alias(name))).alias("out"))

    numbers = held.join(at, "stretch").select(F.inline(F.aggregate("xs", first, number, lambda a: a["out"])))
    return placed.join(numbers, "place").drop("stretch", "tokens")
