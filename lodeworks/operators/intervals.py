"""Joins on a time axis: points in intervals with an equal key, and overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of the smallest cell of time; cells of a level are twice as long as those of the level below.
UNIT = 60.0
LEVELS = 48


def aligned_cells(low: Column, high: Column) -> Column:
    """The whole numbers from ``low`` to ``high`` as aligned cells, an array of (level, cell): 2**level numbers each, two cells of a level at most."""
    none = F.expr("cast(array() as array<struct<level:int,cell:bigint>>)")

    def step(a: Column, level: Column) -> Column:
        odd, even = (a["low"] <= a["high"]) & (a["low"] % 2 != 0), (a["low"] <= a["high"]) & (a["high"] % 2 == 0)
        first = F.when(odd, F.array(F.struct(level.cast("int").alias("level"), a["low"].alias("cell")))).otherwise(none)
        alone = odd & even & (a["low"] == a["high"])
        last = F.when(even & ~alone, F.array(F.struct(level.cast("int").alias("level"), a["high"].alias("cell")))).otherwise(none)
        low, high = F.when(odd, a["low"] + 1).otherwise(a["low"]), F.when(even, a["high"] - 1).otherwise(a["high"])
        return F.struct(F.shiftright(low, 1).alias("low"), F.when(low <= high, F.shiftright(high, 1)).otherwise(F.shiftright(low, 1) - 1).alias("high"), F.concat(a["out"], first, last).alias("out"))

    start = F.struct(low.cast("long").alias("low"), high.cast("long").alias("high"), none.alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), start, step, lambda a: a["out"])


def first_interval(points: DataFrame, intervals: DataFrame, key: str, at: str, tolerance: float = 0.0, unit: float = UNIT) -> DataFrame:
    """Each point with the first interval (by seg_idx) of its key that holds it, both ends included; without one it is
    kept with nulls. points: point_id, key, at (seconds); intervals: key, seg_idx, start_sec, end_sec.
    An interval of any length is cut into a few aligned cells that lie wholly inside it, joined by equality with the cells of a point on
    those levels that occur, after the first interval of each cell has been found; the two cells at its ends are compared exactly."""
    low, high = F.col("start_sec") - tolerance, F.col("end_sec") + tolerance
    far = 1e13

    def cell(c: Column) -> Column:
        return F.floor(F.greatest(F.least(c, F.lit(far)), F.lit(-far)) / unit).cast("long")

    valid = intervals.where((F.col("end_sec") >= F.col("start_sec")) & ~F.isnan("start_sec") & ~F.isnan("end_sec")).select(key, F.struct("seg_idx", "start_sec", "end_sec").alias("m"), low.alias("low"), high.alias("high"))
    first_whole, last_whole = cell(F.col("low")) + 1, cell(F.col("high")) - 1
    inner = valid.select(key, "m", F.inline(aligned_cells(first_whole, last_whole))).groupBy(key, "level", "cell").agg(F.min("m").alias("m"))
    levels = sorted(r["level"] for r in inner.select("level").distinct().collect())  # LEVELS at most
    edges = valid.select(key, "m", "low", "high", F.explode(F.array_distinct(F.array(cell(F.col("low")), cell(F.col("high"))))).alias("cell"))
    p = points.select("point_id", key, F.col(at).alias("moment"), cell(F.col(at)).alias("cell"))
    met = p.join(edges, [key, "cell"]).where((F.col("moment") >= F.col("low")) & (F.col("moment") <= F.col("high"))).select("point_id", "m")
    if levels:
        above = F.array(*[F.struct(F.lit(n).alias("level"), F.shiftright("cell", n).alias("cell")) for n in levels])
        met = met.unionByName(p.select("point_id", key, F.inline(above)).join(inner, [key, "level", "cell"]).select("point_id", "m"))
    first = met.groupBy("point_id").agg(F.min("m").alias("m"))
    return points.join(first, "point_id", "left").select(*points.columns, "m.seg_idx", "m.start_sec", "m.end_sec")


def neighbours(matched: DataFrame, intervals: DataFrame, key: str, text: str, window: int = 1) -> DataFrame:
    """The texts of the matched interval and its neighbours (seg_idx within ``window``), joined by a blank; empty without a match."""
    around = matched.where("seg_idx is not null").select("point_id", key, F.explode(F.sequence(F.col("seg_idx") - window, F.col("seg_idx") + window)).alias("seg_idx"))
    found = around.join(intervals.select(key, "seg_idx", text), [key, "seg_idx"]).groupBy("point_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("seg_idx", text)))[text], " ").alias("context"))
    return matched.select("point_id").join(found, "point_id", "left").select("point_id", F.coalesce("context", F.lit("")).alias("context"))


def cropped(text: Column, start: Column, end: Column, at: Column, width: int = 400) -> Column:
    """Of a longer text the ``width`` characters around the place that the time has in its interval."""
    share = F.when(end > start, (at - start) / (end - start)).otherwise(0.0)
    middle = F.floor(share * F.length(text)).cast("int")
    first = F.greatest(F.lit(0), F.least(middle - width // 2, F.length(text) - width))
    return F.when(F.length(text) <= width, text).otherwise(F.substring(text, first + 1, F.lit(width)))


def overlap(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Whether two open intervals overlap; never with a null end."""
    return F.coalesce((a1 < b2) & (b1 < a2), F.lit(False))


def segment_reason(start: Column, end: Column, text: Column) -> Column:
    """Why a segment is rejected; null where it is not."""
    return F.when(start.isNull() | end.isNull() | F.isnan(start) | F.isnan(end), "not finite").when(end < start, "ends before it starts").when(F.trim(F.coalesce(text, F.lit(""))) == "", "empty")


def islands(scores: DataFrame, key: str, order: str, score: str, threshold: float) -> DataFrame:
    """(key, scene, first, last, frames): the stretches between cuts, a frame above the threshold ending its stretch."""
    w = Window.partitionBy(key).orderBy(order)
    cut = F.coalesce(F.lag((F.col(score) > threshold).cast("int")).over(w), F.lit(0))
    numbered = scores.withColumn("cut", cut).withColumn("scene", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "scene").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("frames"))


def window_means(frames: DataFrame, key: str, pos: str, score: str, length: int, stride: int) -> DataFrame:
    """(key, first, mean, frames): averages over overlapping windows of positions, one at each stride and one that ends with
    the last frame; a window that reaches beyond the last frame is filled up with it."""
    ends = frames.groupBy(key).agg(F.greatest(F.lit(0), F.max(pos) - (length - 1)).cast("long").alias("tail"), F.max_by(score, pos).alias("last"))
    at = F.col(pos).cast("long")
    regular = F.sequence(F.greatest(F.lit(0), F.ceil((at - length + 1) / stride)).cast("long"), F.floor(at / stride).cast("long"))
    begins = F.concat(F.transform(regular, lambda x: x * stride), F.when(at >= F.col("tail"), F.array("tail")).otherwise(F.slice(F.array("tail"), 1, 0)))
    each = frames.join(ends, key).select(key, score, "last", F.explode(F.array_distinct(begins)).alias("first"))
    mean = (F.sum(score) + (length - F.count("*")) * F.first("last")) / length
    return each.groupBy(key, "first").agg(F.round(mean, 6).alias("mean"), F.count("*").alias("frames"))


def overlapping_pairs(intervals: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, pairs): how many pairs of a key's open intervals overlap, those without any left out. Two do not overlap if one ends before the other
    starts, or as it does; so it is enough to know the places of starts among all starts and ends in order, which are ranked together
    over all keys. No pair is made, and no key meets in one task. An interval with a null end, or that ends before it starts, does not
    count; one without length overlaps those that hold it inside."""
    from .sequences import global_rank

    valid = intervals.where((F.col(end) >= F.col(start)) & ~F.isnan(F.col(start)) & ~F.isnan(F.col(end))).select(key, F.col(start).cast("double").alias("start"), F.col(end).cast("double").alias("end"))
    point = F.col("start") == F.col("end")
    # at one time intervals end, then points start and end, then intervals start
    marks = F.array(F.struct(F.col("start").alias("time"), F.when(point, 1).otherwise(3).alias("kind")), F.struct(F.col("end").alias("time"), F.when(point, 2).otherwise(0).alias("kind")))
    ranked = global_rank(valid.select(key, F.inline(marks)), [key, "time", "kind"], "place")
    begins = F.col("kind").isin(1, 3)
    place = F.col("place").cast("decimal(20,0)")
    per = ranked.groupBy(key).agg(F.min("place").alias("first"), F.count_if(begins).cast("decimal(38,0)").alias("n"), F.sum(F.when(begins, place)).alias("places"))
    same = valid.where(point).groupBy(key, "start").count().groupBy(key).agg(F.sum(F.expr("cast(count as decimal(38,0)) * (count - 1) / 2")).alias("same"))
    n = F.col("n")
    apart = F.col("places") - n * (F.col("first") - 1) - n * (n + 1) / 2
    named = same.withColumnRenamed(key, "same_key")
    both = per.join(named, F.col(key).eqNullSafe(F.col("same_key")), "left")
    pairs = n * (n - 1) / 2 - apart - F.coalesce("same", F.lit(0))
    return both.select(key, pairs.cast("long").alias("pairs")).where("pairs > 0")
