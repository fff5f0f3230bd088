"""Decisions that depend on those before them, per group: temporal duplicates, short segments, scene frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the frame, segment and chunk rules.
SIMILAR, GAP_SECONDS = 0.90, 10.0
SHORT_TOKENS = 30
SHORT_SCENE, PLACES, EVERY_SECONDS, PER_SCENE = 10, (0.15, 0.5, 0.85), 2.5, 8
WINDOW_TOKENS, WINDOW_OVERLAP, LONG_TOKENS = 200, 40, 300


def without_repeats(frames: DataFrame, key: str, piece_seconds: float = 300.0) -> DataFrame:
    """(key, frame_id, kept, similarity): a frame is kept unless it is like a kept one of the last seconds.
    frames: key, frame_id, at (seconds), vector; one without time or vector is left out.
    A recording is decided upon in pieces. A piece starts from the frames that the one before has kept in its last seconds, and is decided
    anew when these have changed, until nothing changes: decisions seldom reach far, and no group holds more than a piece and the
    seconds before it, however long the recording."""
    from ..session import checkpointed

    piece_seconds = max(piece_seconds, GAP_SECONDS)
    kind = dict(frames.dtypes)[key]
    piece = F.floor(F.col("at") / piece_seconds).cast("long")
    group = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))  # a key that null has too
    rows = frames.where("at is not null and vector is not null").select(F.col(key), "frame_id", F.col("at").cast("double").alias("at"), F.col("vector").cast("array<double>").alias("vector"), group.alias("group"), F.monotonically_increasing_id().alias("row"), piece.alias("own"))
    reaches = F.col("at") >= (F.col("own") + 1) * piece_seconds - GAP_SECONDS
    dealt = checkpointed(rows.withColumn("reaches", reaches).withColumn("piece", F.explode(F.when(reaches, F.array("own", F.col("own") + 1)).otherwise(F.array("own")))))

    def decide(piece: pd.DataFrame) -> pd.DataFrame:
        piece = piece.sort_values(["at", "frame_id", "row"])
        before = set(piece["before"].iloc[0] if piece["before"].iloc[0] is not None else ())
        kept: list[tuple[float, np.ndarray]] = []
        out = []
        for r in piece.itertuples():
            v = np.asarray(r.vector, np.float64)
            v = v / max(np.linalg.norm(v), 1e-12)
            if r.own != r.piece:
                kept += [(r.at, v)] if r.row in before else []
                continue
            kept = [k for k in kept if r.at - k[0] <= GAP_SECONDS]
            like = max((float(k[1] @ v) for k in kept), default=0.0)
            out.append((r.group, r.piece, r.row, getattr(r, "key"), r.frame_id, r.reaches, like < SIMILAR, round(max(like, 0.0), 6)))
            if like < SIMILAR:
                kept.append((r.at, v))
        return pd.DataFrame(out, columns=["group", "piece", "row", "key", "frame_id", "reaches", "kept", "similarity"])

    schema = f"group string, piece long, row long, key {kind}, frame_id {dict(frames.dtypes)['frame_id']}, reaches boolean, kept boolean, similarity double"
    inner = dealt.withColumnRenamed(key, "key")
    none = F.lit(None).cast("array<bigint>")
    started = checkpointed(inner.select("group", "piece").distinct().withColumn("before", none))
    decided = checkpointed(inner.withColumn("before", none).groupBy("group", "piece").applyInPandas(decide, schema))
    while True:
        tails = decided.where("kept and reaches").groupBy("group", (F.col("piece") + 1).alias("piece")).agg(F.array_sort(F.collect_list("row")).alias("now"))
        both = started.join(tails, ["group", "piece"], "left")
        changed = checkpointed(both.where(~F.col("before").eqNullSafe(F.col("now"))).select("group", "piece", F.col("now").alias("before")))
        if changed.isEmpty():
            break
        again = inner.join(changed, ["group", "piece"]).groupBy("group", "piece").applyInPandas(decide, schema)
        decided = checkpointed(decided.join(changed, ["group", "piece"], "left_anti").unionByName(again))
        started = checkpointed(started.join(changed, ["group", "piece"], "left_anti").unionByName(changed))
    return decided.select(F.col("key").alias(key), "frame_id", "kept", "similarity")


def words(text: Column) -> Column:
    """The words of a text between white space; none of null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def merged_segments(segments: DataFrame, key: str, id_: str, short: int = SHORT_TOKENS) -> DataFrame:
    """(key, start, end, text, ids) of segments (key, id, start, end, text), in the order of start and id: each under ``short`` tokens is glued to the
    next ones of its key until it is long enough; a short last one stays. A key's segments need not meet in one task."""
    from .scans import glued

    rows = segments.select(key, F.col(id_).alias("id"), "start", "end", "text")
    numbered = glued(rows, key, ["start", "id", "end", "text"], F.size(words(F.col("text"))), short, "unit")
    each = F.array_sort(F.collect_list(F.struct("place", "start", "end", "text", "id")))
    merged = numbered.groupBy(key, "unit").agg(each.alias("xs"))
    texts = F.transform("xs", lambda x: F.coalesce(x["text"], F.lit("")))
    return merged.select(key, F.get("xs", F.lit(0))["start"].alias("start"), F.element_at("xs", -1)["end"].alias("end"), F.trim(F.array_join(texts, " ")).alias("text"), F.transform("xs", lambda x: x["id"]).alias("ids"))


def frame_places(first: Column, last: Column, fps: Column) -> Column:
    """Frames of a scene to look at: some shares of it and one for every few seconds, or the middle of a short one;
    half-way places go to the even neighbour."""
    n = last - first
    shares = F.array(*[F.bround(first + p * n).cast("long") for p in PLACES])
    step = F.greatest(F.bround(fps * EVERY_SECONDS).cast("long"), F.lit(1))
    regular = F.when(n / fps > EVERY_SECONDS, F.concat(F.sequence(first, last, step), F.array(last))).otherwise(F.slice(shares, 1, 0))
    every = F.array_sort(F.array_distinct(F.filter(F.concat(shares, regular), lambda x: (x >= first) & (x <= last))))
    return F.when(n < SHORT_SCENE, F.array(F.bround((first + last) / 2).cast("long"))).otherwise(every)


def limited(places: Column, most: int = PER_SCENE) -> Column:
    """At most ``most`` of an array, spread evenly, the first and the last among them."""
    n = F.size(places)
    at = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * (n - 1) / (most - 1)).cast("int") + 1)
    return F.when(n <= most, places).otherwise(F.transform(at, lambda i: F.element_at(places, i)))


def transcript_units(segments: DataFrame, key: str) -> DataFrame:
    """Units of merged segments (key, start and end in seconds, text): unit_id, chunk_index, chunk_total, text. A segment of
    LONG_TOKENS words or fewer is one unit; a longer one is cut into windows, which share its time."""
    each, n = F.col("words"), F.size("words")
    step = WINDOW_TOKENS - WINDOW_OVERLAP
    begins = F.sequence(F.lit(0), F.greatest(n - WINDOW_OVERLAP - 1, F.lit(0)), F.lit(step))
    parts = F.when(n > LONG_TOKENS, F.transform(begins, lambda i: F.array_join(F.slice(each, i + 1, WINDOW_TOKENS), " "))).when(n > 0, F.array(F.array_join(each, " ")))
    place = F.concat(F.col(key).cast("string"), F.lit(":"), F.format_string("%.3f-%.3f", F.col("start").cast("double"), F.col("end").cast("double")))
    # one step after the other, so that words and parts are made once
    split = segments.select(key, place.alias("place"), words(F.col("text")).alias("words"))
    cut = split.select(key, "place", parts.alias("parts"))
    units = cut.select(key, "place", F.size("parts").alias("chunk_total"), F.posexplode("parts").alias("chunk_index", "text"))
    unit = F.concat(F.lit("transcript:"), "place", F.when(F.col("chunk_total") > 1, F.concat(F.lit("#"), F.col("chunk_index").cast("string"))).otherwise(""))
    return units.select(key, unit.alias("unit_id"), "chunk_index", "chunk_total", "text")
