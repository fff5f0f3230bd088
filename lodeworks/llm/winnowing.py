"""Document fingerprints by winnowing, in DataFrame functions alone.

A text's units are its words, lower-cased, those over ``UNIT`` characters cut into pieces. Every
run of ``GRAM`` units has a rolling hash: the hash before it, rotated, without the unit that goes
and with the unit that comes (a cyclic polynomial, 64 bits). Of every ``WINDOW`` consecutive
hashes the smallest is chosen, of equal ones the rightmost, and kept with its place. Two texts
that share a run of GRAM + WINDOW - 1 units therefore share a chosen hash, wherever the run lies.

The fingerprint is written ``place:hash`` (unit from 0; hexadecimal), comma-joined. Likeness of
two fingerprints is the share of common hashes among all their distinct hashes.

Documents are dealt into buckets of neighbours by doc_id, whose number grows with the table, so
that each document meets the next one; every text is shuffled once.

Defined results: a text with fewer than GRAM units is one run of all it has; without units the
fingerprint is empty, and two empty ones have likeness 1; a null text is empty; the next document
is the next by (doc_id, text), a null doc_id before all others, and of a lone row the row itself;
an empty table gives an empty result; other columns are ignored. Rows of one doc_id are neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

GRAM, WINDOW, UNIT = 4, 8, 16
#: Hashes that are rolled on before a run is hashed anew, which bounds the arrays that grow.
ROLLED = 64
#: Documents in a bucket of neighbours, about; and parts of either level of buckets, at most, so that their bounds
#: (PARTS * PARTS numbers) can be broadcast. Beyond PARTS * PARTS * BUCKET_ROWS documents buckets grow; they are sorted with spilling.
BUCKET_ROWS, PARTS = 256, 1024


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _turned(x: Column, by: int) -> Column:
    return x if by == 0 else F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by))


def _run(units: Column, at: Column, n: int) -> Column:
    """The hash of n units, from the place on."""
    out = F.get(units, at + (n - 1))
    for k in range(n - 1):
        out = out.bitwiseXOR(_turned(F.get(units, at + k), n - 1 - k))
    return out


def rolled(units: Column) -> Column:
    """The hashes of all runs of GRAM units (an array of unit hashes); of fewer units one hash of all."""

    def of(u: Column) -> Column:
        n = F.size(u)

        def block(b: Column) -> Column:
            places = F.sequence(b * ROLLED, F.least(b * ROLLED + (ROLLED - 1), n - GRAM))

            def step(acc: Column, i: Column) -> Column:
                return F.concat(acc, F.array(_turned(F.element_at(acc, -1), 1).bitwiseXOR(_turned(F.get(u, i - 1), GRAM)).bitwiseXOR(F.get(u, i + (GRAM - 1)))))

            return F.aggregate(F.slice(places, 2, ROLLED), F.array(_run(u, b * ROLLED, GRAM)), step)

        blocks = F.flatten(F.transform(F.sequence(F.lit(0), F.floor((n - GRAM) / ROLLED).cast("int")), block))
        out = F.when(n >= GRAM, blocks)
        for k in range(1, GRAM):
            out = out.when(n == k, F.array(_run(u, F.lit(0), k)))
        return out.otherwise(F.expr("cast(array() as array<bigint>)"))

    return _let(units, of)


def chosen(hashes: Column) -> Column:
    """The places of the smallest hashes of all windows, of equal ones the rightmost. Windows double until they have WINDOW hashes."""

    def of(h: Column) -> Column:
        m = F.size(h)

        def better(a: Column, b: Column) -> Column:
            return F.when(F.get(h, a) < F.get(h, b), a).otherwise(b)

        def doubled(best: Column | None, size: int) -> Column:
            """Of each place the best one among the ``size`` places from there; best: that among half as many."""
            half = size // 2
            places = F.sequence(F.lit(0), m - size)
            if best is None:
                return F.transform(places, lambda i: better(i, i + 1))
            return _let(best, lambda p: F.transform(places, lambda i: better(F.get(p, i), F.get(p, i + half))))

        best, size = None, 1
        while size < WINDOW:
            size *= 2
            best = doubled(best, size)
        alone = F.array(m - F.array_position(F.reverse(h), F.array_min(h)).cast("int"))
        return F.when(m > WINDOW, F.array_distinct(best)).when(m > 0, alone).otherwise(F.expr("cast(array() as array<int>)"))

    return _let(hashes, of)


def fingerprint(text: Column) -> Column:
    """The chosen (place, hash) of a text, by place."""
    units = F.transform(F.regexp_extract_all(F.lower(text), F.lit(rf"\S{{1,{UNIT}}}"), F.lit(0)), lambda u: F.xxhash64(u))
    return _let(rolled(units), lambda h: F.transform(chosen(h), lambda p: F.struct(p.alias("place"), F.get(h, p).alias("hash"))))


def written(prints: Column) -> Column:
    return F.array_join(F.transform(prints, lambda x: F.concat(x["place"].cast("string"), F.lit(":"), F.lower(F.hex(x["hash"])))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints."""

    def of(x: Column) -> Column:
        shared = F.size(F.array_intersect(x["a"], x["b"]))
        every = F.size(x["a"]) + F.size(x["b"]) - shared
        return F.when(every == 0, 1.0).otherwise(shared / every)

    return _let(F.struct(*[F.array_distinct(F.transform(p, lambda x: x["hash"])).alias(k) for k, p in (("a", a), ("b", b))]), of)


def _shares(n: int) -> list[float]:
    return [i / n for i in range(1, n)] or [0.5]


def beside_next(rows: DataFrame, order: str, added: dict[str, str], prepare) -> DataFrame:
    """``rows`` (order: a long, and text) with columns of the row that follows, the first after the last.
    Rows are dealt into buckets of neighbours, by bounds on two levels; the first rows of each bucket go to the bucket before
    as well. ``prepare`` is applied after the one shuffle of the texts, and ``added`` names what to take from the next row."""
    ids = rows.select(order)
    n = max(1, -(-ids.count() // BUCKET_ROWS))
    coarse = min(PARTS, math.ceil(math.sqrt(n)))
    fine = min(PARTS, -(-n // coarse))
    bounds = ids.agg(F.percentile_approx(order, _shares(coarse), 100 * PARTS)).first()[0] or [] if coarse > 1 else []  # PARTS numbers at most
    part = F.size(F.filter(F.array(*map(F.lit, sorted(set(bounds)))).cast("array<bigint>"), lambda b: b <= F.col(order)))
    within = ids.groupBy(part.alias("part")).agg(F.percentile_approx(order, _shares(fine), 100 * PARTS).alias("within"))
    within = F.broadcast(staged(within, "bounds"))  # PARTS rows of PARTS numbers at most

    def dealt(x: DataFrame) -> DataFrame:
        own = F.size(F.filter(F.array_distinct("within"), lambda b: b <= F.col(order))) if fine > 1 else F.lit(0)
        return x.withColumn("part", part).join(within, "part").withColumn("bucket", F.col("part") * (PARTS + 1) + own).drop("part", "within")

    firsts = staged(dealt(ids).groupBy("bucket").agg(F.min(order).alias(order)), "firsts")  # a row for each bucket
    ring = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    to = firsts.select(order, F.coalesce(F.lag("bucket").over(Window.orderBy("bucket")), F.max("bucket").over(ring)).alias("extra"))
    both = dealt(rows).join(F.broadcast(to), order, "left")
    places = F.filter(F.array(F.struct(F.col("bucket"), F.lit(0).alias("guest")), F.struct(F.col("extra").alias("bucket"), F.lit(1).alias("guest"))), lambda x: x["bucket"].isNotNull())
    both = both.withColumn("place", F.explode(places)).select(*rows.columns, "place.bucket", "place.guest").repartition("bucket")
    near = Window.partitionBy("bucket").orderBy("guest", order, "text")
    found = prepare(both)
    for column, name in added.items():
        found = found.withColumn(name, F.lead(column).over(near))
    return found.where("guest = 0").drop("bucket", "guest")


def compared(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint and its edited text's, and how like they and the next document's are."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("place_of", F.coalesce("doc_id", F.lit(-(1 << 63))))
    found = beside_next(rows, "place_of", {"text": "next", "own": "following"}, lambda x: x.withColumn("own", fingerprint(F.col("text"))))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next", F.lit(1), half))
    found = found.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "own", "following")
    found = found.withColumn("other", fingerprint(F.col("edited")))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), written(F.col("own")).alias("fingerprint"), written(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
