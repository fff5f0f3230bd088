"""Names of the same thing: clusters over the graph of aliases, and their write-back into series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..session import checkpointed
from .sequences import global_rank

#: Fixed value: names that are clustered at once.
BATCH = 40


def components(edges: DataFrame) -> DataFrame:
    """(name, root): of each name the least one that edges (a, b) lead to. Stars are contracted in turns: each name's greater neighbours are tied to
    its least one, then its lesser ones, until no edge changes. A name with many neighbours costs one row for each, never pairs."""
    lesser = edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    held = checkpointed(lesser)
    seen = None
    while True:
        both = held.unionByName(held.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("u <> v").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(least.select("v", F.col("m").alias("u")))
        held = checkpointed(small.where("u <> v").distinct())
        now = held.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    names = edges.select(F.col("a").alias("name")).unionByName(edges.select(F.col("b").alias("name"))).where("name is not null").distinct()
    return names.join(held.select(F.col("v").alias("name"), F.col("u").alias("root")), "name", "left").select("name", F.coalesce("root", "name").alias("root"))


def clustered(names: DataFrame, anchors: DataFrame, first: Callable[[DataFrame], DataFrame], second: Callable[[DataFrame], DataFrame], size: int = BATCH) -> DataFrame:
    """Clusters of ``names`` (name, n): (name, n, cluster, weight, anchors), a row for each name.

    Names whose key is an alias of ``anchors`` (alias, anchor) belong to that anchor and are not asked about. ``first`` gives (name, canon) for the
    others, which it gets in batches (batch, name, n) of ``size`` neighbours by key; ``second`` gives (name, canon) for the canonical names that come
    of it, with their weights, so that spellings of different batches meet. A name that a call leaves out stays its own; one that it puts
    into several clusters ties them together. ``cluster`` is the least anchor of a cluster, else its least canonical name; ``anchors`` over 1 is
    a conflict."""
    keyed = names.withColumn("key", text.alias_key(F.col("name")))
    known = anchors.select(text.alias_key(F.col("alias")).alias("key"), "anchor").groupBy("key").agg(F.min("anchor").alias("anchor"))
    held = checkpointed(keyed.join(known, "key", "left").select("name", "n", "key", "anchor"))
    free = held.where("anchor is null")
    placed = global_rank(free.select("name", "n", "key"), ["key", "name"], "place")
    asked = placed.select(F.floor((F.col("place") - 1) / size).alias("batch"), "name", "n")
    one = checkpointed(_answered(free.select("name"), first(asked)))
    weights = one.join(free.select("name", "n"), "name").groupBy("canon").agg(F.sum("n").alias("n")).select(F.col("canon").alias("name"), "n")
    two = checkpointed(_answered(weights.select("name"), second(weights)))
    # names, first and second canonical names and anchors are told apart, since one text may be all of them
    tag = lambda k, c: F.concat(F.lit(k), F.col(c))
    edges = one.select(tag("3", "name").alias("a"), tag("2", "canon").alias("b")).unionByName(two.select(tag("2", "name").alias("a"), tag("1", "canon").alias("b"))).unionByName(held.where("anchor is not null").select(tag("3", "name").alias("a"), tag("0", "anchor").alias("b")))
    # a canonical name that is an alias of an anchor leads to it
    calendar = two.select("canon").distinct().withColumn("key", text.alias_key(F.col("canon"))).join(known, "key").select(tag("1", "canon").alias("a"), tag("0", "anchor").alias("b"))
    rooted = checkpointed(components(edges.unionByName(calendar)))
    per = rooted.groupBy("root").agg(F.count_if(F.col("name").startswith("0")).alias("anchors"))
    own = rooted.where(F.col("name").startswith("3")).select(F.substr("name", F.lit(2)).alias("name"), "root").join(held.select("name", "n"), "name")
    weight = own.groupBy("root").agg(F.sum("n").alias("weight"))
    return own.join(per.join(weight, "root"), "root").select("name", "n", F.substr("root", F.lit(2)).alias("cluster"), "weight", "anchors")


def _answered(asked: DataFrame, answer: DataFrame) -> DataFrame:
    """(name, canon) of all that were asked about, and of nothing else."""
    given = asked.join(answer.select("name", "canon").where("canon is not null and canon <> ''").distinct(), "name", "left")
    return given.select("name", F.coalesce("canon", "name").alias("canon"))


def reconciled(records: DataFrame, known: DataFrame) -> DataFrame:
    """What a run writes for its records (seq, raw, canon), in the order of seq: (seq, slug, known, conflicts).

    The series of a record is that of its canonical name's alias, else that of its raw name's, else a new one by the slug of its canonical name
    (one of that slug is used again). Both names then become aliases of the series; one that belongs to another series stays there and is a
    conflict, as is one without a key. known: (alias, slug) from before. A record without a slug is left out.

    The alias of a name belongs to the record that mentions it first, so each record points to an earlier one or begins a series; the
    pointers are followed by jumping, in as many rounds as the longest chain has binary digits."""
    canon = F.trim(F.coalesce(F.nullif(F.trim("canon"), F.lit("")), F.col("raw"), F.lit("")))
    named = records.select("seq", canon.alias("canon"), F.trim(F.coalesce("raw", F.lit(""))).alias("raw"))
    rows = named.select("seq", "canon", "raw", text.alias_key(F.col("canon")).alias("key_c"), text.alias_key(F.col("raw")).alias("key_r"), text.slug(F.col("canon")).alias("slug")).where("slug <> ''")
    mentions = rows.select("seq", F.explode(F.array_distinct(F.array("key_c", "key_r"))).alias("key")).where("key <> ''")
    before = known.select(text.alias_key(F.col("alias")).alias("key"), F.col("slug").alias("held")).groupBy("key").agg(F.min("held").alias("held"))
    owners = checkpointed(mentions.groupBy("key").agg(F.min("seq").alias("owner")).join(before, "key", "left"))

    def of(k: str) -> DataFrame:
        return owners.select(F.col("key").alias(f"key_{k}"), F.col("owner").alias(f"owner_{k}"), F.col("held").alias(f"held_{k}"))

    linked = rows.join(of("c"), "key_c", "left").join(of("r"), "key_r", "left")
    earlier_c, earlier_r = F.col("owner_c") < F.col("seq"), F.col("owner_r") < F.col("seq")
    by_c = F.col("held_c").isNotNull() | F.coalesce(earlier_c, F.lit(False))
    up = F.when(F.col("held_c").isNotNull(), None).when(earlier_c, F.col("owner_c")).when(F.col("held_r").isNotNull(), None).when(earlier_r, F.col("owner_r"))
    begun = F.when(F.col("held_c").isNotNull(), F.col("held_c")).when(by_c, None).when(F.col("held_r").isNotNull(), F.col("held_r")).when(earlier_r, None).otherwise(F.col("slug"))
    found = by_c | F.col("held_r").isNotNull() | F.coalesce(earlier_r, F.lit(False))
    pointed = checkpointed(linked.select("seq", "canon", "raw", "key_c", "key_r", up.alias("up"), begun.alias("series"), found.alias("known")))
    nodes = checkpointed(pointed.join(owners.select(F.col("owner").alias("seq")).distinct(), "seq", "left_semi").select("seq", "up", "series"))
    while not nodes.where("series is null").isEmpty():
        above = nodes.select(F.col("seq").alias("up"), F.col("up").alias("next"), F.col("series").alias("above"))
        nodes = checkpointed(nodes.join(above, "up", "left").select("seq", F.when(F.coalesce("series", "above").isNull(), F.col("next")).alias("up"), F.coalesce("series", "above").alias("series")))
    top = nodes.select(F.col("seq").alias("up"), F.col("series").alias("above"))
    series = pointed.join(top, "up", "left").select("seq", "canon", "raw", "key_c", "key_r", F.coalesce("series", "above").alias("slug"), "known")
    owned = owners.join(nodes.select(F.col("seq").alias("owner"), "series"), "owner").select("key", F.coalesce("held", "series").alias("owned"))
    held_c, held_r = owned.select(F.col("key").alias("key_c"), F.col("owned").alias("a")), owned.select(F.col("key").alias("key_r"), F.col("owned").alias("b"))
    both = series.join(held_c, "key_c", "left").join(held_r, "key_r", "left")
    lost = lambda c: F.when(F.col(c).eqNullSafe(F.col("slug")), 0).otherwise(1)
    return both.select("seq", "slug", "known", (lost("a") + F.when(F.col("raw") == F.col("canon"), 0).otherwise(lost("b"))).alias("conflicts"))


def after_unlinking(series: DataFrame, occurrences: DataFrame, links: DataFrame, posts: DataFrame) -> dict[str, DataFrame]:
    """What is removed, by table, when the links of ``posts`` (post_id) go and with them every series that no link leads to any more: its
    occurrences go too. series: series_id; occurrences: occurrence_id, series_id; links: post_id, occurrence_id."""
    gone = links.join(posts.select("post_id").distinct(), "post_id", "left_semi")
    left = links.join(posts.select("post_id").distinct(), "post_id", "left_anti")
    used = occurrences.join(left.select("occurrence_id").distinct(), "occurrence_id", "left_semi").select("series_id").distinct()
    orphans = series.join(used, "series_id", "left_anti")
    return {"links": gone, "series": orphans, "occurrences": occurrences.join(orphans.select("series_id"), "series_id", "left_semi").select(*occurrences.columns)}
