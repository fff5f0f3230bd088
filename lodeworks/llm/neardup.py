"""Near-duplicate documents by word shingles, minhash and tensored banding.

A document's set is its distinct 5-word shingles (the whole sequence as one where it has fewer
words), as 64-bit hashes. Documents with equal sets are one class from the start. Each class
computes ``COLLECTIONS`` small collections of minhashes, and every pair of collections is a
table: its key combines both collections' keys. So 16 collections of two give 120 tables of
four for 32 minhashes instead of 480; a pair of similarity 0.75 that shares no table has a
chance of 4 in 100,000.

Candidates are verified on full sets. How many of its shingles a class shares with any other
candidate bounds every intersection it can have, which excludes most pairs without a look at them.
Every member of a table's buckets is held against the bucket's leader first, the one that shares
most (of edited copies, the text that they were made from), and what is linked is joined into
components. Two members of a bucket have its leader in common, so what may still be linked are
members of one leader's group in different components: those outside the group's largest component
are held against all of the group, in blocks of bounded size within tasks, which pass on nothing
but links.

Keys that many classes have (a leader's, a component's, a table's, a set's with many copies) are
dealt into pieces wherever they are joined (``joined``).

Defined results: a null or empty text, or one of white space, has an empty set and is linked
with nothing; a null doc_id takes no part and is kept, with a null component; repeated rows are
copies of each other; of rows with one doc_id and different texts each has the component of its
own text; an empty table gives an empty result; other columns are ignored. Of the rows of a
component one stays, of those with the smallest doc_id that with the smallest hash of its text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import handed_back, joined, shipped, staged, unused

WORDS = 5
COLLECTIONS = 16
#: Of the 32 minhashes, each cut to a byte, so many must agree before full sets are compared;
#: a pair of similarity 0.75 falls short with a chance of about 1 in 100,000.
AGREEING = 13
#: Members of a group that are held against as many others at once.
BLOCK = 128
#: Ids up to which a list of them is broadcast (16 bytes each); longer ones are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Bytes of text that are hashed at once.
CHUNK = 1 << 20

_U = np.uint64
_RNG = np.random.default_rng(20240817)
_ODD = lambda n: _RNG.integers(0, 2**63, n, dtype=np.uint64) * _U(2) + _U(1)
_BASE, _PLACES, _TIMES = int(_ODD(1)[0]), _ODD(WORDS), _ODD(2 * COLLECTIONS)
_PLUS, _PAIR = _ODD(2 * COLLECTIONS), _ODD(2)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text (UTF-8)."""
    held = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    space = _SPACE[held]
    edge = np.diff(np.concatenate(([True], space, [True])).view(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return [np.empty(0, np.uint64) for _ in texts]
    sums = np.concatenate(([_U(0)], np.cumsum((_LOWER[held] + _U(1)) * _powers(_BASE, len(held)))))
    word = _mixed((sums[end] - sums[start]) * _powers(pow(_BASE, -1, 1 << 64), len(held))[start] + (end - start).astype(np.uint64))
    ends = np.searchsorted(start, np.cumsum(lengths))
    out = []
    if len(word) >= WORDS:
        runs = sum((word[k : len(word) - WORDS + 1 + k] * _PLACES[k] for k in range(1, WORDS)), word[: len(word) - WORDS + 1] * _PLACES[0])
        runs = _mixed(runs)
    for a, b in zip(np.concatenate(([0], ends[:-1])), ends, strict=True):
        if b - a >= WORDS:
            out.append(np.unique(runs[a : b - WORDS + 1]))
        elif b > a:
            out.append(_mixed(np.sum(word[a:b] * _PLACES[: b - a], keepdims=True) + _U(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def minhashes(shingles: np.ndarray) -> np.ndarray:
    low = np.full(len(_TIMES), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 1 << 15):
        low = np.minimum(low, (shingles[i : i + (1 << 15), None] * _TIMES + _PLUS).min(axis=0))
    return low


def _chunks(batch: pa.RecordBatch):
    """(rows, texts) of bounded size; null texts are empty."""
    texts = batch.column("text").cast(pa.large_binary())
    rows, held, size = [], [], 0
    for i, t in enumerate(texts):
        rows.append(i)
        held.append(t.as_py() or b"")
        size += len(held[-1])
        if size > CHUNK:
            yield rows, held
            rows, held, size = [], [], 0
    if rows:
        yield rows, held


def digest_of(shingles: np.ndarray) -> int:
    """64 bits that stand for a set."""
    return _mixed(np.array([np.add.reduce(shingles) ^ _mixed(np.array([np.bitwise_xor.reduce(shingles) + _U(len(shingles))]))[0]])).view(np.int64)[0].item()


SIGNED = "doc_id long, text_hash long, n long, node long, keys array<long>, agree array<long>"


def signed(docs: DataFrame) -> DataFrame:
    """Per row: set size, a digest of the set (``node``; null where empty), the collections' keys, and 32 bytes of the minhashes."""
    shipped(docs.sparkSession)

    def sign(batches):
        for batch in batches:
            for rows, texts in _chunks(batch):
                n, node, keys, agree = [], [], [], []
                for s in shingle_sets(texts):
                    n.append(len(s))
                    if not len(s):
                        node.append(None), keys.append(None), agree.append(None)
                        continue
                    low = minhashes(s)
                    node.append(digest_of(s))
                    keys.append(_mixed(low[::2] * _PAIR[0] + low[1::2] * _PAIR[1] + np.arange(COLLECTIONS, dtype=np.uint64)).view(np.int64))
                    agree.append((_mixed(low) >> _U(56)).astype(np.uint8).view(np.int64))
                ids = [batch.column(x).take(pa.array(rows)) for x in ("doc_id", "text_hash")]
                lists = [pa.array(x, pa.list_(pa.int64())) for x in (keys, agree)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(n, pa.int64()), pa.array(node, pa.int64()), *lists], ["doc_id", "text_hash", "n", "node", "keys", "agree"])
            handed_back()

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(sign, SIGNED)


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the classes ``wanted`` (node, doc_id of a member)."""
    small = wanted.count() <= BROADCAST_IDS
    picked = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(wanted) if small else wanted, "doc_id")

    def sets(batches):
        for batch in batches:
            for rows, texts in _chunks(batch):
                asked = batch.column("node").take(pa.array(rows)).to_pylist()
                held = [(k, s) for k, s in zip(asked, shingle_sets(texts), strict=True) if len(s) and digest_of(s) == k]  # of rows with one doc_id, those that have the class's set
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], pa.int64()), pa.array([s.view(np.int64) for _, s in held], pa.list_(pa.int64()))], ["node", "shingles"])
        handed_back()

    return picked.mapInArrow(sets, "node long, shingles array<long>").dropDuplicates(["node"])


def _counted(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("k"))


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have the asked similarity. b is a leader, of many pairs maybe; an a has one leader a table at most."""
    own = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = joined(own, sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), ["b"], ["a"], counts=_counted(pairs, "b"))
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes that have an edge (a, b), label the smallest node that they reach.
    Large-star and small-star steps in turn, until the edges stay the same."""
    stars, before = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"), None
    while True:
        ways = stars.union(stars.select("b", "a"))
        least = staged(ways.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("k")), "least")
        large = joined(ways.where("b > a"), least.select("a", "m"), ["a"], ["b"], counts=least.select("a", "k"))  # a star's centre has many ways
        large = staged(large.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")  # no more rows of an a than it had smaller neighbours
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        stars = staged(small.where("a <> b").distinct(), "stars")
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return stars.select(F.col("a").alias("node"), F.col("b").alias("label")).union(stars.select("b", "b").distinct())


def _agreeing(x: str, y: str) -> Column:
    """How many of the 32 bytes are the same."""
    differ = F.lit(0)
    for i in range(2 * COLLECTIONS // 8):
        z = F.col(x)[i].bitwiseXOR(F.col(y)[i])
        for k in (4, 2, 1):
            z = z.bitwiseOR(F.shiftrightunsigned(z, k))
        differ = differ + F.bit_count(z.bitwiseAND(F.lit(0x0101010101010101)))
    return 2 * COLLECTIONS - differ


def _plausible(percent: int) -> Column:
    """What two sizes, shared parts and signatures allow. An intersection is no larger than what either shares with
    any candidate, and has to be percent / (100 + percent) of both sizes together."""
    close = 100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")
    enough = (100 + percent) * F.least("shared", "shared2") >= percent * (F.col("n") + F.col("n2"))
    return close & enough & (_agreeing("agree", "agree2") >= AGREEING)


def shared_sizes(sets: DataFrame) -> DataFrame:
    """(node, shared): how many of a class's shingles another class of ``sets`` has as well."""
    items = sets.select("node", F.explode("shingles").alias("s"))
    own = items.groupBy("s").agg(F.count("*").alias("k"), F.min("node").alias("node")).where("k = 1").groupBy("node").agg(F.count("*").alias("own"))
    return sets.select("node", F.size("shingles").alias("all")).join(own, "node", "left").select("node", (F.col("all") - F.coalesce("own", F.lit(0))).alias("shared"))


def postings(classes: DataFrame) -> DataFrame:
    """(key, node): the tables' entries, without keys that only one class has."""
    single = classes.select("node", F.posexplode("keys").alias("c", "key"))
    shared = staged(_counted(single, "c", "key").where("k > 1"), "shared-keys")
    held = joined(single, shared.select("c", "key"), ["c", "key"], ["node"], counts=shared).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("c", "key"))).alias("held"))  # 16 at most
    tables = F.expr(
        "flatten(transform(held, (x, i) -> transform(slice(held, i + 2, size(held)), y -> xxhash64(x.c, x.key, y.c, y.key))))"
    )
    return _met(staged(held.where("size(held) > 1").select("node", F.explode(tables).alias("key")), "entries"))


def _met(entries: DataFrame) -> DataFrame:
    """The entries whose key more than one class has."""
    often = staged(_counted(entries, "key").where("k > 1"), "often")
    return joined(entries, often.select("key"), ["key"], ["node"], counts=often)


def links_apart(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) between members of a group (leader, node, label) that have different labels."""
    sizes = groups.groupBy("leader", "label").agg(F.count("*").alias("k"))
    parts = sizes.groupBy("leader").agg(F.max(F.struct("k", "label")).alias("most"), F.sum("k").alias("all")).where(F.col("all") > F.col("most.k"))
    parts = parts.select("leader", F.col("most.label").alias("most"), F.ceil(F.col("all") / BLOCK).alias("blocks"), F.ceil((F.col("all") - F.col("most.k")) / BLOCK).alias("apart"))
    rows = joined(groups, staged(parts, "parts"), ["leader"], ["node"]).join(sets, "node")
    own, other = F.pmod(F.xxhash64("node"), "blocks"), F.pmod(F.xxhash64("node", F.lit(1)), "apart")
    every = rows.select("leader", "node", "label", "shingles", F.lit(False).alias("outside"), own.alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("apart") - 1)).alias("j"))
    outside = rows.where("label <> most").select("leader", "node", "label", "shingles", F.lit(True).alias("outside"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("i"), other.alias("j"))

    def met(table: pa.Table) -> pa.Table:
        side = table["outside"].to_numpy(zero_copy_only=False)
        node, label = table["node"].to_numpy(), table["label"].to_numpy()
        held = table["shingles"].combine_chunks()
        n = pc.list_value_length(held).to_numpy(zero_copy_only=False).astype(np.int64)
        values = held.flatten().to_numpy()
        distinct, at = np.unique(values, return_inverse=True)
        row = np.repeat(np.arange(len(n)), n)
        often = np.zeros((2, len(distinct)), bool)
        often[side[row].astype(int), at] = True
        both = often.all(axis=0)  # only what occurs on both sides can be shared
        kept = both[at]
        place = np.cumsum(both) - 1
        found = np.zeros((side.sum(), (~side).sum()), np.float32)
        line = np.where(side, np.cumsum(side) - 1, np.cumsum(~side) - 1)
        row, column = row[kept], place[at[kept]]
        for lo in range(0, int(both.sum()), 8192):
            now = (column >= lo) & (column < lo + 8192)
            a, b = np.zeros((found.shape[0], 8192), np.float32), np.zeros((found.shape[1], 8192), np.float32)
            x = side[row[now]]
            a[line[row[now]][x], column[now][x] - lo] = 1
            b[line[row[now]][~x], column[now][~x] - lo] = 1
            found += a @ b.T
        shared = np.rint(found).astype(np.int64)
        total = n[side][:, None] + n[~side][None, :] - shared
        x, y = np.nonzero((100 * shared >= percent * total) & (label[side][:, None] != label[~side][None, :]))
        return pa.table({"a": pa.array(node[side][x], pa.int64()), "b": pa.array(node[~side][y], pa.int64())})

    return every.unionByName(outside).groupBy("leader", "i", "j").applyInArrow(met, "a long, b long").distinct()


def labelled(docs: DataFrame, percent: int) -> DataFrame:
    """One row per document: doc_id, text_hash, set size n, set (node), component of sets (label) and component_id."""
    rows = staged(signed(docs), "signed")
    sets_of = rows.where("node is not null and doc_id is not null")
    classes = staged(sets_of.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("k"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("agree").alias("agree")), "classes")
    met = staged(postings(classes), "met")
    wanted = met.select("node").distinct().join(classes.select("node", F.col("rep").alias("doc_id")), "node")
    sets = staged(full_sets(docs, wanted), "sets")
    about = classes.select("node", "n", "agree").join(shared_sizes(sets), "node").where(100 * F.col("shared") >= percent * F.col("n"))
    entries = staged(_met(staged(met.join(staged(about, "about"), "node"), "entries")), "entries")

    first = F.struct((-F.col("shared") / F.col("n")).alias("o"), F.xxhash64("node").alias("h"), "node", "n", "shared", "agree")
    leaders = staged(entries.groupBy("key").agg(F.min(first).alias("l"), F.count("*").alias("k")), "leaders")
    led = joined(entries, leaders.select("key", F.col("l.node").alias("b"), *[F.col(f"l.{c}").alias(f"{c}2") for c in ("n", "shared", "agree")]), ["key"], ["node"], counts=leaders.select("key", "k"))
    groups = staged(led.select("node", "b", ((F.col("node") != F.col("b")) & _plausible(percent)).alias("plausible")).distinct(), "led")
    pairs = groups.where("plausible").select(F.col("node").alias("a"), "b")
    links = staged(linked(pairs, sets, percent), "links")
    labels = staged(components(links), "labels")

    groups = groups.select(F.col("b").alias("leader"), "node").join(labels, "node", "left")
    groups = staged(groups.select("leader", "node", F.coalesce("label", "node").alias("label")), "groups")
    more = staged(links_apart(groups, sets, percent), "more")
    if not more.isEmpty():
        labels = staged(components(more.union(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))), "joined")

    named = staged(classes.select("node", "rep", "k").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "named")
    component = staged(named.groupBy("label").agg(F.min("rep").alias("component_id"), F.count("*").alias("k")), "components")
    of_class = staged(joined(named.drop("k"), component.drop("k"), ["label"], ["node"], counts=component.select("label", "k")).select("node", "label", "component_id"), "of-class")
    rows = rows.select("doc_id", "text_hash", "n", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node"))
    out = joined(rows, of_class, ["node"], ["doc_id", "text_hash"], "left", counts=named.select("node", "k"))
    return out.withColumn("component_id", F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id")))


def grouped(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row per document: set size, component (its smallest doc_id), and whether it is the one that is kept."""
    return labelled(docs, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` without those that another row of their component stands for."""
    names = gone_id, gone_hash = unused(docs, "gone_id"), unused(docs, "gone_hash")
    rows = staged(labelled(docs, percent).where("node is not null"), "labelled")
    stays = F.col("doc_id") == F.col("component_id")
    gone = rows.where(~stays).select("doc_id", "text_hash")
    held = rows.where(stays).groupBy("label", "doc_id", "text_hash").agg(F.count("*").alias("k"))
    first = held.groupBy("label").agg(F.min("text_hash").alias("first"))
    again = staged(held.join(first, "label").where("k > 1 or text_hash <> first"), "again")  # only where a doc_id is repeated
    gone = staged(gone.union(again.where("text_hash <> first").select("doc_id", "text_hash")).distinct().toDF(*names), "gone")
    few = gone.count() <= BROADCAST_IDS
    same = (docs["doc_id"].cast("long") == gone[gone_id]) & (F.xxhash64(docs["text"]) == gone[gone_hash])
    out = docs.join(F.broadcast(gone) if few else gone, same, "left_anti")
    if again.isEmpty():
        return out
    # one row of those that are repeated as they are
    repeated = again.where("text_hash = first").select("doc_id", "text_hash").toDF(*names)
    marked = out.withColumn(gone_id, out["doc_id"].cast("long")).withColumn(gone_hash, F.xxhash64("text"))
    once = joined(marked, repeated, list(names), docs.columns).dropDuplicates(list(names))
    same = [marked[x] == repeated[x] for x in names]
    return marked.join(repeated, same, "left_anti").unionByName(once).select(*docs.columns)
