"""Packing of documents into sequences of at most ``length`` tokens with little padding.

A document's ids (the vocabulary's, then a closing id) are cut into whole sequences and one
rest; a document that fits is a rest as a whole. Whole sequences need no partner. The rests are
packed in groups of bounded size by multiway differencing (Karmarkar-Karp): partial partitions
into m windows are merged, largest imbalance first, the fullest windows of one with the emptiest
of the other, which gives m near-equal windows; where one exceeds the capacity, m rises, up to a
share of ``SLACK`` windows more than the tokens ask for. Windows that exceed the capacity even
then are short of room by some tokens: so many, ``LEAST`` at least, are cut off a rest (of a
document that is cut anyway, if there is one) and laid into the window with the most room, or
into a further window where none has enough.

Groups are dealt by a hash of the piece, so the result does not hang on the order or files of
the table; only rows that are repeated so often that their group exceeds its bound are dealt on
by their place.

Defined results: a null or empty text is the closing id alone; repeated rows are packed each
on its own; a null doc_id stays null; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import functools
import heapq
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Vocabulary, vocabulary, words
from .common import handed_back, shipped, staged

#: Pieces in a group of rests: bounds the memory and time of one packing, not what is packed.
GROUP_PIECES = 3200
#: Share of windows beyond those that the tokens ask for, up to which their number rises before rests are cut.
SLACK = 0.006
#: Tokens that are cut off at least, and what their number is a multiple of.
LEAST, GRAIN = 32, 16
#: Bits of a sequence's number that name its window within a group.
WINDOW_BITS = 24
#: Words of a text that are merged at once, and what stands between them; words that hold it are merged one by one.
WORDS_AT_ONCE, BETWEEN = 1 << 16, "\0"


@functools.lru_cache(maxsize=1)
def merger(path: str) -> tiktoken.Encoding:
    """Merges each of the words that ``BETWEEN`` stands between; it gives no ids itself."""
    return tiktoken.Encoding("words", pat_str=f"[^{BETWEEN}]+", mergeable_ranks=vocabulary(path).id_of, special_tokens={})


def ids_of(vocab: Vocabulary, library: tiktoken.Encoding, text: str) -> Iterator[bytes]:
    """The ids of a text, in parts. All words of a part are merged in one call, which takes no longer than to look up
    each in a memory of words, so a worker need not hold one."""
    for part, known in vocab.pieces(text):
        if known is not None:
            yield np.array([known], "<u4").tobytes()
            continue
        found = words(part)
        for i in range(0, len(found), WORDS_AT_ONCE):
            some = found[i : i + WORDS_AT_ONCE]
            for odd, run in groupby(some, lambda w: BETWEEN in w) if BETWEEN in part else [(False, some)]:
                ids = [x for w in run for x in vocab.merged(w.encode())] if odd else library.encode_ordinary(BETWEEN.join(run))
                yield np.array(ids, "<u4").tobytes()


def cuts(tokens: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of a document's whole sequences and its rest."""
    return [(s, min(length, tokens - s)) for s in range(0, tokens, length)]


def differenced(sizes: list[int], m: int) -> np.ndarray:
    """The window (0 to m-1) of each piece, by multiway differencing.

    A partial partition holds its m window loads in falling order, less the smallest, and for each
    window a linked list of pieces; a lone piece becomes one only when it is merged."""
    n = len(sizes)
    after = np.full(n, -1)
    queue = [(-s, i) for i, s in enumerate(sizes)]
    heapq.heapify(queue)
    held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def taken(i: int):
        if i in held:
            return held.pop(i)
        load, first, last = np.zeros(m, np.int64), np.full(m, -1), np.full(m, -1)
        load[0], first[0], last[0] = sizes[i], i, i
        return load, first, last

    new = n
    while len(queue) > 1:
        load, first, last = taken(heapq.heappop(queue)[1])
        load2, first2, last2 = (x[::-1] for x in taken(heapq.heappop(queue)[1]))
        both = (first >= 0) & (first2 >= 0)
        after[last[both]] = first2[both]
        load = load + load2
        first, last = np.where(first >= 0, first, first2), np.where(first2 >= 0, last2, last)
        order = np.argsort(-load, kind="stable")
        load = load[order] - load.min()
        held[new] = load, first[order], last[order]
        heapq.heappush(queue, (-int(load[0]), new))
        new += 1
    window = np.zeros(n, np.int64)
    for k, i in enumerate(taken(queue[0][1])[1] if queue else ()):
        while i >= 0:
            window[i] = k
            i = after[i]
    return window


def balanced(sizes: list[int], capacity: int, most: int | None = None) -> tuple[np.ndarray, int]:
    """The window of each piece, and the number of windows: as many as it takes for none to exceed the capacity, but not more than ``most``."""
    total = sum(sizes)
    m = max(1, -(-total // capacity))
    while True:
        window = differenced(sizes, m)
        over = np.bincount(window, weights=sizes, minlength=m).max() - capacity
        if over <= 0 or most is not None and m >= most:
            return window, m
        # an excess of some tokens in a window asks for about as many less in each
        m = max(m + 1, min(-(-total // max(1, capacity - int(over) // 2)), most or 1 << 62))


def placed(sizes: list[int], capacity: int, cut_already: list[bool]) -> list[tuple[int, int, int, int]]:
    """(piece, start in it, length, window) of all pieces, some of them cut in two or more."""
    window, m = balanced(sizes, capacity, max(1, -(-sum(sizes) // capacity), int(sum(sizes) / (capacity * (1 - SLACK)))))
    loads = np.bincount(window, weights=sizes, minlength=m).astype(np.int64).tolist()
    held: list[list[int]] = [[] for _ in range(m)]
    for i, w in enumerate(window.tolist()):
        held[w].append(i)
    left, moved = list(sizes), []
    for w in range(m):
        while (over := loads[w] - capacity) > 0:
            i = max(held[w], key=lambda i: (left[i] >= 2 * LEAST and cut_already[i], left[i], -i))
            n = max(-(-over // GRAIN) * GRAIN, LEAST)
            if left[i] - n < LEAST:  # too little would stay
                n = left[i]
                held[w].remove(i)
            left[i] -= n
            loads[w] -= n
            moved.append((-n, i, left[i]))
    rooms = [(loads[w] - capacity, w) for w in range(m)]
    heapq.heapify(rooms)
    out = []
    for n, i, start in sorted(moved):
        if rooms[0][0] > n:
            heapq.heappush(rooms, (-capacity, m))
            m += 1
        room, w = heapq.heappop(rooms)
        heapq.heappush(rooms, (room - n, w))
        out.append((i, start, -n, w))
    return [(i, 0, left[i], w) for i, w in enumerate(window.tolist()) if left[i]] + out


def crc_marks(ids: bytes | memoryview) -> list[int]:
    """The digests (crc32) of the ids before each place where a rest may be cut, which is a multiple of GRAIN from its end, and of all of it."""
    out, digest, at = [], 0, 0
    for end in range(len(ids) % (4 * GRAIN) or 4 * GRAIN, len(ids) + 1, 4 * GRAIN):
        digest = zlib.crc32(ids[at:end], digest)
        at = end
        out.append(digest)
    return out


def crc_between(before: int, all_: int, n: int) -> int:
    """The digest of the last n ids, by the digests of those before them and of all. The digest is linear but for its constant parts."""
    nothing = bytes(4 * n)
    return all_ ^ zlib.crc32(nothing, before) ^ zlib.crc32(nothing)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
NAMES = [x.split()[0] for x in PIECES.split(", ")]


def pieces(docs: DataFrame, path: str, length: int, closing: int) -> DataFrame:
    shipped(docs.sparkSession)

    def cut(batches):
        vocab, library = vocabulary(path), merger(path)
        end = np.array([closing], "<u4").tobytes()
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                doc = doc.as_py()
                ids = memoryview(b"".join([*ids_of(vocab, library, text.as_py() or ""), end]))
                tokens = len(ids) // 4
                for start, n in cuts(tokens, length):
                    marks = crc_marks(ids[4 * start : 4 * (start + n)]) if n < length else [zlib.crc32(ids[4 * start : 4 * (start + n)])]
                    for column, x in zip(rows, (doc, start, n, marks.pop(), tokens, marks), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in rows[:5]], pa.array(rows[5], pa.list_(pa.int64()))], [*NAMES, "marks"])
            handed_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, f"{PIECES}, marks array<long>")


def packed(docs: DataFrame, path: str, length: int = 2048, closing: int = 1) -> DataFrame:
    """One row per piece: where it lies in its document, and in which sequence and where there."""
    cut = staged(pieces(docs, path, length, closing), "pieces").withColumn("n", F.monotonically_increasing_id())
    whole = cut.where(F.col("length") == length).select(*NAMES, F.col("n").bitwiseOR(F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rests = cut.where(F.col("length") < length)
    groups = max(1, -(-rests.count() // GROUP_PIECES))
    group = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens"), F.lit(groups))
    rests = rests.withColumn("group", group)
    full = rests.groupBy("group").agg(F.count("*").alias("k")).where(F.col("k") > 2 * GROUP_PIECES).select("group", F.ceil(F.col("k") / GROUP_PIECES).alias("parts"))
    dealt = rests.join(full, "group", "left").withColumn("group", F.col("group") + groups * F.pmod("n", F.coalesce("parts", F.lit(1))))

    def digest(rows: dict, i: int, at: int) -> int:
        size = rows["length"][i]
        return 0 if at == 0 else rows["ids_crc32"][i] if at == size else rows["marks"][i][(at - (size % GRAIN or GRAIN)) // GRAIN]

    def packing(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = table.select([*NAMES, "marks"]).sort_by([(x, "ascending") for x in NAMES]).to_pydict()  # the same for each run, whatever order the shuffle gives
        out: list[list] = [[] for _ in range(7)]
        ends: dict[int, int] = {}
        first = key[0].as_py() << WINDOW_BITS
        for i, start, n, w in placed(rows["length"], length, [t > length for t in rows["doc_tokens"]]):
            offset = ends.get(w, 0)
            ends[w] = offset + n
            crc = crc_between(digest(rows, i, start), digest(rows, i, start + n), n)
            for column, x in zip(out, (rows["doc_id"][i], rows["start"][i] + start, n, crc, rows["doc_tokens"][i], first + w, offset), strict=True):
                column.append(x)
        return pa.table([pa.array(c, pa.int64()) for c in out], [*NAMES, "sequence_id", "offset"])

    return whole.unionByName(dealt.groupBy("group").applyInArrow(packing, f"{PIECES}, sequence_id long, offset long"))
