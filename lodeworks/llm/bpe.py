"""Byte-level BPE: encoding and decoding of whole texts.

A text is cut into words by the vocabulary's pattern. Each word is a doubly linked list of
symbols; a priority queue holds the possible merges by (rank, place), and an entry whose
symbols have changed meanwhile is stale and skipped. Decoding concatenates the vocabulary's
byte strings and reads them as UTF-8.

Defined results: a null or empty text has no ids and decodes to the empty text; repeated rows
give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shipped

#: Fixed value: the published pattern that cuts texts into words for this vocabulary.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: the characters with the Unicode property White_Space.
WHITE_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Words in each of the two generations that a worker remembers, which bounds its memory.
REMEMBERED_WORDS = 300_000


def _ranges(kind: str, top: int = 0xFFFF) -> str:
    """The characters up to ``top`` whose general category starts with ``kind``, as the inside of a regex class."""
    parts, start = [], None
    for c in range(top + 2):
        inside = c <= top and unicodedata.category(chr(c))[0] == kind
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            parts.append(f"\\u{start:04x}-\\u{c - 1:04x}")
            start = None
    return "".join(parts)


@functools.cache
def _cutters() -> tuple[re.Pattern, regex.Pattern]:
    """The pattern for texts without characters beyond U+FFFF, with spelled-out classes, which is faster; and for any text."""
    letters, numbers = _ranges("L"), _ranges("N")
    short = (
        f"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{numbers}]+| ?[^{WHITE_SPACE}{letters}{numbers}]+"
        f"|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])|[{WHITE_SPACE}]+"
    )
    return re.compile(short), regex.compile(WORD_PATTERN.replace(r"\s", f"[{WHITE_SPACE}]").replace(f"[^[{WHITE_SPACE}]", f"[^{WHITE_SPACE}").replace(r"\S", f"[^{WHITE_SPACE}]"))


def words(text: str) -> list[str]:
    short, full = _cutters()
    return (short if len(text.encode("utf-16-le")) == 2 * len(text) else full).findall(text)


class Vocabulary:
    """The ids, merges and special strings of a tokenizer file (JSON, byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
        hidden = [b for b in range(256) if b not in set(visible)]
        byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        self.special = {x["content"]: x["id"] for x in held["added_tokens"]}
        named = {k: v for k, v in held["model"]["vocab"].items() if k not in self.special}
        as_bytes = {k: bytes(byte_of[c] for c in k) for k in named}
        self.bytes_of = {i: as_bytes[k] for k, i in named.items()} | {i: k.encode() for k, i in self.special.items()}
        self.id_of = {as_bytes[k]: i for k, i in named.items()}
        self.byte_ids = [self.id_of[bytes([b])] for b in range(256)]
        #: rank by both ids (as one number); both ids and the merged id by rank
        self.rank_of: dict[int, int] = {}
        self.pair_at: list[int] = []
        self.id_at: list[int] = []
        for rank, pair in enumerate(held["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pair_at.append(named[a] << 20 | named[b])
            self.id_at.append(named[a + b])
            self.rank_of[self.pair_at[-1]] = rank
        self.special_cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merged(self, word: bytes) -> list[int]:
        """The ids of one word."""
        rank, pair_at, id_at, byte_ids = self.rank_of.get, self.pair_at, self.id_at, self.byte_ids
        ids = [byte_ids[b] for b in word]
        n = len(ids)
        # an entry of the queue is one number: the rank, then the place of the left symbol
        queue = [r << 32 | i for i, r in enumerate([rank(a << 20 | b) for a, b in zip(ids, ids[1:], strict=False)]) if r is not None]
        if not queue:
            return ids
        heapq.heapify(queue)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            entry = pop(queue)
            i = entry & 0xFFFFFFFF
            j = after[i]
            if j >= n or ids[i] << 20 | ids[j] != pair_at[entry >> 32] or ids[i] < 0:
                continue  # stale: one of both symbols has been merged since
            ids[i] = merged = id_at[entry >> 32]
            ids[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(merged << 20 | ids[k])) is not None:
                    push(queue, r << 32 | i)
            if (h := before[i]) >= 0 and (r := rank(ids[h] << 20 | merged)) is not None:
                push(queue, r << 32 | h)
        return [x for x in ids if x >= 0]

    def of_text_word(self, word: str) -> list[int]:
        return self.merged(word.encode())

    def pieces(self, text: str) -> Iterator[tuple[str, int | None]]:
        """The stretches of a text, those that are a special string with its id."""
        if self.special_cut is None or not any(s in text for s in self.special):
            yield text, None
            return
        for part in self.special_cut.split(text):
            if part:
                yield part, self.special.get(part)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part, known in self.pieces(text):
            out += [known] if known is not None else [i for w in words(part) for i in self.merged(w.encode())]
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Memory(dict):
    """What ``made`` gives of a word's ids, by word. Words recur, so each is merged once while remembered.
    A full memory becomes the older generation, and what is still in use moves up from there."""

    def __init__(self, of_word, made):
        super().__init__()
        self.of_word, self.made, self.older = of_word, made, {}

    def __missing__(self, word: str):
        if len(self) >= REMEMBERED_WORDS:
            self.older = dict(self)
            self.clear()
        got = self.older.get(word)
        if got is None:
            got = self.made(self.of_word(word))
        self[word] = got
        return got


def remembered(vocab: Vocabulary, memory: Memory, text: str) -> list:
    """What the memory holds of each word of a text."""
    out: list = []
    for part, known in vocab.pieces(text):
        out += map(memory.__getitem__, words(part)) if known is None else [memory.made([known])]
    return out


def encoded(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with the column ``ids`` (array of int) for their texts."""
    shipped(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def ids(texts):
        vocab = vocabulary(path)
        memory = Memory(vocab.of_text_word, tuple)
        return texts.map(lambda t: [i for w in remembered(vocab, memory, t or "") for i in w])

    return docs.withColumn("ids", ids(F.col(text)))


def decoded(docs: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``docs`` with the column ``decoded`` for their ids."""
    shipped(docs.sparkSession)

    @F.pandas_udf("string")
    def texts(lists):
        vocab = vocabulary(path)
        return lists.map(lambda x: None if x is None else vocab.decode([int(i) for i in x]))

    return docs.withColumn("decoded", texts(F.col(ids)))


@functools.lru_cache(maxsize=1)
def digest_memory(path: str) -> Memory:
    """Kept by a worker from task to task: of each word the ids, written out, and the bytes that they decode to."""
    vocab = vocabulary(path)
    return Memory(vocab.of_text_word, lambda ids: (",".join(map(str, ids)), b"".join(map(vocab.bytes_of.__getitem__, ids))))


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trips(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: its number of ids, and digests of its ids and of the text they decode to.
    Ids stay in the task that made them; nothing is shuffled."""
    shipped(docs.sparkSession)

    def digests(batches):
        vocab = vocabulary(path)
        memory = digest_memory(path)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                found = remembered(vocab, memory, text.as_py() or "")
                ids = ",".join([x[0] for x in found])
                back = b"".join([x[1] for x in found]).decode("utf-8", "replace")
                rows.append((ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
            n, ids, texts = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(digests, DIGESTS)
