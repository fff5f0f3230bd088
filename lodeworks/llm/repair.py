"""Conversation repair: the cheapest edits that make turns a dialogue, by survivor-coalescence Viterbi.

A conversation's rows, in the order of their turns, become an optional system row and then pairs of user and assistant, by
keeping, re-roling, deleting and inserting rows. The decoder holds the best path into each of four states in a tree of
backpointers with reference counts. Once all survivors share an ancestor, the edits up to it are emitted and forgotten; of paths
of equal cost the one with the ASCII-least letters survives, for which their whole unresolved suffixes are compared (in the order that
is carried from row to row). A survivor that another one beats by more than any future can bring back is dropped, so that
suffixes stay short; only where the tie itself stays open, as between two ways to pair rows of one role, do they grow with it.

Rows are sorted by range, so that a conversation of any size lies in consecutive pieces. A piece is decoded for each state that
it may be entered in; a fold over the pieces' costs, and over the order of their letters in place of the letters themselves, then picks
one path for each. Only the last step reads whole conversations: it streams their rows past the edits.

Defined results. Nulls: role and text count as one space, a null turn comes first and is no turn to the gaps, a null conv_id
is a conversation like others. Ties: rows of one turn come in the order of role, the first 64 code points of text and a
digest of text, equal rows next to each other. Repeated rows are duplicates. Empty texts are blank, very long ones are streamed.
A conversation of which no row is left has no edits. An empty table gives an empty result. Columns beyond the four are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shipped, staged

#: Costs: of re-roling, deleting and inserting, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States: nothing yet, after the system row, after a user's, after an assistant's. A dialogue ends in the first or the last.
START, SYSTEM, USER, ASSISTANT = range(4)
#: What a row of the initial leads to from a state; the state after an inserted or re-roled row.
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: By how much at most a future from the second state costs more than the same from the first.
BEHIND = (
    {SYSTEM: 4, USER: 5, ASSISTANT: 3},
    {START: 0, USER: 2, ASSISTANT: 0},
    {START: 2, SYSTEM: 2, ASSISTANT: 2},
    {START: 0, SYSTEM: 4, USER: 2},
)
#: Faults of a row, and a row that the damage dropped.
FINE, BLANK, DUPLICATE, CUT_OFF, DROPPED = range(5)
#: Entries of a piece: the four states, and the beginning of a conversation.
BEGINS = 4


class Node:
    """A letter of a path; ``refs`` counts the nodes and survivors that hold it."""

    __slots__ = ("letter", "parent", "refs")

    def __init__(self, parent: Node | None, letter: str):
        self.parent, self.letter, self.refs = parent, letter, 0
        if parent:
            parent.refs += 1


def released(node: Node | None) -> None:
    while node is not None:
        node.refs -= 1
        if node.refs:
            return
        node = node.parent


def ordered(tails: Iterable[tuple[int, str]]) -> dict[tuple[int, str], tuple[int, str]]:
    """The place of each path, given as the place that it had and the letters since. Of two paths over the same rows one can go on from the
    other by insertions alone: these share a place and keep the insertions as letters."""
    places: dict[tuple[int, str], tuple[int, str]] = {}
    base, place = None, -1
    for tail in sorted(set(tails)):
        if base is None or tail[0] != base[0] or not tail[1].startswith(base[1]) or tail[1][len(base[1]) :].strip("I"):
            base, place = tail, place + 1
        places[tail] = (place, tail[1][len(base[1]) :])
    return places


class Decoder:
    """Best edits into each state, row by row. ``out`` has the letters that all survivors share. Survivors are (cost, node, place in the
    order of their whole unresolved suffixes), so that a tie compares whole suffixes without reading them again."""

    def __init__(self, entry: int):
        self.root = Node(None, "")
        self.out: list[str] = []
        self.best: list[tuple[int, Node, tuple[int, str]] | None] = [None] * 4
        self._hold({START if entry == BEGINS else entry: (0, (0, ""), "", self.root)}, relax=entry == BEGINS)

    @staticmethod
    def _offer(best: dict, state: int, offer: tuple) -> None:
        if state not in best or offer[:2] < best[state][:2]:
            best[state] = offer

    def _hold(self, best: dict[int, tuple[int, tuple[int, str], str, Node]], relax: bool = True) -> None:
        """Let ``best`` (cost, place before and letters since, letters of this row, node), after its insertions, be the survivors."""
        if relax:
            for state in (START, SYSTEM, ASSISTANT, USER):
                if state in best:
                    cost, (place, since), more, node = best[state]
                    self._offer(best, NEXT[state], (cost + INSERT, (place, since + "I"), more + "I", node))
        kept = {s: b for s, b in best.items() if not any(o in best and best[o][0] + d < b[0] for o, d in BEHIND[s].items())}
        places = ordered(b[1] for b in kept.values())
        old, self.best = self.best, [None] * 4
        grown: dict[tuple[int, str], Node] = {}  # survivors that go on alike share the nodes
        for state, (cost, tail, more, node) in kept.items():
            for letter in more:
                at = (id(node), letter)
                node = grown[at] if at in grown else grown.setdefault(at, Node(node, letter))
            node.refs += 1
            self.best[state] = (cost, node, places[tail])
        for survivor in old:
            if survivor:
                released(survivor[1])
        self._emit()

    def _emit(self) -> None:
        """Move the root down while it has one child and no survivor."""
        leaves = [b[1] for b in self.best if b]
        if self.root.refs > 1 or any(leaf is self.root for leaf in leaves):
            return
        path, node = [], leaves[0]
        while node is not self.root:
            path.append(node)
            node = node.parent
        for node in reversed(path):
            self.out.append(node.letter)
            self.root, node.parent = node, None
            if node.refs > 1 or any(leaf is node for leaf in leaves):
                return

    def row(self, initial: str, fault: int) -> None:
        best: dict[int, tuple] = {}
        more = TRUNCATED if fault == CUT_OFF else 0
        for state, survivor in enumerate(self.best):
            if survivor:
                cost, node, (place, since) = survivor
                edits = [(state, DELETE, "D")]
                if fault not in (BLANK, DUPLICATE):
                    edits.append((NEXT[state], REROLE + more, "R"))
                    if (state, initial) in KEPT:
                        edits.append((KEPT[state, initial], more, "K"))
                for to, added, letter in edits:
                    self._offer(best, to, (cost + added, (place, since + letter), letter, node))
        self._hold(best)

    def paths(self) -> list[tuple[int, str] | None]:
        """(cost, letters) into each state."""
        done, out = "".join(self.out), []
        for survivor in self.best:
            letters: list[str] = []
            node = survivor[1] if survivor else self.root
            while node is not self.root:
                letters.append(node.letter)
                node = node.parent
            out.append((survivor[0], done + "".join(reversed(letters))) if survivor else None)
        return out


def letter_order(paths: list[list[tuple[int, str] | None]]) -> list[int]:
    """The place of each path's letters in the order of all, with none, one and two insertions before them: pairs (place, insertions at
    the end), entry by entry and state by state. Letters that go on from others of the same rows do so by insertions alone, so they
    share a place and differ in the second number. -1 where there is no path."""
    put = {(k, s, e): (0, "I" * k + p[1]) for s, row in enumerate(paths) for e, p in enumerate(row) if p for k in range(3)}
    places = ordered(put.values())
    codes = [places[put[k, s, e]] if (k, s, e) in put else (-1, "") for k in range(3) for s in range(len(paths)) for e in range(4)]
    return [x for place, more in codes for x in (place, len(more) if place >= 0 else -1)]


def _columns(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batched(rows: Iterator[tuple], schema: pa.Schema, most: int = 500) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


PIECE = "range int, start long, first_turn long, last_turn long, turns long, blank long, duplicate long, truncated long, illegal long, first_role string, last_role string, costs array<long>, codes array<int>, letters array<string>"
LEGAL = {"su", "ua", "au"}


class Piece:
    """A run of one conversation's rows in one range, decoded for each entry that it may have."""

    def __init__(self, conv, range_: int, start: int):
        self.conv, self.range, self.start = conv, range_, start
        # a run that does not begin its range begins its conversation
        self.decoders = {e: Decoder(e) for e in ((BEGINS,) if start else range(5))}
        self.first_turn = self.last_turn = self.first_role = self.last_role = None
        self.turns, self.illegal, self.faults = 0, 0, [0] * 5

    def row(self, turn: int | None, initial: str, fault: int) -> None:
        if fault == DROPPED:
            return
        self.faults[fault] += 1
        if turn is not None:
            self.turns += turn != self.last_turn
            self.last_turn = turn
            if self.first_turn is None:
                self.first_turn = turn
        if self.last_role is None:
            self.first_role = initial
        else:
            self.illegal += self.last_role + initial not in LEGAL
        self.last_role = initial
        for decoder in self.decoders.values():
            decoder.row(initial, fault)

    def told(self) -> tuple:
        paths = [self.decoders[e].paths() if e in self.decoders else [None] * 4 for e in range(5)]
        flat = [p for row in paths for p in row]
        counts = (self.faults[BLANK], self.faults[DUPLICATE], self.faults[CUT_OFF], self.illegal)
        return (self.conv, self.range, self.start, self.first_turn, self.last_turn, self.turns, *counts, self.first_role, self.last_role, [p and p[0] for p in flat], letter_order(paths), [p and p[1] for p in flat])


def pieces_of(rows: Iterator[tuple]) -> Iterator[tuple]:
    piece = None
    for conv, range_, within, turn, initial, fault in rows:
        if piece is None or (piece.conv, piece.range) != (conv, range_):
            if piece:
                yield piece.told()
            piece = Piece(conv, range_, within)
        piece.row(turn, initial, fault)
    if piece:
        yield piece.told()


PICK = "range int, start long, path int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def picked(pieces: list[tuple]) -> Iterator[tuple]:
    """One path for each of a conversation's pieces in order, its totals with the last."""
    held: list[tuple[int, int, int] | None] = [None] * 4
    came: list[list[int]] = []
    turns = blank = duplicate = truncated = illegal = 0
    low = high = before = None
    for n, (_, _, _, first_turn, last_turn, own, b, d, t, i, first_role, last_role, costs, codes) in enumerate(pieces):
        offers: list[list] = [[] for _ in range(4)]
        for s in (BEGINS,) if n == 0 else range(4):
            cost, base, k = (0, 0, 0) if n == 0 else held[s] or (None, 0, 0)
            for e in range(4):
                if cost is not None and costs[s * 4 + e] is not None:
                    at = ((k * 5 + s) * 4 + e) * 2
                    offers[e].append((cost + costs[s * 4 + e], base, codes[at], codes[at + 1], s))
        best = [min(o) if o else None for o in offers]
        order = {x: j for j, x in enumerate(sorted({(o[1], o[2]) for o in best if o}))}
        # the insertions at the end count from the shortest letters of their place
        least = {x: min(o[3] for o in best if o and (o[1], o[2]) == x) for x in order}
        held = [(o[0], order[o[1], o[2]], o[3] - least[o[1], o[2]]) if o else None for o in best]
        came.append([o[4] if o else -1 for o in best])
        turns += own - (own > 0 and high == first_turn)
        low, high = first_turn if low is None else low, high if last_turn is None else last_turn
        blank, duplicate, truncated = blank + b, duplicate + d, truncated + t
        illegal += i + (before is not None and first_role is not None and before + first_role not in LEGAL)
        before = before if last_role is None else last_role
    state = min((s for s in (START, ASSISTANT) if held[s]), key=lambda s: held[s])
    gaps = 0 if low is None else min(high - low + 1 - turns, 2**63 - 1)
    totals: tuple = (gaps, blank, duplicate, truncated, illegal, held[state][0])
    for piece, from_ in zip(reversed(pieces), reversed(came), strict=True):
        yield (piece[1], piece[2], from_[state] * 4 + state, *totals)
        state, totals = from_[state], (None,) * 6


def picks_of(rows: Iterator[tuple]) -> Iterator[tuple]:
    held: list[tuple] = []
    for row in rows:
        if held and held[0][0] != row[0]:
            yield from picked(held)
            held = []
        held.append(row)
    if held:
        yield from picked(held)


class Replay:
    """The rows of a conversation after its edits, one by one."""

    def __init__(self, conv):
        self.conv, self.state, self.letters, self.at = conv, START, "", 0

    def _inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.letters) and self.letters[self.at] == "I":
            self.at, self.state = self.at + 1, NEXT[self.state]
            yield "I", ROLES[self.state], ""

    def piece(self, letters: str) -> Iterator[tuple[str, str, str]]:
        """The letters of the next piece; what is inserted after the one before comes out."""
        yield from self._inserted()
        self.letters, self.at = letters, 0

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self._inserted()
        letter, self.at = self.letters[self.at], self.at + 1
        if letter == "D":
            return
        self.state = KEPT[self.state, role[:1]] if letter == "K" else NEXT[self.state]
        yield letter, role if letter == "K" else ROLES[self.state], text


def _replayed(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(kind, conversation, value): ``begin``; ``letters`` of a piece with its totals; ``row`` with a repaired row; ``end``."""
    now = None
    for conv, _, within, role, text, *totals in rows:
        if now is None or now.conv != conv:
            if now:
                yield from (("row", now.conv, r) for r in now.piece(""))
                yield "end", now.conv, None
            now = Replay(conv)
            yield "begin", conv, None
        if within < 0:
            yield from (("row", conv, r) for r in now.piece(text))
            yield "letters", conv, (text, totals)
        else:
            yield from (("row", conv, r) for r in now.row(role, text))
    if now:
        yield from (("row", now.conv, r) for r in now.piece(""))
        yield "end", now.conv, None


def rows_of(rows: Iterator[tuple]) -> Iterator[tuple]:
    place = 0
    for kind, conv, value in _replayed(rows):
        place = 0 if kind == "begin" else place
        if kind == "row":
            yield (conv, place, *value)
            place += 1


def digests_of(rows: Iterator[tuple]) -> Iterator[tuple]:
    digest, audit, totals, first = hashlib.sha256(), [], (0,) * 6, True
    for kind, conv, value in _replayed(rows):
        if kind == "begin":
            digest, audit, totals, first = hashlib.sha256(), [], (0,) * 6, True
        elif kind == "letters":
            audit.append(value[0])
            totals = totals if value[1][0] is None else tuple(value[1])
        elif kind == "row":
            digest.update((("" if first else "\n") + f"{value[1]}:{value[2]}").encode())
            first = False
        else:
            yield (conv, *totals, "".join(audit), digest.hexdigest())


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, there): rows damaged by a checksum of their key. A row that is dropped stays with ``there`` false, so
    that its conversation is not forgotten."""
    conv, turn = F.col("conv_id"), F.col("turn").cast("long")
    blank = F.lit(" ")
    key = F.concat(F.coalesce(conv.cast("string"), blank), F.lit(":"), F.coalesce(turn.cast("string"), blank))
    k, text = F.crc32(key) % 20, F.coalesce("text", blank)
    out = rows.select(
        conv,
        turn.alias("turn"),
        F.when(k == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(k == 1, "").when(k == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (k != 0).alias("there"),
        F.explode(F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return out.drop("copy")


def _mapped(df: DataFrame, f, conv: T.StructField | None, schema: str) -> DataFrame:
    """Rows of ``df`` through the generator ``f``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = ([T.StructField("conv_id", conv.dataType)] if conv else []) + T.StructType.fromDDL(schema).fields
    out = T.StructType(fields)
    arrow = to_arrow_schema(out)
    return df.mapInArrow(lambda batches: _batched(f(_columns(batches)), arrow), out)


def _edited(rows: DataFrame, there: Column | None) -> DataFrame:
    """The rows of all conversations in order, the letters of each piece before its first row."""
    shipped(rows.sparkSession)
    given = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.lit(True) if there is None else there).alias("there"))
    # equal rows are dealt out by their number, since nothing else tells them apart
    order = ["conv_id", "turn", "role", "head", "digest", "seq"]
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    keyed = given.withColumns({"head": F.left("text", F.lit(64)), "digest": digest, "seq": F.monotonically_increasing_id(), "last": last})
    sorted_ = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = staged(sorted_.select("conv_id", "turn", "role", "text", "there", "digest", "last", F.spark_partition_id().alias("range"), (F.monotonically_increasing_id() % (1 << 33)).alias("within")), "turns")
    narrow = placed.select("conv_id", "range", "within", "turn", F.left("role", F.lit(1)).alias("initial"), "there", "digest", "last")
    seen = F.min(F.struct("range", "within")).alias("f")
    firsts = narrow.where("there and last <> ''").groupBy("conv_id", "digest").agg(seen).select("f.range", "f.within", F.lit(True).alias("first"))
    fault = F.when(~F.col("there"), DROPPED).when(F.col("last") == "", BLANK).when(F.col("first").isNull(), DUPLICATE).when(~F.col("last").isin(".", "!", "?"), CUT_OFF).otherwise(FINE)
    flagged = narrow.join(firsts, ["range", "within"], "left").select("conv_id", "range", "within", "turn", "initial", fault.alias("fault"))
    conv = rows.schema["conv_id"]
    pieces = staged(_mapped(flagged.repartition("conv_id", "range").sortWithinPartitions("conv_id", "range", "within"), pieces_of, conv, PIECE), "pieces")
    picks = _mapped(pieces.drop("letters").repartition("conv_id").sortWithinPartitions("conv_id", "range"), picks_of, None, PICK)
    totals = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    told = pieces.select("conv_id", "range", "start", "letters").join(picks, ["range", "start"])
    letters = told.select("conv_id", "range", F.lit(-1).cast("long").alias("within"), F.lit(None).cast("string").alias("role"), F.element_at("letters", F.col("path") + 1).alias("text"), *totals)
    lines = placed.where("there").select("conv_id", "range", "within", "role", "text", *[F.lit(None).cast("long").alias(c) for c in totals])
    return letters.unionByName(lines).repartition("conv_id").sortWithinPartitions("conv_id", "range", "within")


def repaired(rows: DataFrame, there: Column | None = None) -> DataFrame:
    """(conv_id, place, edit, role, text): the rows of repaired conversations (conv_id, turn, role, text; those of which ``there`` does not
    hold are gone), by place from 0, each with the edit that it comes from (K kept, R re-roled, I inserted)."""
    return _mapped(_edited(rows, there), rows_of, rows.schema["conv_id"], "place long, edit string, role string, text string")


def audited(rows: DataFrame, there: Column | None = None) -> DataFrame:
    """For each conversation: gaps, blank, duplicate, truncated, illegal, cost, audit (the edits' initials), repaired_sha256."""
    return _mapped(_edited(rows, there), digests_of, rows.schema["conv_id"], "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
