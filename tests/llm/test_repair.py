"""Conversation repair against a plain search, in pieces and whole."""

import hashlib
import itertools
import random
import zlib

import pytest

from lodeworks.llm import repair

from ..conftest import DATA

COLUMNS = "conv_id long, turn long, role string, text string"


def searched(rows):
    """(cost, letters) by enumerating every edit of every row and up to two insertions at each place."""
    best = None

    def go(i, state, cost, letters):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(rows) and state in (repair.START, repair.ASSISTANT):
            best = min(best, (cost, letters)) if best else (cost, letters)
        if not letters.endswith("II"):
            go(i, repair.NEXT[state], cost + 2, letters + "I")
        if i == len(rows):
            return
        initial, fault = rows[i]
        go(i + 1, state, cost + 3, letters + "D")
        if fault in (repair.FINE, repair.CUT_OFF):
            more = fault == repair.CUT_OFF
            if (state, initial) in repair.KEPT:
                go(i + 1, repair.KEPT[state, initial], cost + more, letters + "K")
            go(i + 1, repair.NEXT[state], cost + more + 2, letters + "R")

    go(0, repair.START, 0, "")
    return best


def in_tables(rows):
    """(cost, letters) of long conversations: whole paths held for each state."""

    def least(offers):
        best = {}
        for s, p in offers:
            best[s] = min(best.get(s, p), p)
        for s in (0, 1, 3, 2):
            if s in best:
                p, to = (best[s][0] + 2, best[s][1] + "I"), repair.NEXT[s]
                best[to] = min(best.get(to, p), p)
        return best

    best = least([(0, (0, ""))])
    for initial, fault in rows:
        offers = []
        for s, (c, w) in best.items():
            offers.append((s, (c + 3, w + "D")))
            if fault in (repair.FINE, repair.CUT_OFF):
                more = fault == repair.CUT_OFF
                if (s, initial) in repair.KEPT:
                    offers.append((repair.KEPT[s, initial], (c + more, w + "K")))
                offers.append((repair.NEXT[s], (c + more + 2, w + "R")))
        best = least(offers)
    return min(best[s] for s in (0, 3) if s in best)


def decoded(rows):
    d = repair.Decoder(repair.BEGINS)
    for r in rows:
        d.row(*r)
    return min(p for s, p in enumerate(d.paths()) if p and s in (0, 3))


def test_every_short_conversation():
    kinds = [("s", 0), ("u", 0), ("a", 0), ("u", 1), ("a", 3), ("x", 0)]
    for n in range(5):
        for rows in itertools.product(kinds, repeat=n):
            assert decoded(rows) == searched(rows) == in_tables(rows), rows


def unresolved(d):
    """Letters of the longest path below the ancestor that all share."""
    return max(len(p[1]) for p in d.paths() if p) - len(d.out)


def test_long_ones_stay_small_and_equal():
    rng = random.Random(3)
    for roles in ("ua", "u", "sua", "aax"):
        rows = [(rng.choice(roles), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(1500)]
        d, most = repair.Decoder(repair.BEGINS), 0
        for n, r in enumerate(rows):
            d.row(*r)
            most = max(most, unresolved(d)) if n % 10 == 0 else most
        assert min(p for s, p in enumerate(d.paths()) if p and s in (0, 3)) == in_tables(rows)
        assert most < 200 or len(set(roles)) == 1 or "x" in roles


def test_an_open_tie_takes_linear_time():
    """Rows of one role can be paired in two ways that never meet."""
    import time

    d, began = repair.Decoder(repair.BEGINS), time.time()
    for _ in range(60_000):
        d.row("u", 0)
    assert time.time() - began < 20 and unresolved(d) > 50_000


def test_pieces_pick_the_same_path():
    rng = random.Random(5)
    for trial in range(300):
        rows = [(rng.choice("suax" if trial % 3 else "ua"), rng.choice([0, 0, 1, 3, 4])) for _ in range(rng.randrange(1, 30))]
        cuts = sorted({0, *(rng.randrange(len(rows)) for _ in range(rng.randrange(4)))})
        pieces = []
        for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(rows)])):
            p = repair.Piece(1, k, 7 if k == 0 else 0)
            for r in rows[a:b]:
                p.row(None, *r)
            pieces.append(p.told())
        picks = {p[0]: p for p in repair.picked([p[:-1] for p in pieces])}
        letters = "".join(p[-1][picks[k][2]] for k, p in enumerate(pieces))
        left = [r for r in rows if r[1] != repair.DROPPED]
        assert (picks[len(pieces) - 1][8], letters) == in_tables(left)


def expected(rows):
    """The query's row of one conversation, from its rows (turn, role, text) before damage."""
    out = []
    for turn, role, text in rows:
        k = zlib.crc32(f"7:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = {1: "", 2: text.translate({ord(c): None for c in ".!?"})}.get(k, text)
        out += [] if k == 0 else [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    out.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults, white = set(), [], " \t\n\v\f\r"
    for _, role, text in out:
        blank = not text.strip(white)
        faults.append(1 if blank else 2 if (role, text) in seen else 3 if text.rstrip(white)[-1] not in ".!?" else 0)
        seen.add((role, text))
    cost, letters = in_tables([(r[1][:1], f) for r, f in zip(out, faults)])
    lines, state, i = [], repair.START, 0
    for x in letters:
        if x == "I":
            state = repair.NEXT[state]
            lines.append(repair.ROLES[state] + ":")
            continue
        _, role, text = out[i]
        i += 1
        if x != "D":
            state = repair.KEPT[state, role[:1]] if x == "K" else repair.NEXT[state]
            lines.append(f"{role if x == 'K' else repair.ROLES[state]}:{text}")
    turns = [r[0] for r in out if r[0] is not None]
    pairs = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(out, out[1:]))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count(1), faults.count(2), faults.count(3), pairs, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def got(spark, rows, extra=""):
    frame = spark.createDataFrame(rows, COLUMNS + extra)
    return {r["conv_id"]: tuple(r)[1:] for r in repair.audited(repair.damaged(frame), repair.F.col("there")).collect()}


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_one_conversation_with_most_rows(spark, partitions):
    rng = random.Random(9)
    texts = ["Fine.", "cut", " \t", "", "Ok!  ", None, "x" * 500]
    long = [(None if rng.random() < 0.02 else t, rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(texts) if t % 3 else f"Text {t}.") for t in range(700)]
    rows = [(7, *r) for r in long] + [(c, t, r, f"{c}.") for c in range(20, 60) for t, r in enumerate(["user", "assistant"])]
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = got(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])
    assert out[7] == expected(long) and len(out) == 41


def test_odd_rows(spark):
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    gone = next(t for t in range(100) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    fine = [t for t in range(100) if zlib.crc32(f"7:{t}".encode()) % 20 > 4]
    assert got(spark, [(7, gone, "user", "Gone.")])[7] == empty
    assert got(spark, []) == {}
    for rows in (
        [(fine[0], "user", "a."), (fine[0], "user", "a."), (fine[1], "assistant", "b.")],
        [(None, None, None), (None, "user", "a.")],
        [(fine[0], "user", "é" * 300_000 + "!"), (fine[1], "assistant", ". " * 100_000)],
    ):
        assert got(spark, [(7, *r) for r in rows])[7] == expected(rows)
    assert set(got(spark, [(None, fine[0], "user", "a.", 1, "y")], ", there int, text_ string")) == {None}


def test_rows_out(spark):
    t = [t for t in range(100) if zlib.crc32(f"7:{t}".encode()) % 20 > 4]
    frame = spark.createDataFrame([(7, t[0], "assistant", "a."), (7, t[1], "assistant", ""), (8, 0, "system", "s."), (8, 1, "user", "u.")], COLUMNS)
    rows = sorted(map(tuple, repair.repaired(frame).collect()))
    assert rows == [(7, 0, "I", "user", ""), (7, 1, "K", "assistant", "a."), (8, 0, "K", "system", "s."), (8, 1, "K", "user", "u."), (8, 2, "I", "assistant", "")]


def test_sql(spark):
    import duckdb

    from lodeworks.llm import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{DATA}/conversations.parquet'")
    want = con.execute(queries.ORACLES["op11_repair"])
    names = [c[0] for c in want.description]
    rows = queries.QUERIES["op11_repair"](spark, DATA)
    assert sorted(tuple(r[c] for c in names) for r in rows.collect()) == sorted(want.fetchall())
