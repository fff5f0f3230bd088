"""Secret scans: base rules, and a character convolutional network over every other candidate.

The base rules (assignments to names like password or token, access keys, long hexadecimal runs)
find labelled findings. A candidate is every run of 6 or more characters of the kind that keys
are made of (6 being the least of the base rules), and every finding without such a run. The network
reads its characters, long ones in overlapping parts of which the highest counts, and those around
it: an embedding and one convolution over the whole text, the maxima and means of its outputs inside
a part, their maxima beside it, a linear layer. So a text is convolved once, however many candidates
it has. It is trained in numpy on a bounded sample of parts, those that base spans cover as findings,
exact copies once; most of the findings get the surroundings of another candidate, so that it is the
value's look that is learned as well as the place. Scores are calibrated on a fifth of the sample
that the training did not see. The threshold is the largest that keeps ``RECALL`` of all labelled
findings in the whole table, and candidates at or above it become ``secret`` spans.

The sample is the parts of either label with the smallest hashes of document, place and content, so
it hangs neither on the layout of the table nor on chance.

Defined results: a null or empty text has no spans; where there are no labelled findings, or
nothing beside them, no span is added; base spans stay whatever their score; ties and repeated
rows get the same result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shipped, staged

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: What each assignment has in it; a quick look that spares most texts the pattern.
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{6,}")
#: Characters that a finding or a candidate has at least.
LEAST = 6
#: Characters that a score reads: before a part of a candidate, of the part, and after it; and how far the next part of a long candidate is.
BEFORE, INSIDE, AFTER, STRIDE = 24, 48, 8, 24
#: Parts of either label that the network is fitted on, at most.
FIT_ROWS = 3000
#: Rows of either label that a fit needs; fewer are repeated, so that any finding teaches.
LEAST_ROWS = 10
EPOCHS, LEAST_STEPS, BATCH, RATE = 6, 400, 64, 0.004
#: Share of the findings that get the surroundings of another candidate in training.
SWAPPED = 0.75
EMBED, WIDTH, FILTERS = 10, 5, 24
#: Characters to either side that a place's output hangs on.
EDGE = WIDTH // 2
#: Places that are convolved at once.
BLOCK = 1 << 14
RECALL = 0.98
BINS = 1000


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), by start and kind; the kinds' matches leftmost and non-overlapping, those that fail dropped."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def findings(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Where the values of base spans lie: without the name that they are assigned to."""
    return sorted((ASSIGN.match(text, a).start(2) if k == 0 else a, b) for a, k, b in base)


def parts(start: int, end: int) -> list[tuple[int, int]]:
    """The overlapping parts in which a candidate is read, over its whole length."""
    return [(i, min(end, i + INSIDE)) for i in range(start, max(start + 1, end - INSIDE + STRIDE), STRIDE)]


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, bool, list[tuple[int, int]], list[int]]]:
    """(start, end, whether a base span covers part of it, its parts, each part's label: 1 finding, 0 none, -1 neither)."""
    out, at, first, reach = [], 0, 0, 0
    values = findings(text, base)
    met = [False] * len(values)
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while at < len(base) and base[at][0] < end:  # reach: where the base spans that begin before this end reach to
            reach = max(reach, base[at][2])
            at += 1
        known = reach > start
        read = parts(start, end)
        if known:
            while first < len(values) and values[first][1] <= start and values[first][0] <= start:
                first += 1
            labels = [-1] * len(read)
            for v in range(first, len(values)):
                if values[v][0] >= end:
                    break
                met[v] = met[v] or start <= values[v][0] and values[v][1] <= end
                labels = [1 if x == 1 or min(b, values[v][1]) - max(a, values[v][0]) >= LEAST else -1 for x, (a, b) in zip(labels, read, strict=True)]
        else:
            labels = [0] * len(read)
        out.append((start, end, known, read, labels))
    for (start, end), found in zip(values, met, strict=True):
        if not found:
            read = parts(start, end)
            out.append((start, end, True, read, [1] * len(read)))
    return out


#: Codes of characters: 0 none, 1 other, 2 white space, then the visible ASCII ones; and which characters candidates are made of.
_CODE = np.ones(129, np.uint8)
_CODE[[9, 10, 11, 12, 13, 32]] = 2
_CODE[33:127] = np.arange(3, 97)
CODES = 97
_OF_KEYS = np.zeros(CODES, bool)
_OF_KEYS[_CODE[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", np.uint8)]] = True


def coded(text: str) -> np.ndarray:
    return _CODE[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128)]


def plain_parts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, number of its candidate) of the parts of all candidates of a text without findings, or of many, with zeros between them."""
    edge = np.diff(_OF_KEYS[codes], prepend=False, append=False)
    at = np.flatnonzero(edge)
    if len(at) and at[-1] == len(codes) - 1 and _OF_KEYS[codes[-1]]:
        at = np.append(at, len(codes))
    start, end = at[::2], at[1::2]
    kept = end - start >= LEAST
    start, end = start[kept], end[kept]
    n = np.maximum(1, -(-(end - start - INSIDE + STRIDE) // STRIDE))
    of = np.repeat(np.arange(len(start)), n)
    a = start[of] + STRIDE * (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n))
    return a, np.minimum(end[of], a + INSIDE), of


class Net(NamedTuple):
    table: np.ndarray  # code x embedding
    filters: np.ndarray  # (width * embedding) x filter
    bias: np.ndarray
    out: np.ndarray  # features, and a last one for the bias
    slope: float = 1.0
    shift: float = 0.0


def _outputs(net: Net, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of codes: what the convolution reads of each place, and its outputs; 0 where there is no character."""
    x = net.table[codes]
    x[codes == 0] = 0
    x = np.pad(x, ((0, 0), (EDGE, EDGE), (0, 0)))
    n = codes.shape[1]
    runs = np.concatenate([x[:, k : k + n] for k in range(WIDTH)], axis=2)
    h = runs.reshape(-1, WIDTH * EMBED) @ net.filters
    h += net.bias
    np.maximum(h, 0, out=h)
    h = h.reshape(*codes.shape, FILTERS)
    h[codes == 0] = 0
    return runs, h


def scores(net: Net, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The score of each part (by start) of a text, or of many with zeros between them."""
    z = np.empty(len(start), np.float64)
    behind = INSIDE + AFTER + EDGE
    for lo in range(0, len(codes), BLOCK):
        first, last = np.searchsorted(start, (lo, lo + BLOCK))
        if first == last:
            continue
        held = codes[max(0, lo - BEFORE - EDGE) : lo + BLOCK + behind]
        front = BEFORE + EDGE - min(lo, BEFORE + EDGE)
        held = np.concatenate((np.zeros(front, np.uint8), held, np.zeros(lo + BLOCK + behind - min(len(codes), lo + BLOCK + behind) + 1, np.uint8)))
        h = _outputs(net, held[None])[1][0]
        best = {1: h}
        for size in (1, 2, 4, 8):
            best[2 * size] = np.maximum(best[size][:-size], best[size][size:])
        a, b = (x[first:last] - lo + BEFORE + EDGE for x in (start, end))
        beside = np.maximum(np.maximum(best[16][a - BEFORE], best[8][a - 8]), best[8][b])
        pairs = np.stack((a, b), axis=1).ravel()
        inside, total = np.maximum.reduceat(h, pairs)[::2], np.add.reduceat(h, pairs)[::2]
        z[first:last] = inside @ net.out[:FILTERS] + beside @ net.out[FILTERS : 2 * FILTERS] + (total / (b - a)[:, None]) @ net.out[2 * FILTERS : -1] + net.out[-1]
    return 1 / (1 + np.exp(-np.clip(net.slope * z + net.shift, -60, 60)))


def best(net: Net, text: str, reads: list[list[tuple[int, int]]]) -> np.ndarray:
    """The highest score of each candidate's parts."""
    if not reads:
        return np.empty(0)
    part = np.array([p for read in reads for p in read])
    order = np.argsort(part[:, 0], kind="stable")
    got = np.empty(len(part))
    got[order] = scores(net, coded(text), part[order, 0], part[order, 1])
    return np.maximum.reduceat(got, np.cumsum([0, *map(len, reads[:-1])]))


def around(text: str, part: tuple[int, int]) -> tuple[str, str, str]:
    return text[max(0, part[0] - BEFORE - EDGE) : part[0]], text[part[0] : part[1]], text[part[1] : part[1] + AFTER + EDGE]


class Windows(NamedTuple):
    """Parts and what stands around them, as codes: before (at the end of its place), inside and after (at its beginning)."""

    before: np.ndarray
    inside: np.ndarray
    after: np.ndarray
    size: np.ndarray  # characters inside


def windows(before: list[str], inside: list[str], after: list[str]) -> Windows:
    out = Windows(*[np.zeros((len(inside), n), np.uint8) for n in (BEFORE + EDGE, INSIDE, AFTER + EDGE)], np.array([len(x) for x in inside], np.int64))
    for i, (a, b, c) in enumerate(zip(before, inside, after, strict=True)):
        out.before[i, BEFORE + EDGE - len(a) :], out.inside[i, : len(b)], out.after[i, : len(c)] = coded(a), coded(b), coded(c)
    return out


def composed(w: Windows, at: np.ndarray, around_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the parts ``at`` with the surroundings of the parts ``around_``; and what each place is: 1 inside, 2 beside, 0 neither."""
    n, front = len(at), BEFORE + EDGE
    codes, marks = np.zeros((n, front + INSIDE + AFTER + EDGE), np.uint8), np.zeros((n, front + INSIDE + AFTER + EDGE), np.uint8)
    codes[:, :front], codes[:, front : front + INSIDE] = w.before[around_], w.inside[at]
    behind = front + w.size[at][:, None] + np.arange(AFTER + EDGE)
    np.put_along_axis(codes, behind, w.after[around_], axis=1)
    place = np.arange(codes.shape[1])
    marks[:, EDGE:front] = 2
    marks[(place >= front) & (place < front + w.size[at][:, None])] = 1
    np.put_along_axis(marks, behind[:, :AFTER], np.uint8(2), axis=1)
    return codes, marks


def _forward(net: Net, codes: np.ndarray, marks: np.ndarray):
    runs, h = _outputs(net, codes)
    mine, other = np.where((marks == 1)[..., None], h, 0), np.where((marks == 2)[..., None], h, 0)
    top, beside = mine.argmax(axis=1), other.argmax(axis=1)
    many = np.maximum((marks == 1).sum(axis=1, keepdims=True), 1)
    feature = np.concatenate((np.take_along_axis(mine, top[:, None], 1)[:, 0], np.take_along_axis(other, beside[:, None], 1)[:, 0], mine.sum(axis=1) / many, np.ones((len(codes), 1), np.float32)), axis=1)
    return feature @ net.out, (runs, h, top, beside, many, feature)


def logits(net: Net, w: Windows, at: np.ndarray) -> np.ndarray:
    return np.concatenate([np.empty(0), *[_forward(net, *composed(w, x, x))[0] for x in (at[i : i + 256] for i in range(0, len(at), 256))]])


def _gradients(net: Net, codes: np.ndarray, marks: np.ndarray, label: np.ndarray):
    z, (runs, h, top, beside, many, feature) = _forward(net, codes, marks)
    dz = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - label) / len(label)
    df = dz[:, None] * net.out[None, :]
    dh, row = np.zeros_like(h), np.arange(len(label))[:, None]
    f = np.arange(FILTERS)[None, :]
    inside = marks == 1
    np.add.at(dh, (row, top, f), df[:, :FILTERS] * inside[row, top])
    np.add.at(dh, (row, beside, f), df[:, FILTERS : 2 * FILTERS] * (marks == 2)[row, beside])
    dh += inside[..., None] * (df[:, 2 * FILTERS : 3 * FILTERS] / many)[:, None, :]
    dh *= h > 0
    flat = dh.reshape(-1, FILTERS)
    d_filters = runs.reshape(len(flat), -1).T @ flat
    dx = (flat @ net.filters.T).reshape(*codes.shape, WIDTH, EMBED)
    padded = np.pad(codes, ((0, 0), (EDGE, EDGE)))
    d_table = np.zeros_like(net.table)
    for k in range(WIDTH):
        np.add.at(d_table, padded[:, k : k + codes.shape[1]], dx[:, :, k])
    d_table[0] = 0
    return d_table, d_filters, flat.sum(axis=0), feature.T @ dz


def fitted(before: list[str], inside: list[str], after: list[str], known: list[bool]) -> Net | None:
    """The calibrated network of a sample, in whose order every fifth row is for calibration; None where one label has too few rows."""
    label = np.array(known, np.float32)
    if min(label.sum(), len(label) - label.sum()) < LEAST_ROWS:
        return None
    rng = np.random.default_rng(7)
    w = windows(before, inside, after)
    held, taught = held_out(label)
    net = Net(rng.normal(0, 0.3, (CODES, EMBED)).astype(np.float32), rng.normal(0, 0.2, (WIDTH * EMBED, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 3 * FILTERS + 1).astype(np.float32))
    mean, square, step = [np.zeros_like(x) for x in net[:4]], [np.zeros_like(x) for x in net[:4]], 0
    weight = np.where(label > 0, label.sum(), len(label) - label.sum())
    chance = 1 / weight[taught] / (1 / weight[taught]).sum()  # both labels alike often
    for _ in range(max(LEAST_STEPS, EPOCHS * len(taught) // BATCH)):
        at = rng.choice(taught, BATCH, p=chance)
        beside = np.where((label[at] > 0) & (rng.random(BATCH) < SWAPPED), rng.choice(taught, BATCH), at)
        step += 1
        weights = []
        for i, (x, g) in enumerate(zip(net[:4], _gradients(net, *composed(w, at, beside), label[at]), strict=True)):
            mean[i] = 0.9 * mean[i] + 0.1 * g
            square[i] = 0.999 * square[i] + 0.001 * g * g
            weights.append((x - RATE * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32))
        net = Net(*weights)
    z, y = logits(net, w, held).astype(np.float64), label[held]
    slope, shift = 1.0, 0.0
    for _ in range(300):  # calibration: a logistic curve over the unseen part's outputs
        p = 1 / (1 + np.exp(-np.clip(slope * z + shift, -60, 60)))
        slope = max(1e-3, slope - 0.05 * (((p - y) * z).mean() + 0.01 * (slope - 1)))
        shift -= 0.05 * (p - y).mean()
    return net._replace(slope=float(slope), shift=float(shift))


def held_out(label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows for calibration and those that teach: every fifth of either label, the rest."""
    of = [np.flatnonzero(label > 0), np.flatnonzero(label <= 0)]
    held = np.sort(np.concatenate([x[::5] for x in of]))
    return held, np.setdiff1d(np.arange(len(label)), held)


class Chunk(NamedTuple):
    """Some texts of a batch: those with findings, and the others as one row of codes with the parts of all their candidates."""

    base: list[list[tuple[int, int, int]]]
    codes: np.ndarray
    first: np.ndarray  # where each text begins among the codes
    start: np.ndarray
    end: np.ndarray
    of: np.ndarray  # the number of each part's candidate


def chunked(texts: list[str]) -> Chunk:
    base = [base_spans(t) for t in texts]
    gap = np.zeros(BEFORE + EDGE, np.uint8)
    rows, first, at = [], np.zeros(len(texts), np.int64), 0
    for i, (t, found) in enumerate(zip(texts, base, strict=True)):
        first[i] = at
        if not found:
            rows += [coded(t), gap]
            at += len(t) + len(gap)
    codes = np.concatenate(rows) if rows else gap[:0]
    return Chunk(base, codes, first, *plain_parts(codes))


#: Characters of texts that are looked at together, about.
TOGETHER = 1 << 19


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    """(place of the first, texts) of a batch, of bounded size; null texts are empty."""
    held, size, first = [], 0, 0
    for i, text in enumerate(batch.column("text")):
        held.append(text.as_py() or "")
        size += len(held[-1])
        if size > TOGETHER:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def _order(key: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A hash of document, text and place."""
    x = (key.astype(np.int64).view(np.uint64) ^ (start.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(32))) >> np.uint64(1)).view(np.int64)


class Smallest:
    """The rows with the smallest orders, equal ones once."""

    def __init__(self, most: int):
        self.most, self.heap, self.held = most, [], set()

    def bound(self) -> int:
        return -self.heap[0][0] if len(self.heap) == self.most else 1 << 63

    def add(self, order: int, *row) -> None:
        if order < self.bound() and order not in self.held:
            self.held.add(order)
            if len(self.heap) < self.most:
                heapq.heappush(self.heap, (-order, *row))
            else:
                self.held.discard(-heapq.heapreplace(self.heap, (-order, *row))[0])


SAMPLED = "order long, before string, inside string, after string, known boolean"


def sampled(docs: DataFrame) -> list[tuple]:
    """(order, before, inside, after, known) of FIT_ROWS parts of either label at most, in the order of a hash, copies once."""
    shipped(docs.sparkSession)
    texts = docs.select(F.xxhash64(F.col("doc_id").cast("long"), "text").alias("key"), "text").where("text is not null")

    def smallest(batches):
        kept = {True: Smallest(FIT_ROWS), False: Smallest(FIT_ROWS)}
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for first, held in _chunks(batch):
                c = chunked(held)
                for i, (text, base) in enumerate(zip(held, c.base, strict=True)):
                    if base:
                        parts_ = [(p, label == 1) for x in candidates(text, base) for p, label in zip(x[3], x[4], strict=True) if label >= 0]
                        for (p, known), order in zip(parts_, _order(keys[[first + i]], np.array([p[0] for p, _ in parts_])), strict=True):
                            kept[known].add(int(order), *around(text, p))
                text_of = np.searchsorted(c.first, c.start, side="right") - 1
                own = c.start - c.first[text_of]
                order = _order(keys[first + text_of], own)
                for k in np.flatnonzero(order < min(kept[False].bound(), (1 << 63) - 1)):
                    a = int(own[k])
                    kept[False].add(int(order[k]), *around(held[text_of[k]], (a, a + int(c.end[k] - c.start[k]))))
        rows = [(-o, *row, known) for known, x in kept.items() for o, *row in x.heap]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], [x.split()[0] for x in SAMPLED.split(", ")])

    found = staged(texts.mapInArrow(smallest, SAMPLED), "candidates")
    rows = {}
    for known in (True, False):
        least = found.where(F.col("known") == known).groupBy("known", "before", "inside", "after").agg(F.min("order").alias("order"))
        for r in least.orderBy("order").limit(FIT_ROWS).collect():
            rows[r["order"], r["before"], r["inside"], r["after"], known] = None
    return sorted(rows)


def trained(docs: DataFrame) -> Net | None:
    """The network of a sample of the parts of all candidates; None where there is no finding, or nothing beside findings."""
    rows = sampled(docs)
    for known in (True, False):
        own = [x for x in rows if x[4] == known]
        if not own:
            return None
        rows += own * (-(-LEAST_ROWS // len(own)) - 1)
    return fitted(*[[x[i] for x in rows] for i in (1, 2, 3, 4)])


def threshold_of(texts: DataFrame, net: Net) -> float:
    """The largest score that RECALL of all labelled findings reach."""

    def binned(batches):
        n = np.zeros(BINS + 1, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                text = text.as_py() or ""
                if base := base_spans(text):
                    got = best(net, text, [c[3] for c in candidates(text, base) if 1 in c[4]])
                    n += np.bincount((got * BINS).astype(np.int64), minlength=BINS + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], ["bin", "n"])

    bins = texts.mapInArrow(binned, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("count")).collect()  # BINS rows at most
    missed, allowed = 0, sum(r["count"] for r in bins) * (1 - RECALL)
    for r in sorted(bins, key=lambda r: r["bin"]):
        missed += r["count"]
        if missed > allowed:
            return r["bin"] / BINS
    return 1.0


def found_in(net: Net | None, threshold: float, texts: list[str]) -> Iterator[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Of each text its base spans, and the spans of candidates beside them that reach the threshold."""
    c = chunked(texts)
    more: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if net is not None and len(c.start):
        n = np.append(np.flatnonzero(np.diff(c.of, prepend=-1)), len(c.of))
        got = np.maximum.reduceat(scores(net, c.codes, c.start, c.end), n[:-1])
        text_of = np.searchsorted(c.first, c.start[n[:-1]], side="right") - 1
        for k in np.flatnonzero(got >= threshold):
            i = int(text_of[k])
            more[i].append((int(c.start[n[k]] - c.first[i]), len(KINDS), int(c.end[n[k + 1] - 1] - c.first[i])))
    for text, base, new in zip(texts, c.base, more, strict=True):
        if net is not None and base:
            other = [x for x in candidates(text, base) if not x[2]]
            got = best(net, text, [x[3] for x in other])
            new = [(other[k][0], len(KINDS), other[k][1]) for k in np.flatnonzero(got >= threshold)]
        yield base, new


def reported(docs: DataFrame) -> DataFrame:
    """One row per document: base counts, a digest of the base spans, and all spans."""
    net = trained(docs)
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    threshold = 1.0 if net is None else threshold_of(texts, net)
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))

    def scan(batches):
        for batch in batches:
            for first, held in _chunks(batch):
                base, more = [], []
                for found in found_in(net, threshold, held):
                    for out, x in zip((base, more), found, strict=True):
                        out.append([dict(zip(("start", "kind", "end"), y, strict=True)) for y in x])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(held)), pa.array(base, span), pa.array(more, span)], ["doc_id", "base", "more"])

    spans = "array<struct<start:long,kind:int,end:long>>"
    rows = texts.mapInArrow(scan, f"doc_id long, base {spans}, more {spans}")

    def written(column):
        names = F.array(*[F.lit(k) for k in (*KINDS, "secret")])
        return F.array_join(F.transform(column, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(i):
        return F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long")

    return rows.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.array_sort(F.concat("base", "more"))).alias("spans"))
