"""Documents cut into chunks and windows: layout repair, sections, packing. Column functions over one document's arrays, so that nothing is shuffled.

What is decided step by step is decided on lengths alone; texts are put together once the ranges are known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import HEADING_CHARS, composed, fold_letters, is_heading, once

#: Fixed values of the chunk and window rules.
CHUNK, OVERLAP, LEAST = 1200, 150, 250
WINDOW_TOKENS, PICTURE_OVERLAP = 200, 20
#: What a block of a document begins with (list marks), the letters that tell a heading in capitals, and how marks
#: that were flattened into a line are set off again.
ITEM = r"^(?:[-+•]|[0-9]{1,3}[.)])\s+"
NO_LETTERS = r"[^A-Za-zÀ-ỹĐđ]"
SET_OFF = (
    ("-", r"\s+-\s+(?=[A-ZÀ-ỴĐ])", "\n\n- "),
    ("+", r"\s+\+\s+(?=(?:Lần|Làm|Tự|[A-ZÀ-ỴĐ]))", "\n\n+ "),
    ("Đối với", r"(?<!^) (?=[0-9]{1,3}\.\s+(?:Đối với|Hình thức))", "\n\n"),
    ("Hình thức", r"(?<!^) (?=[0-9]{1,3}\.\s+(?:Đối với|Hình thức))", "\n\n"),
)
#: Titles, articles, and headings that are no content by themselves.
TITLE, ARTICLE = r"(?iu)^(?:Nội quy|Quy định)\b", r"(?iu)^(?:Điều|Khoản)\b"
NUMBERED, CLAUSE = r"^[0-9]{1,3}[.)]\s+", r"^\(?[0-9]{1,3}[.)]\s+"
ALONE = r"(?iu)^(?:Chương|Mục|Điều|Khoản)\s+[0-9]+"
ALONE_CHARS = 180
SENTENCE, PART = r"(?<=[.!?…])(?=\s+(?:[A-ZÀ-ỴĐ0-9\"“'‘(\[]))", r"(?<=[,;:])(?=\s+)"
_BLANK = r"[\s\p{Z}\x1C-\x1F\x85]"


def stripped(c: Column) -> Column:
    ends = lambda x: F.concat(F.left(x, F.lit(1)), F.right(x, F.lit(1)))
    return once(c, lambda x: F.when(ends(x).rlike(_BLANK), F.regexp_replace(x, rf"^{_BLANK}+|{_BLANK}+\z", "")).otherwise(x))


def replaced(c: Column, sign: str, pattern: str, with_: str) -> Column:
    """A pattern replaced in texts that have ``sign``, without which it cannot match."""
    return once(c, lambda x: F.when(F.contains(x, F.lit(sign)), F.regexp_replace(x, pattern, with_)).otherwise(x))


def in_capitals(line: Column) -> Column:
    capitals = once(F.regexp_replace(line, NO_LETTERS, ""), lambda x: (F.length(x) >= 5) & (x == F.upper(x)) & (x != F.lower(x)))
    return F.when(line.rlike("[a-z]"), False).otherwise(capitals)


def _by_line(plain: Column) -> Column:
    """Blocks where headings in capitals may begin one: each line that is not empty is put after a blank or after an empty line."""
    lines = F.transform(F.split(plain, "\n"), lambda x: stripped(replaced(x, "  ", " {2,}", " ")))

    def put(lines: Column) -> Column:
        def one(line: Column, i: Column) -> Column:
            apart = (i >= 2) & (F.get(lines, i - 1) == "") & (F.get(lines, i - 2) == "")
            begins = F.coalesce(apart, F.lit(False)) | F.left(line, F.lit(5)).rlike(ITEM) | in_capitals(line)
            return F.when(line == "", "").otherwise(F.concat(F.when(begins, "\n\n").otherwise(" "), line))

        return F.array_join(F.transform(lines, one), "")

    return stripped(once(lines, put))


def _at_once(plain: Column, capitals: Column | None = None) -> Column:
    """The same by a few patterns over the whole of a text, all of whose lines in capitals are in an array; \\x01 marks where a block begins."""
    edge = _BLANK[:-1] + "&&[^\\n]]*"
    x = stripped(F.regexp_replace(replaced(plain, "  ", " {2,}", " "), f"{edge}\\n{edge}", "\n"))
    if capitals is not None:
        quoted = F.transform(capitals, lambda c: F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
        before = F.concat(F.lit(r"\n+(?=(?:"), F.array_join(quoted, "|"), F.lit(r")(?:\n|\z))"))
        x = F.when(F.size(capitals) > 0, F.regexp_replace(x, before, F.lit("\x01"))).otherwise(x)
    x = F.regexp_replace(x, "\\n{3,}", "\x01")
    x = F.regexp_replace(x, "[\\n\\x01]+(?=(?:[-+•]|[0-9]{1,3}[.)]) )", "\x01")
    return F.replace(F.regexp_replace(x, "\\n+", " "), F.lit("\x01"), F.lit("\n\n"))


#: Distinct lines in capitals beyond which a text is looked at line by line.
FEW_CAPITALS = 20


def _by_capitals(plain: Column) -> Column:
    """The same for a text that may have lines in capitals: few of them are found first, with more of them it goes line by line."""
    lines = F.array_distinct(F.regexp_extract_all(plain, F.lit(r"(?<![^\n])[^a-z\n]{5,}(?![^\n])"), F.lit(0)))
    found = F.filter(F.transform(lines, lambda x: stripped(replaced(x, "  ", " {2,}", " "))), in_capitals)
    return once(found, lambda c: F.when(F.contains(plain, F.lit("\x01")) | (F.size(c) > FEW_CAPITALS), _by_line(plain)).otherwise(_at_once(plain, c)))


def repaired(text: Column) -> Column:
    """A document's text without the line breaks of its layout: lines are joined to blocks, which two empty lines, a heading in capitals and a list mark
    begin. Then flattened lists are set off. Null is empty."""
    plain = once(F.coalesce(text, F.lit("")), composed)
    for old, new in (("\r\n", "\n"), ("\r", "\n"), ("\t", " "), ("\f", " "), ("\x0b", " ")):
        plain = F.replace(plain, F.lit(old), F.lit(new))
    # a line in capitals has no small letter, and a text with the mark in it cannot be marked
    odd = r"(?<![^\n])[^a-z\n]{5,}(?![^\n])|\x01"
    out = once(plain, lambda x: F.when(x.rlike(odd), _by_capitals(x)).otherwise(_at_once(x)))
    for sign, mark, with_ in SET_OFF:
        out = replaced(out, sign, mark, with_)
    return stripped(out)


def is_alone(paragraph: Column) -> Column:
    """Whether a heading is context for what follows and no content: in capitals, of a numbered chapter or article, or a numbered item."""
    line = F.array_join(F.filter(F.split(paragraph, r"\s+"), lambda w: w != ""), " ")
    return ~F.contains(paragraph, F.lit("\n")) & once(line, lambda x: (F.length(x) <= ALONE_CHARS) & (in_capitals(x) | x.rlike(ALONE) | x.rlike(NUMBERED)))


def sectioned(paragraphs: Column) -> Column:
    """An array of (section, text) of a document's paragraphs; a heading that stands alone is left out. A numbered line inside an article is a
    clause and no heading; elsewhere it is one, under the document's title if there is one."""
    none = F.lit(None).cast("string")

    def looked_at(p: Column) -> Column:
        return once(stripped(F.substring_index(p, "\n", 1)), lambda line: flagged(p, line))

    def flagged(p: Column, line: Column) -> Column:
        # most paragraphs are too long or begin with another letter, so that nothing else of them is looked at
        may = (F.length(line) <= HEADING_CHARS) & fold_letters(F.left(line, F.lit(1))).rlike("[CcMmDdKkNnQqHh0-9]")
        return once(may & is_heading(line), lambda heads: told(p, line, heads))

    def told(p: Column, line: Column, heads: Column) -> Column:
        flags = {"clause": line.rlike(CLAUSE), "numbered": line.rlike(NUMBERED), "title": line.rlike(TITLE), "article": line.rlike(ARTICLE), "alone": is_alone(p)}
        return F.struct(p.alias("text"), F.when(heads, line).alias("line"), heads.alias("heads"), *[(heads & f).alias(k) for k, f in flags.items()])

    start = F.struct(none.alias("section"), none.alias("title"), F.lit(False).alias("article"), F.expr("cast(array() as array<struct<section:string,text:string>>)").alias("out"))

    def step(a: Column, p: Column) -> Column:
        heads = p["heads"] & ~(a["article"] & p["clause"])
        section = F.when(~heads, a["section"]).when(~p["title"] & p["numbered"] & a["title"].isNotNull(), F.concat(a["title"], F.lit(" — "), p["line"])).otherwise(p["line"])
        out = F.when(heads & p["alone"], a["out"]).otherwise(F.array_append(a["out"], F.struct(section.alias("section"), p["text"].alias("text"))))
        return F.struct(section.alias("section"), F.when(heads & p["title"], p["line"]).otherwise(a["title"]).alias("title"), F.when(heads, p["article"]).otherwise(a["article"]).alias("article"), out.alias("out"))

    return F.aggregate(F.transform(paragraphs, looked_at), start, step, lambda a: a["out"])


def packed(pieces: Column, budget: Column) -> Column:
    """Pieces of text joined by blanks up to the budget, in order; a longer piece stays whole."""
    start = F.struct(F.lit("").alias("line"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(a: Column, x: Column) -> Column:
        full = (a["line"] != "") & (F.length(a["line"]) + 1 + F.length(x) > budget)
        joined = F.when((a["line"] == "") | full, x).otherwise(F.concat(a["line"], F.lit(" "), x))
        return F.struct(joined.alias("line"), F.when(full, F.array_append(a["out"], a["line"])).otherwise(a["out"]).alias("out"))

    return F.aggregate(pieces, start, step, lambda a: F.when(a["line"] == "", a["out"]).otherwise(F.array_append(a["out"], a["line"])))


def fitting(text: Column, budget: Column) -> Column:
    """A text as an array of parts within the budget: at sentences, those too long at clauses, and clauses too long at words."""

    def cut(t: Column, at: str) -> Column:
        return F.filter(F.transform(F.split(t, at), stripped), lambda x: x != "")

    def smaller(parts: Column, at: str) -> Column:
        return F.flatten(F.transform(parts, lambda x: F.when(F.length(x) <= budget, F.array(x)).otherwise(packed(cut(x, at), budget))))

    return F.when(F.length(text) <= budget, F.array(text)).otherwise(smaller(smaller(cut(text, SENTENCE), PART), r"\s+"))


def units(sections: Column) -> Column:
    """An array of (section, text, n, head, end): the parts that are packed, each with its length, that of the section's title before it (none where the
    text begins with it), and where it ends when all are put one after the other with two characters between."""

    def split(s: Column) -> Column:
        return once(stripped(replaced(s["text"], "\n", r"[ \t]*\n[ \t]*", " ")), lambda one: divided(s, one))

    def divided(s: Column, one: Column) -> Column:
        head = F.when(s["section"].isNull() | F.startswith(one, s["section"]), 0).otherwise(F.length(s["section"]) + 2)
        return F.transform(fitting(one, F.greatest(F.lit(1), CHUNK - head)), lambda x: F.struct(s["section"].alias("section"), x.alias("text")))

    plain = F.flatten(F.transform(sections, split))
    start = F.expr("cast(array() as array<struct<section:string,text:string,n:int,head:int,end:bigint>>)")

    def measured(done: Column, u: Column) -> Column:
        head = F.when(u["section"].isNull() | F.startswith(u["text"], u["section"]), 0).otherwise(F.length(u["section"]) + 2)
        end = F.coalesce(F.try_element_at(done, F.lit(-1))["end"], F.lit(0)) + F.length(u["text"]) + 2
        return F.array_append(done, F.struct(u["section"].alias("section"), u["text"].alias("text"), F.length(u["text"]).alias("n"), head.cast("int").alias("head"), end.cast("long").alias("end")))

    return F.aggregate(plain, start, measured)


def ranges(units_: Column) -> Column:
    """The chunks as an array of (first, last) of units: filled up to CHUNK characters with the section's title, sections never mixed; a chunk begins
    with the last units of the one before in its section, as many as fit into OVERLAP (one at least), where these leave room."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("first"), F.expr("cast(array() as array<struct<first:int,last:int>>)").alias("out"))

    def length(first: Column, last: Column) -> Column:
        u = F.get(units_, first)
        return F.get(units_, last)["end"] - u["end"] + u["n"]

    def step(a: Column, u: Column) -> Column:
        i, first = a["i"], a["first"]
        before = F.get(units_, i - 1)
        other = ~before["section"].eqNullSafe(u["section"])
        room = F.get(units_, first)["head"] + length(first, i) <= CHUNK
        kept = F.coalesce(F.get(F.filter(F.sequence(first, i - 1), lambda x: length(x, i - 1) <= OVERLAP), F.lit(0)), i - 1)
        head = F.get(units_, kept)["head"]
        fits = (head + length(kept, i - 1) < CHUNK) & (head + length(kept, i) <= CHUNK)
        ends = (i > 0) & (other | ~room)
        begin = F.when((i == 0) | ~ends, first).when(other | ~fits, i).otherwise(kept)
        out = F.when(ends, F.array_append(a["out"], F.struct(first.alias("first"), (i - 1).alias("last")))).otherwise(a["out"])
        return F.struct((i + 1).alias("i"), begin.cast("int").alias("first"), out.alias("out"))

    return F.aggregate(units_, start, step, lambda a: F.when(a["i"] == 0, a["out"]).otherwise(F.array_append(a["out"], F.struct(a["first"].alias("first"), (a["i"] - 1).alias("last")))))


def merged(units_: Column, chunks_: Column) -> Column:
    """An array of (section, n, pieces): chunks under LEAST characters joined, without their title, to the one before in their section if both fit."""
    start = F.expr("cast(array() as array<struct<section:string,n:bigint,pieces:array<struct<first:int,last:int>>>>)")

    def step(done: Column, c: Column) -> Column:
        u, last = F.get(units_, c["first"]), F.try_element_at(done, F.lit(-1))
        body = F.get(units_, c["last"])["end"] - u["end"] + u["n"]
        n = u["head"] + body
        title_first = (u["head"] == 0) & (u["text"] == u["section"]) & (c["last"] > c["first"])
        rest = F.when(F.coalesce(title_first, F.lit(False)), body - u["n"] - 2).otherwise(body)
        joins = F.coalesce((n < LEAST) & last["section"].eqNullSafe(u["section"]) & (last["n"] + 2 + rest <= CHUNK), F.lit(False)) & (F.size(done) > 0)
        piece = F.struct((c["first"] + F.when(F.coalesce(title_first, F.lit(False)), 1).otherwise(0)).cast("int").alias("first"), c["last"].alias("last"))
        both = F.struct(last["section"].alias("section"), (last["n"] + 2 + rest).cast("long").alias("n"), F.array_append(last["pieces"], piece).alias("pieces"))
        own = F.struct(u["section"].alias("section"), n.cast("long").alias("n"), F.array(c).alias("pieces"))
        return F.when(joins, F.array_append(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), both)).otherwise(F.array_append(done, own))

    return F.aggregate(chunks_, start, step)


def chunked(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, chunk_index, section, chunk) of every document, its layout repaired first; an empty one has none."""
    paragraphs = F.filter(F.transform(F.split(F.col("t"), r"\n{2,}"), stripped), lambda p: p != "")
    cut = docs.select(F.col(id_), repaired(F.col(text)).alias("t")).select(id_, sectioned(paragraphs).alias("s")).select(id_, units(F.col("s")).alias("u"))
    found = cut.select(id_, "u", ranges(F.col("u")).alias("r")).select(id_, "u", F.posexplode(merged(F.col("u"), F.col("r"))).alias("chunk_index", "c"))
    first = F.get("u", F.col("c")["pieces"][0]["first"])
    texts = F.flatten(F.transform(F.col("c")["pieces"], lambda p: F.transform(F.slice("u", p["first"] + 1, p["last"] - p["first"] + 1), lambda x: x["text"])))
    title = F.when(first["head"] > 0, F.concat(F.col("c")["section"], F.lit("\n\n"))).otherwise("")
    return found.select(id_, "chunk_index", F.col("c")["section"].alias("section"), F.concat(title, F.array_join(texts, "\n\n")).alias("chunk"))


def windowed(docs: DataFrame, id_: str, text: str, size: int = WINDOW_TOKENS, overlap: int = PICTURE_OVERLAP) -> DataFrame:
    """(id, window_index, window) of every document: at most ``size`` words that end at a line's end where they can. A line that is too long is cut
    into windows that overlap, and what is left of it goes on with the next lines. Blanks between words are single; a null text has none."""
    step = size - overlap
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.filter(F.split(x, r"\s+"), lambda w: w != ""))
    held = docs.select(F.col(id_), F.filter(lines, lambda w: F.size(w) > 0).alias("l"))
    kind = "array<struct<line:int,word:int,last:int>>"
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("line"), F.lit(0).alias("word"), F.lit(0).alias("n"), F.expr(f"cast(array() as {kind})").alias("out"))

    def fill(a: Column, words: Column) -> Column:
        i, n = a["i"], F.size(words)
        full = (a["n"] > 0) & (a["n"] + n > size)
        fresh = full | (a["n"] == 0)
        out = F.when(full, F.array_append(a["out"], F.struct(a["line"].alias("line"), a["word"].alias("word"), (i - 1).alias("last")))).otherwise(a["out"])
        cuts = F.when(fresh, F.greatest(F.ceil((n - size) / step).cast("int"), F.lit(0))).otherwise(0)
        # a cut window is marked by a last line before its first
        windows = F.transform(F.filter(F.sequence(F.lit(0), cuts), lambda k: k < cuts), lambda k: F.struct(i.alias("line"), (k * step).cast("int").alias("word"), F.lit(-1).alias("last")))
        return F.struct((i + 1).alias("i"), F.when(fresh, i).otherwise(a["line"]).alias("line"), F.when(fresh, cuts * step).otherwise(a["word"]).cast("int").alias("word"), F.when(fresh, n - cuts * step).otherwise(a["n"] + n).cast("int").alias("n"), F.concat(out, windows).alias("out"))

    done = F.aggregate("l", start, fill, lambda a: F.when(a["n"] > 0, F.array_append(a["out"], F.struct(a["line"].alias("line"), a["word"].alias("word"), (a["i"] - 1).alias("last")))).otherwise(a["out"]))
    places = held.select(id_, "l", F.posexplode(done).alias("window_index", "p"))
    line, word, last = (F.col("p")[c] for c in ("line", "word", "last"))
    first = F.get("l", line)
    own = F.array_join(F.when(last < 0, F.slice(first, word + 1, F.lit(size))).otherwise(F.slice(first, word + 1, F.greatest(F.size(first) - word, F.lit(0)))), " ")
    more = F.transform(F.slice("l", line + 2, F.greatest(last - line, F.lit(0))), lambda w: F.array_join(w, " "))
    return places.select(id_, "window_index", F.array_join(F.concat(F.array(own), more), "\n").alias("window"))
