"""Personal data in texts: base kinds by pattern, further identifiers by bootstrapped contexts.

The base kinds (e-mail, IP address, card number, phone number) are found by pattern and rule and
always stay. Then the corpus teaches where identifiers stand: candidates are tokens with several
digits or an at sign; those that base spans cover are the seeds. The lexical patterns of an
occurrence are the word before it, the word after it, both together, and each of these with the
token's shape. Patterns and instances (token values) form a graph that is scored in rounds: a
pattern is as good as the share of its instances that are known, an instance as good as its
patterns together. Instances that reach ``ACCEPT`` by patterns with enough seeds are reported as
``context`` spans, and are seeds themselves in the rounds that follow, so that they induce patterns
in which no base span stands.

All of it is DataFrame functions; texts are read once and never shuffled. Words, values and
patterns go through shuffles as digests, so whole words of any length count. Places are running
sums of lengths, taken in blocks of about the root of the number of matches, so that a text full
of matches takes little more than its length in time. Patterns or values with many occurrences
are dealt into pieces (``joined``).

Defined results: a null or empty text has no spans; a token counts once for each pattern however
often it is repeated, so copies do not make a pattern better; ties and repeated rows get the same
result; an empty table gives an empty result; other columns are kept or ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined, staged, unused

#: Base kinds in the order of reports, and how their spans are found. The looks to both sides keep
#: the time linear and change no match: a match never begins inside a run that it could begin before.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Tokens with four digits or more, or an at sign, at the beginning of a word.
_IN = r"[^\s\"'()<>\[\],;:"
CANDIDATE = rf"(?<!{_IN}])(?=(?:{_IN}0-9]*+[0-9]){{4}}|{_IN}@]*+@{_IN}@]){_IN}]++"
#: What a text has to have for a pattern to be tried; quicker to look for.
NEEDED = {"email": "@", "phone": "+"}
ROUNDS = 3
#: Distinct seeds that a pattern needs, and the scores that make a pattern count and an instance be reported.
SUPPORT, TRUSTED, ACCEPT = 5, 0.5, 0.8
#: Marks that may follow a token and are not part of it.
CLOSING = ".!?*%&#$-"
_WHITE = " \t\n\x0b\f\r"

Step = Callable[[Column, Column], Column]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _longs() -> Column:
    return F.expr("cast(array() as array<bigint>)")


def running(values: Column, step: Step) -> Column:
    """Running results of ``step`` over an array of longs: within blocks of about the root of its length, then over the blocks."""

    def folded(part: Column) -> Column:
        return F.aggregate(part, _longs(), lambda acc, x: F.concat(acc, F.array(F.coalesce(step(F.try_element_at(acc, F.lit(-1)), x), x))))

    def of(v: Column) -> Column:
        n = F.size(v)
        wide = F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))
        blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / wide).cast("int")), lambda b: folded(F.slice(v, b * wide + 1, wide)))

        def shifted(held: Column) -> Column:
            tops = folded(F.transform(held, lambda b: F.element_at(b, -1)))
            return _let(tops, lambda t: F.flatten(F.transform(held, lambda b, i: F.transform(b, lambda x: F.coalesce(step(F.get(t, i - 1), x), x)))))

        return F.when(n == 0, _longs()).otherwise(_let(blocks, shifted))

    return _let(values, of)


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _most(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _word(gap: Column, last: bool) -> Column:
    """The last or first word of what stands between two matches."""
    plain = F.translate(gap, _WHITE, " " * len(_WHITE))
    return F.substring_index(F.rtrim(plain), " ", -1) if last else F.substring_index(F.ltrim(plain), " ", 1)


def spans(text: str, pattern: str, needed: str | None = None, words: bool = False) -> Column:
    """Places (in code points) and values of a pattern's matches, leftmost, non-overlapping; on request with the words beside them."""
    hits = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    gaps = F.split(F.col(text), pattern, -1)

    def placed(m: Column) -> Column:
        def at(g: Column) -> Column:
            ends = running(F.zip_with(F.slice(g, 1, F.size(m)), m, lambda a, b: (F.length(a) + F.length(b)).cast("long")), _sum)

            def row(e: Column) -> Column:
                def made(x: Column, i: Column) -> Column:
                    end = F.get(e, i)
                    beside = [_word(F.get(g, i), True).alias("before"), _word(F.get(g, i + 1), False).alias("after")] if words else []
                    return F.struct((end - F.length(x)).alias("start"), end.alias("end"), x.alias("value"), *beside)

                return F.transform(m, made)

            return _let(ends, row)

        return F.when(F.size(m) > 0, _let(gaps, at))

    none = F.expr(f"cast(array() as array<struct<start:bigint,end:bigint,value:string{',before:string,after:string' if words else ''}>>)")
    tried = F.col(text).contains(needed) if needed else F.col(text).rlike("[0-9@]")
    return F.coalesce(F.when(tried, _let(hits, placed)), none)


def _is_ip(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.right(p, F.lit(3)).cast("int"), F.lit(0)) <= 255))


def _luhn(value: Column) -> Column:
    digits = F.transform(F.split(F.reverse(F.regexp_replace(value, "[^0-9]", "")), ""), lambda d: F.when(d == "", F.lit(0)).otherwise(d.cast("int")))
    kept = F.filter(F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)), lambda d: d.isNotNull())
    return F.aggregate(kept, F.lit(0), lambda a, d: a + d) % 10 == 0


def _digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", ""))


VALID = {
    "email": lambda v: F.lit(True),
    "ip": _is_ip,
    "card": _luhn,
    "phone": lambda v: _digits(v).between(9, 15),
}


def _shape(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, "[0-9]+", "9"), r"\p{L}+", "a")


def scanned(docs: DataFrame, names: tuple[str, str, str]) -> DataFrame:
    """``docs`` with a number of the row, its base spans (kind, start, end) by place, and its candidates, under these names."""
    row, base, candidates = names
    text = unused(docs, "whole_text")
    rows = docs.withColumn(text, F.coalesce("text", F.lit("")))

    def valid(i: int, kind: str) -> Column:
        kept = F.filter(spans(text, PATTERNS[kind], NEEDED.get(kind)), lambda x: VALID[kind](x["value"]))
        return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("kind"), x["end"].alias("end")))

    found = F.sort_array(F.concat(*[valid(i, k) for i, k in enumerate(KINDS)]))
    return rows.select(*docs.columns, F.monotonically_increasing_id().alias(row), found.alias(base), spans(text, CANDIDATE, words=True).alias(candidates))


def _covered(base: str, candidates: str) -> Column:
    """The candidates with the field ``known``: whether a base span covers part of them. Base spans come at their starts and candidates
    at their ends, in one order; what begins before a candidate's end and reaches furthest tells."""
    words = [F.lit("").alias(x) for x in ("value", "before", "after")]
    of_base = F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("is_base"), b["start"].alias("start"), b["end"].alias("end"), *words))
    others = F.transform(candidates, lambda c: F.struct(c["end"].alias("at"), F.lit(0).alias("is_base"), c["start"].alias("start"), c["end"].alias("end"), *[c[x].alias(x) for x in ("value", "before", "after")]))

    def of(events: Column) -> Column:
        reach = running(F.transform(events, lambda e: e["end"] * e["is_base"]), _most)
        held = _let(reach, lambda r: F.transform(events, lambda e, i: F.struct(e["is_base"].alias("is_base"), e["start"].alias("start"), e["end"].alias("end"), e["value"].alias("value"), e["before"].alias("before"), e["after"].alias("after"), (F.get(r, i) > e["start"]).alias("known"))))
        return F.filter(held, lambda e: e["is_base"] == 0)

    return _let(F.sort_array(F.concat(of_base, others)), of)


def discovered(rows: DataFrame) -> DataFrame:
    """(row, start, end) of what contexts reveal beyond base spans. ``rows``: row, base, candidates."""
    each = rows.where(F.size("candidates") > 0).select("row", F.explode(_covered("base", "candidates")).alias("c"))
    value = F.lower(F.rtrim("c.value", F.lit(CLOSING)))
    end = F.col("c.start") + F.length(F.rtrim("c.value", F.lit(CLOSING)))
    before, after = F.concat(F.lit("<"), F.lower("c.before")), F.concat(F.lit(">"), F.lower("c.after"))
    contexts = F.array(before, after, F.concat(before, after))
    patterns = F.concat(contexts, F.transform(contexts, lambda c: F.concat(c, F.lit(" "), _shape(value))))
    each = each.select("row", F.col("c.start").alias("start"), end.alias("end"), F.md5(value.cast("binary")).alias("value"), F.col("c.known").alias("known"), F.transform(patterns, lambda p: F.md5(p.cast("binary"))).alias("patterns"))
    each = staged(each.where("end > start"), "occurrences")

    edges = staged(each.select("value", "known", F.explode("patterns").alias("pattern")).groupBy("pattern", "value").agg(F.max("known").alias("known")), "edges")
    base = staged(edges.groupBy("pattern").agg(F.count("*").alias("k"), F.count_if("known").alias("seeds")).where(F.col("k") >= SUPPORT), "patterns")  # fewer values never make SUPPORT seeds
    new = staged(joined(edges.where("not known"), base.select("pattern"), ["pattern"], ["value"], counts=base.select("pattern", "k")), "open-edges")
    trusted, got = base.select("pattern", (F.col("seeds") / (F.col("k") + 1)).alias("trust"), "seeds"), None
    for n in range(ROUNDS):
        good = trusted.where((F.col("trust") >= TRUSTED) & (F.col("seeds") >= SUPPORT)).select("pattern", "trust")
        met = joined(new, good, ["pattern"], ["value"], counts=base.select("pattern", "k"))
        got = staged(met.groupBy("value").agg((1 - F.exp(F.sum(F.log(1.000001 - F.least("trust", F.lit(1.0)))))).alias("got")), f"scored-{n}")
        if n + 1 < ROUNDS:
            added = joined(new, got, ["value"], ["pattern"]).groupBy("pattern").agg(F.sum("got").alias("more"), F.count_if(F.col("got") >= ACCEPT).alias("new"))
            more, found = F.coalesce("more", F.lit(0.0)), F.coalesce("new", F.lit(0))
            trusted = base.join(added, "pattern", "left").select("pattern", ((F.col("seeds") + more) / (F.col("k") + 1)).alias("trust"), (F.col("seeds") + found).alias("seeds"))
    accepted = got.where(F.col("got") >= ACCEPT).select("value")
    return joined(each.where("not known").select("value", "row", "start", "end"), accepted, ["value"], ["row", "start"]).select("row", "start", "end")


def with_spans(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with two columns, whose names are returned: base spans, and the spans that contexts reveal."""
    row, base, candidates, more = names = tuple(unused(docs, f"pii_{x}") for x in ("row", "base", "candidates", "more"))
    rows = staged(scanned(docs, names[:3]), "scanned")
    found = discovered(rows.select(F.col(row).alias("row"), F.col(base).alias("base"), F.col(candidates).alias("candidates")))
    found = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", F.lit(len(KINDS)).alias("kind"), "end"))).alias(more))  # of one text
    found = staged(found.withColumnRenamed("row", row), "discovered")
    none = F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)")
    return rows.drop(candidates).join(found, row, "left").withColumn(more, F.coalesce(more, none)).drop(row), base, more


def _written(column: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, "context")])
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def reported(docs: DataFrame) -> DataFrame:
    """One row per document: base counts, a digest of the base spans, and all spans."""
    rows, base, more = with_spans(docs.select(F.col("doc_id").cast("long"), "text"))

    def count(i: int) -> Column:
        return F.size(F.filter(base, lambda x: x["kind"] == i)).cast("long")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(_written(F.col(base)), 256).alias("base_sha256"), _written(F.sort_array(F.concat(base, more))).alias("spans"))


def _replaced(text: str, held: Column, names: Column) -> Column:
    """The text with its spans (by place) replaced by names; what overlaps is one span, named after its first kind."""

    def merged(h: Column) -> Column:
        """Joined spans: one begins where a span starts at or beyond the reach of all before it."""

        def of(reach: Column) -> Column:
            heads = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: (i == 0) | (F.get(h, i)["start"] >= F.get(reach, i - 1)))
            return _let(heads, lambda at: F.transform(at, lambda i, k: F.struct(F.get(h, i)["start"].alias("start"), F.get(h, i)["kind"].alias("kind"), F.get(reach, F.coalesce(F.get(at, k + 1), F.size(h)) - 1).alias("end"))))

        return _let(running(F.transform(h, lambda x: x["end"]), _most), of)

    def written(spans_: Column) -> Column:
        """In blocks, each with the part of the text that it reaches over, since a part of a text is sought from its beginning."""
        wide = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(spans_))).cast("int"))

        def block(b: Column) -> Column:
            first = F.coalesce(F.get(spans_, b * wide - 1)["end"], F.lit(0)).cast("int")
            own = F.slice(spans_, b * wide + 1, wide)

            def of(x: Column) -> Column:
                return _let(F.substring(F.col(text), x["first"] + 1, F.element_at(x["own"], -1)["end"].cast("int") - x["first"]), lambda part: F.array_join(F.transform(x["own"], lambda s, k: piece(part, x, s, k)), ""))

            def piece(part: Column, x: Column, s: Column, k: Column) -> Column:
                before = F.coalesce(F.get(x["own"], k - 1)["end"].cast("int"), x["first"])
                return F.concat(F.substring(part, before - x["first"] + 1, s["start"].cast("int") - before), F.element_at(names, s["kind"] + 1))

            return _let(F.struct(first.alias("first"), own.alias("own")), of)

        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans_) - 1) / wide).cast("int")), block)
        rest = F.substring(F.col(text), F.element_at(spans_, -1)["end"].cast("int") + 1, F.length(F.col(text)))
        return F.concat(F.array_join(blocks, ""), rest)

    return _let(held, lambda h: _let(merged(h), written))


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of its texts replaced by its kind's name in brackets."""
    rows, base, more = with_spans(docs)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in (*KINDS, "context")])
    text = F.when(F.size(base) + F.size(more) > 0, _replaced("text", F.sort_array(F.concat(base, more)), names)).otherwise(F.col("text"))
    return rows.withColumn("text", text).select(*docs.columns)
