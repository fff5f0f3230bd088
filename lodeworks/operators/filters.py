"""Filters of a search: years, events, sources; validity and quality of what is found."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text

#: Hours that local years begin before those of UTC; limits and weights of a frame's quality.
LOCAL_HOURS = 7
BLUR, DARK, BRIGHT, CONTRAST = 80, 30, 225, 10
WEIGHTS = (0.45, 0.25, 0.30)


def matching(rows: DataFrame, time: str, years: list[int] | None = None, any_of: dict[str, list] | None = None) -> DataFrame:
    """The rows in one of the local years (by ranges of the stored time, which a scan can use) and, for each column, with one of its values. Nothing asked is no filter."""
    asked: list[Column] = []
    if years:

        def begin(y: int) -> Column:
            return F.lit(datetime(y, 1, 1) - timedelta(hours=LOCAL_HOURS)).cast("timestamp_ntz")

        asked.append(reduce(lambda a, b: a | b, [(F.col(time) >= begin(y)) & (F.col(time) < begin(y + 1)) for y in years]))
    asked += [F.col(c).isin(*values) for c, values in (any_of or {}).items() if values]
    return rows.where(reduce(lambda a, b: a & b, asked)) if asked else rows


def valid_years(given: Column, low: int, high: int) -> Column:
    """Of an array of texts the whole numbers within the bounds, each once, in order."""
    numbers = F.transform(given, lambda x: F.trim(x).try_cast("int"))
    return F.array_distinct(F.filter(numbers, lambda y: y.isNotNull() & y.between(low, high)))


def event_keys(spark: SparkSession, names: list[str], aliases: DataFrame) -> DataFrame:
    """(key) of the given names: an alias leads to its name, any other spelling stands for itself; keys are slugs, empty ones drop out."""
    given = spark.createDataFrame([(n,) for n in names], "given string").withColumn("alias", text.alias_key(F.col("given")))
    resolved = given.join(aliases, "alias", "left").select(text.slug(F.coalesce("name", "given")).alias("key"))
    return resolved.where("key <> ''").distinct()


def quality_reasons(blur: Column, brightness: Column, contrast: Column) -> Column:
    return F.array_compact(F.array(F.when(blur < BLUR, "blur"), F.when(brightness < DARK, "dark"), F.when(brightness > BRIGHT, "bright"), F.when(contrast < CONTRAST, "flat")))


def quality_score(blur: Column, brightness: Column, contrast: Column) -> Column:
    def clamped(c: Column) -> Column:
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))

    parts = (clamped(blur / 400), clamped(1 - F.abs(brightness - 127.5) / 127.5), clamped(contrast / 64))
    return sum((w * p for w, p in zip(WEIGHTS[1:], parts[1:], strict=True)), WEIGHTS[0] * parts[0])


def survivors_or_best(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The rows that are ok, and of a key without any its best by score, as a fallback."""
    w = Window.partitionBy(key)
    ranked = rows.withColumn("any_ok", F.max("ok").over(w)).withColumn("k", F.row_number().over(w.orderBy(F.desc("score"), order)))
    return ranked.where(F.col("ok") | (~F.col("any_ok") & (F.col("k") == 1))).withColumn("fallback", ~F.col("ok"))


def tool_result(role: Column, body: Column) -> Column:
    """Whether a message is a tool's result, and whether it can be used."""
    failed = (F.trim(body) == "") | F.try_parse_json(body).isNull() | (F.get_json_object(body, "$.success") == "false") | (F.get_json_object(body, "$.status") == "error")
    return F.when(role != "tool", "not a tool").when(F.coalesce(failed, F.lit(False)), "error").otherwise("ok")


#: Letters of a key word by which it is sought; shorter key words are sought by all they have.
SOUGHT_BY = 5


def labelled(rows: DataFrame, asked: DataFrame, id_: str, text: str, label: str) -> DataFrame:
    """(label, id) of the texts that hold, for each group of a label, one of its words, anywhere inside a word of theirs.
    asked: label, grp, word (lower case, without blanks). A word of a text that holds a key word has the key word's first
    letters somewhere: distinct words of texts and key words are joined by those, then compared, then brought back to the
    texts; there is no product of texts and labels. Words of texts that are shorter than every key word hold none and are left out first."""
    sought = asked.select("word", F.left("word", F.lit(SOUGHT_BY)).alias("gram")).distinct()
    lengths = sought.groupBy(F.length("gram").alias("n")).agg(F.min(F.length("word")).alias("shortest")).collect()  # SOUGHT_BY rows at most
    sizes = [r["n"] for r in lengths]
    tokens = rows.select(id_, F.explode(F.array_distinct(F.split(F.lower(F.col(text)), r"\s+"))).alias("token"))
    tokens = tokens.where(F.length("token") >= min((r["shortest"] for r in lengths), default=0))

    def runs(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length("token") - (n - 1), F.lit(1))), lambda i: F.substring("token", i, F.lit(n)))

    grams = F.flatten(F.array(*map(runs, sizes))) if sizes else F.expr("cast(array() as array<string>)")
    each = tokens.select("token").distinct().select("token", F.explode(F.array_distinct(grams)).alias("gram"))
    holds = each.join(sought, "gram").where(F.contains("token", "word")).select("token", "word")
    of_text = tokens.join(holds, "token").select(id_, "word").distinct()
    need = asked.groupBy(label).agg(F.countDistinct("grp").alias("need"))
    got = of_text.join(asked, "word").groupBy(label, id_).agg(F.countDistinct("grp").alias("got"))
    return got.join(need, label).where("got = need").select(label, id_)


def at_least(rows: DataFrame, column: str, threshold: float | None) -> DataFrame:
    """The rows that reach a threshold; all of them where none is asked."""
    return rows if threshold is None else rows.where(F.col(column) >= threshold)
