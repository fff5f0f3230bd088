"""Readers and checks for files and listings of them."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import squeeze


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet files at a path; a path that does not exist is an empty table."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def listed(keys: DataFrame, column: str, prefix: str, endings: str) -> DataFrame:
    """The keys below a prefix (taken as a folder, so that a longer sibling's name does not match) with one of the endings."""
    folder = prefix if not prefix or prefix.endswith("/") else prefix + "/"
    return keys.where(F.col(column).startswith(folder) & F.lower(column).rlike(f"(?:{endings})$"))


def json_object(c: Column) -> Column:
    """A JSON object as variant; null for what cannot be read or is none."""
    v = F.try_parse_json(c)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


def read_json_lines(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON records that only a line feed separates; other line separators may stand inside."""
    return spark.read.schema(schema).option("lineSep", "\n").json(path)


def json_lines_round_trip(rows: DataFrame) -> DataFrame:
    """``rows`` exported as JSON lines to the shared folder, and read again."""
    from ..session import shared_folder

    path = f"{shared_folder(rows.sparkSession)}/lodeworks/json-lines-{uuid.uuid4().hex}"
    rows.write.option("lineSep", "\n").json(path)
    return read_json_lines(rows.sparkSession, path, rows.schema)


def corpus(rows: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, squeezed text) without empty texts; an id that occurs twice is an error when the plan runs."""
    cleaned = rows.select(id_, squeeze(F.col(text)).alias(text)).where(F.col(text) != "")
    repeated = cleaned.groupBy(id_).agg(F.count("*").alias("n"), F.first(text).alias(text))
    checked = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("repeated id "), F.col(id_).cast("string")))).otherwise(F.col(text))
    return repeated.select(id_, checked.alias(text))


def archive_report(entries: DataFrame, path: str, size: str, most: int) -> DataFrame:
    """How many entries of an archive would leave its folder, and whether it grows beyond a size."""
    p = F.regexp_replace(path, r"\\", "/")
    unsafe = p.startswith("/") | p.rlike(r"(?:^|/)\.\.(?:/|$)") | p.rlike("^[A-Za-z]:")
    return entries.agg(F.count_if(unsafe).alias("unsafe"), F.sum(size).alias("expanded"), (F.sum(size) > most).alias("too_large"))


#: Kinds of files by the endings of their names.
KINDS = {"document": r"\.(?:html?|md)$", "image": r"\.(?:png|jpe?g|webp)$", "video": r"\.(?:mp4|mov)$"}


def kind_of(column: str) -> Column:
    out = F.lit("unknown")
    for kind, ending in reversed(KINDS.items()):
        out = F.when(F.lower(column).rlike(ending), kind).otherwise(out)
    return out
