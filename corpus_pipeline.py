"""From raw documents to training sequences: language, near duplicates, personal data, packing.

Each stage is one operator over all rows that the stage before kept; the result is written as
Parquet to the shared folder and read again, so that a lost executor costs one stage at most. What
the operators stage on their way is deleted once their stage is written.

Defined results, for all stages: an empty table gives an empty result; rows are told apart by their
place where doc_ids repeat; columns beyond those of documents pass through, and operators name their
own columns so that none clashes; a null doc_id takes no part in near duplicates and passes on; ties
go to the smallest doc_id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm import langid, neardup, packing, pii
from lodeworks.llm.common import passing_steps, scratch, table
from lodeworks.llm.queries import tokenizer_path


def with_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that have a language: those whose text is null, has no letter or lets the language be guessed at most go.
    A null lang teaches nothing; where nothing teaches, every document with a letter stays."""
    return langid.accepted(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id; empty texts are linked with nothing and stay."""
    return neardup.deduplicated(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data masked in their texts; n_chars follows. A null text stays null."""
    return pii.masked(docs).withColumn("n_chars", F.length("text").cast("long"))


def in_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences; a null text is its closing id alone."""
    return packing.packed(docs, tokenizer_path())


STAGES = [
    ("language", with_language),
    ("near duplicates", without_copies),
    ("personal data", without_personal_data),
    ("packing", in_sequences),
]

#: SQL has no way to say these stages; tests hold them against what each has to do.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{scratch(spark)}/lodeworks/stage-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        with passing_steps(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
