"""What packing makes of words, and that its workers do not keep them."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodeworks.llm import bpe, packing
from lodeworks.llm.queries import tokenizer_path


def test_packing_keeps_no_words(spark):
    """A worker that has cut texts of many words holds none of them afterwards, when other stages need its memory."""

    def held(batches):
        import gc

        list(batches)
        yield pa.RecordBatch.from_pydict({"n": [sum(len(x) for x in gc.get_objects() if isinstance(x, bpe.Memory))]})

    docs = spark.range(4, numPartitions=4).select(F.col("id").alias("doc_id"), F.expr("array_join(transform(sequence(1, 5000), x -> sha1(concat(id, ' ', x))), ' ')").alias("text"))
    assert packing.pieces(docs, tokenizer_path(), 2048, 1).agg(F.sum("length") > 4 * 5000).first()[0]
    assert {r["n"] for r in spark.range(4, numPartitions=4).mapInArrow(held, "n long").collect()} == {0}


def test_packing_ids():
    vocab, library = bpe.vocabulary(tokenizer_path()), packing.merger(tokenizer_path())
    between = ["", "\0", "a\0b", "\0\0 \0 a", "a" * 3000, "  a\n\n b　c", "Không có gì 123 !!\0?? 𝒳𝒴", *(f"x{s}\0y{s} z" for s in vocab.special), "w1 w2 " * (packing.WORDS_AT_ONCE // 3)]
    for text in between:
        assert b"".join(packing.ids_of(vocab, library, text)) == np.array(vocab.encode(text), "<u4").tobytes()
