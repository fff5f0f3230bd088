"""The stages one after another, each against what it has to do, and the registered queries."""

import duckdb
import pytest

import corpus_pipeline
from lodeworks.llm import queries
from lodeworks.llm.common import staged
from tests.conftest import DATA


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = staged(stage(spark, docs, DATA), "test")
        if name == "packing":
            assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
            break
        assert out.columns == columns
        if name == "near duplicates":
            components = queries.QUERIES["op4_neardup"](spark, DATA).where("kept").select("doc_id")
            assert out.count() < n and out.join(components, "doc_id", "left_anti").isEmpty()
        else:
            assert out.count() == docs.count()
        docs = out
    assert docs.where(r"text rlike '[a-z0-9]@mail[0-9]'").isEmpty()


def test_run_over_nulls_repeats_and_clashes(spark, tmp_path):
    """A table with nulls in every column, empty texts, repeated rows and columns of names that operators use; and none at all."""
    near = "the quick brown fox jumps over the lazy dog while many other animals look on from the edge of the wood in the rain"
    rows = [(i, f"{near} number {i} and the words that tell it apart are w{i} x{i} y{i} z{i} u{i} v{i} " * 3, "en", "s", 1, 2, "n") for i in range(40)]
    rows += [(50, near, "en", "s", 1, 2, "n"), (51, near, "en", None, None, None, None), (52, near + " mail a.b@c.example", None, "s", 1, 2, "n"), (52, near + " mail a.b@c.example", None, "s", 1, 2, "n")]
    rows += [(60, None, "en", "s", 1, 2, "n"), (61, "", "en", "s", 1, 2, "n"), (62, "12 !!", "en", "s", 1, 2, "n"), (None, near, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, gone_id long, pii_row string"
    for n, given in enumerate((rows, [])):
        folder = tmp_path / str(n)
        spark.createDataFrame(given, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
        out = corpus_pipeline.run(spark, str(folder))
        got = out.collect()
        assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} == set(out.columns)
        kept = {r["doc_id"] for r in got}
        if given:
            assert 50 in kept and not kept & {51, 60, 61, 62} and None in kept and set(range(40)) <= kept
            for i in kept - {None}:
                own = sorted((r["start"], r["length"], r["doc_tokens"]) for r in got if r["doc_id"] == i)
                assert sum(x[1] for x in own) == own[0][2]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, DATA).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
