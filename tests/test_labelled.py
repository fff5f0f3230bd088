"""Labels by key words over ids that are null or repeated, against the query's SQL."""

import duckdb

from lodeworks.plans import load

# Words are paired in an order that the SQL leaves open: items have two words at most, or all their words are in a text.
ITEMS = [(1, "harbor whistle"), (2, "harbor whistle"), (3, None), (4, "of it"), (7, "harbor"), (None, "harbor whistle"), (10, "garden"), (10, "lantern candle marble")]
TEXTS = [(1, "harbor\nmore"), (2, "more\nxwhistley"), (3, None), (4, ""), (5, "garden"), (6, "x\ngarden"), (7, "x\nlantern candle marble"), (8, "lantern\ncandle marble")]
TEXTS += [(None, "harbor and garden"), (None, "more\nlantern"), (9, "more"), (9, "more\nharbor")]


def test_null_and_repeated_ids_are_labelled_as_in_sql(spark, tmp_path):
    queries, oracles = load()
    con = duckdb.connect()
    for name, rows, schema in (("benchmark", ITEMS, "item_id long, text string"), ("documents", TEXTS, "doc_id long, text string")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = queries["f23_labelled"](spark, str(tmp_path)).select("item_id", "doc_id").collect()
    want = con.execute(oracles["f23_labelled"]).fetchall()
    assert (None, 2) in want and (2, None) not in want and (10, 7) in want
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
