"""Measures of rankings whose judgements follow from classes."""

from lodeworks.operators import metrics


def test_classes_judge_as_their_pairs_do(spark):
    labels = [(i, None if i % 11 == 0 else 90 if i == 20 else i % 3) for i in range(60)]
    rows = spark.createDataFrame([(i, c, 2 if i % 2 == 0 else 1) for i, c in labels], "id long, label int, gain int")
    asked = rows.where("id % 10 = 0").selectExpr("id AS query_id", "label")
    rankings = spark.createDataFrame([(q, k + 1, (q * 7 + k * 5 + 1) % 60) for q in range(0, 60, 10) for k in range(12)], "query_id long, rank int, id long").where("id <> query_id")
    pairs = asked.join(rows, "label").where("id <> query_id").select("query_id", "id", "gain")
    assert sorted(metrics.per_query_by_class(rankings, asked, rows).collect()) == sorted(metrics.per_query(rankings, pairs).collect())
    counts = {r["query_id"]: r["n"] for r in pairs.groupBy("query_id").count().withColumnRenamed("count", "n").collect()}
    assert {r["query_id"]: r["n_rel"] for r in metrics.class_counts(asked, rows).collect()} == counts


def test_queries_take_a_few_rows_of_their_class(spark):
    rows = spark.range(3000).selectExpr("id", "1 AS label", "1 AS gain")
    asked = rows.where("id % 50 = 0").selectExpr("id AS query_id", "label")
    first = metrics.class_first(asked, rows, 5, "id").collect()
    assert len(first) == 60 * 5
    assert sorted(r["id"] for r in first if r["query_id"] == 0) == [1, 2, 3, 4, 5]
    assert sorted(r["id"] for r in first if r["query_id"] == 2950) == [0, 1, 2, 3, 4]
