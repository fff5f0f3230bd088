"""The collection of points over changes, repeats and runs that die."""

import pytest
from pyspark.sql import functions as F

from lodeworks.sources.points import Conflict, Points

ROWS = "id string, vector array<float>, kind string"


def points(spark, tmp_path):
    return Points(spark, f"file://{tmp_path}/p", buckets=4)


def put(spark, p, rows, change):
    return p.upsert(spark.createDataFrame(rows, ROWS), change)


def held(p):
    return {r["id"]: (list(r["vector"]), r["kind"]) for r in p.read().collect()}


def test_changes_and_repeats(spark, tmp_path):
    p = points(spark, tmp_path)
    assert p.read().count() == 0 and p.delete_where(F.lit(True), "early") == 0 and p.manifest() is None
    assert put(spark, p, [(str(i), [float(i), 1.0], "a") for i in range(20)], "one") == 1
    before = p.manifest().paths
    assert put(spark, p, [("3", [9.0, 9.0], "b"), ("new", [0.0, 0.0], None), ("3", [8.0, 9.0], "b")], "two") == 2
    after = p.manifest().paths
    assert 0 < sum(before[b] != after[b] for b in before) <= 2  # only touched buckets are written
    assert held(p)["3"] == ([9.0, 9.0], "b") and len(held(p)) == 21
    p.set_payloads(spark.createDataFrame([("4", "set"), ("absent", "set")], "id string, kind string"), "three")
    p.set_where(F.col("kind") == "a", {"kind": None}, "four")
    p.delete(spark.createDataFrame([("5",), ("absent",)], "id string"), "five")
    p.delete_where(F.col("kind") == "b", "six")
    now = held(p)
    assert now["4"] == ([4.0, 1.0], "set") and now["6"] == ([6.0, 1.0], None) and "5" not in now and "3" not in now and len(now) == 19
    version = p.manifest().version
    put(spark, p, [("3", [9.0, 9.0], "b")], "two")
    p.delete_where(F.lit(True), "six")
    assert held(p) == now and p.manifest().version == version
    p.delete_where(F.lit(True), "all")
    assert held(p) == {} and p.read().columns == ["id", "vector", "kind"]


def test_a_run_that_dies_before_its_commit(spark, tmp_path, monkeypatch):
    p = points(spark, tmp_path)
    put(spark, p, [(str(i), [float(i)], "a") for i in range(8)], "one")
    before = held(p)

    def dies(self, m):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Points, "_commit", dies)
        with pytest.raises(KeyboardInterrupt):
            p.delete_where(F.col("id") < "4", "half")
    assert held(p) == before and p.manifest().version == 1
    p.delete_where(F.col("id") < "4", "half")
    assert set(held(p)) == {"4", "5", "6", "7"}
    assert p.sweep() >= 1 and set(held(p)) == {"4", "5", "6", "7"}


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    p, q = points(spark, tmp_path), points(spark, tmp_path)
    put(spark, p, [("1", [1.0], "a")], "one")
    old = q.manifest()
    put(spark, p, [("2", [2.0], "a")], "two")
    with monkeypatch.context() as m:
        m.setattr(Points, "manifest", lambda self: old)
        with pytest.raises(Conflict):
            put(spark, q, [("3", [3.0], "a")], "three")
    assert set(held(p)) == {"1", "2"}
    put(spark, q, [("3", [3.0], "a")], "three")
    assert set(held(p)) == {"1", "2", "3"}


@pytest.mark.parametrize("row", [("", [1.0], "a"), (None, [1.0], "a"), ("x", [], "a"), ("x", None, "a"), ("x", [1.0, None], "a"), ("x", [1.0, 2.0, 3.0], "a")])
def test_odd_points_are_refused(spark, tmp_path, row):
    p = points(spark, tmp_path)
    put(spark, p, [("1", [1.0], "a")], "one")
    with pytest.raises(ValueError):
        put(spark, p, [row, ("y", [1.0], "a")], "two")
    assert set(held(p)) == {"1"}


def test_payload_may_grow(spark, tmp_path):
    p = points(spark, tmp_path)
    put(spark, p, [("1", [1.0], "a")], "one")
    p.upsert(spark.createDataFrame([("2", [2.0], 7)], "id string, vector array<float>, year int"), "two")
    assert {r["id"]: (r["kind"], r["year"]) for r in p.read().collect()} == {"1": ("a", None), "2": (None, 7)}
