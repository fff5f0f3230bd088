"""Hash trees find what a whole comparison finds, and read no more than they have to."""

import random

from lodeworks.operators import merge, reconcile

ROWS = "id long, h string, scope string"


def both(spark, tmp_path, old, new, width):
    a, b = (reconcile.snapshot(spark.createDataFrame(x, ROWS), f"file://{tmp_path}/{n}", "id", ["h"], "scope", width) for n, x in (("a", old), ("b", new)))
    return a, b


def changed(old, new):
    o, n = {r[0]: r for r in old}, {r[0]: r for r in new}
    scopes = {r[2] for r in new}
    return {i: "insert" if i not in o else "update" if i in n else "delete" if o[i][2] in scopes else "out of scope" for i in o.keys() | n.keys() if i not in o or i not in n or o[i][1] != n[i][1]}


def test_differences(spark, tmp_path):
    rng = random.Random(1)
    old = [(i, f"h{rng.randrange(5)}" if i % 9 else None, rng.choice(["x", "y", "z"])) for i in range(-900, 2700, 3)]
    new = [(i, f"{h}!" if 600 < i < 640 else h, s) for i, h, s in old if s != "z" and not 2000 < i < 2020] + [(20_000, "n", "x"), (601, "n", "w")]
    for n, width in enumerate((100, 10**6)):
        a, b = both(spark, tmp_path / str(n), old, new, width)
        got = {r["id"]: r["action"] for r in reconcile.differences(a, b, "id", ["h"], "scope").collect()}
        assert got == changed(old, new)


def test_only_ranges_that_differ_are_read(spark, tmp_path):
    old = [(i, str(i), "x") for i in range(4000)]
    new = [(i, "other" if i in (5, 2345) else h, s) for i, h, s in old]
    a, b = both(spark, tmp_path, old, new, 100)
    assert sorted(r["range"] for r in reconcile.differing(a, b).collect()) == [0, 23]
    found = reconcile.differences(a, b, "id", ["h"], "scope")
    assert {r["id"]: r["action"] for r in found.collect()} == {5: "update", 2345: "update"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [range") >= 2 and "23" in plan
    assert a.rows().where("range in (0, 23)").count() == 200


def test_equal_empty_and_new(spark, tmp_path):
    rows = [(i, "h", None) for i in range(50)]
    a, b = both(spark, tmp_path / "1", rows, list(reversed(rows)), 10)
    assert reconcile.differences(a, b, "id", ["h"], "scope").count() == 0
    a, b = both(spark, tmp_path / "2", [(1, "h", "x")], rows, 10)
    assert {r["action"] for r in reconcile.differences(a, b, "id", ["h"], "scope").collect()} == {"insert"}
    assert merge.index_actions(a.rows(), b.rows(), "id", ["h"], "scope").count() == 50
