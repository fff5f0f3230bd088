"""Alias graphs against loops that do one record after the other."""

import random

from pyspark.sql import functions as F

from lodeworks.operators import aliases


def test_components(spark):
    rng = random.Random(1)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(45)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(40)] + [("hub", f"h{i}") for i in range(50)] + [("z", "z")]
    root = {n: n for e in edges for n in e}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    got = {r["name"]: r["root"] for r in aliases.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {n: top(n) for n in root}
    assert aliases.components(spark.createDataFrame([], "a string, b string")).count() == 0


def written(records, known):
    """slug, whether it was known, conflicts of each record, one after the other."""
    key = lambda s: " ".join(s.lower().split())
    slug = lambda s: "-".join(x for x in "".join(c if c.isalnum() else " " for c in s.lower()).split())
    owned, out = {}, {}
    for alias, s in sorted(known, key=lambda k: k[1]):
        owned.setdefault(key(alias), s)
    for seq, raw, canon in sorted(records):
        raw, canon = (raw or "").strip(), (canon or "").strip() or (raw or "").strip()
        if not slug(canon):
            continue
        found = owned.get(key(canon)) or owned.get(key(raw))
        series = found or slug(canon)
        lost = sum(owned.setdefault(key(n), series) != series if key(n) else 1 for n in {raw, canon})
        out[seq] = (series, found is not None, lost)
    return out


def test_write_back_in_order(spark):
    rng = random.Random(2)
    name = lambda n: rng.choice(["Name {}", "name  {}", "NAME-{}", " Name {} "]).format(rng.randrange(n))
    for n in (6, 40, 300):
        records = [(i, rng.choice([name(n), name(n), None, "", "!!"]), rng.choice([name(n), name(n), None, "  ", "??"])) for i in range(250)]
        known = [("name 1", "held-a"), ("NAME 2", "held-b"), ("name 2", "held-a")]
        rows = aliases.reconciled(spark.createDataFrame(records, "seq long, raw string, canon string").repartition(4), spark.createDataFrame(known, "alias string, slug string")).collect()
        assert {r["seq"]: (r["slug"], r["known"], r["conflicts"]) for r in rows} == written(records, known)


def test_a_long_chain_of_names(spark):
    records = [(i, f"n{i}", f"n{i - 1}") for i in range(1, 130)]
    rows = aliases.reconciled(spark.createDataFrame(records, "seq long, raw string, canon string"), spark.createDataFrame([], "alias string, slug string")).collect()
    assert {r["slug"] for r in rows} == {"n0"} and sum(not r["known"] for r in rows) == 1 and not any(r["conflicts"] for r in rows)


def test_clusters_of_two_levels(spark):
    names = spark.createDataFrame([("Đêm nhạc", 3), ("Dem nhac 2024", 2), ("Hội xuân", 1), ("hoi xuan", 5), ("Tuyển quân", 4), ("Alone", 1)], "name string, n long")
    anchors = spark.createDataFrame([("TUYỂN  quân", "Tuyển thành viên"), ("Music", "Music")], "alias string, anchor string")
    first = lambda asked: asked.select("name", F.when(F.lower("name").contains("nh"), "Đêm").when(F.col("name") == "hoi xuan", "Xuan").when(F.col("name") == "Hội xuân", "Xuân").alias("canon"))
    second = lambda asked: asked.select("name", F.when(F.lower("name").startswith("xu"), "Xuân").when(F.col("name") == "Đêm", "music").alias("canon"))
    got = {r["name"]: (r["cluster"], r["weight"], r["anchors"]) for r in aliases.clustered(names, anchors, first, second, size=2).collect()}
    assert got == {"Đêm nhạc": ("Music", 5, 1), "Dem nhac 2024": ("Music", 5, 1), "Hội xuân": ("Xuân", 6, 0), "hoi xuan": ("Xuân", 6, 0), "Tuyển quân": ("Tuyển thành viên", 4, 1), "Alone": ("Alone", 1, 0)}


def test_series_without_links_go(spark):
    series = spark.createDataFrame([(1,), (2,), (3,)], "series_id long")
    occurrences = spark.createDataFrame([(10, 1), (20, 2), (21, 2)], "occurrence_id long, series_id long")
    links = spark.createDataFrame([(100, 10), (101, 20), (102, 21)], "post_id long, occurrence_id long")
    gone = aliases.after_unlinking(series, occurrences, links, spark.createDataFrame([(100,), (101,), (999,)], "post_id long"))
    assert {k: sorted(map(tuple, v.collect())) for k, v in gone.items()} == {"links": [(100, 10), (101, 20)], "series": [(1,), (3,)], "occurrences": [(10, 1)]}
