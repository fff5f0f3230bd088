"""Hand-computed cases of functions and operators that the tables cannot express."""

import re

import pytest
from pyspark.sql import functions as F

from lodeworks.functions import status, text, vector
from lodeworks.operators import entities, filters, fusion, greedy, hooks, intervals, merge, search, sequences
from lodeworks.sources import files


def bare(c):
    return text.without_watermark(c, ("sample club", "smp"))


def one(spark, expression, *values):
    names = [f"c{i}" for i in range(len(values))]
    frame = spark.createDataFrame([tuple(values)], ", ".join(f"{n} {'double' if isinstance(v, float) else 'long' if isinstance(v, int) else 'string'}" for n, v in zip(names, values)))
    return frame.select(expression(*map(F.col, names)).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (text.fold, "Đặng Thị ÁÉ ñ", "Dang Thi AE n"),
        (text.fold, "Đặ\u0323ng ｆｕｌｌ ﬁne ½ ² ŉ ĳ Å ⅷ ㎏", "Dang full fine 12 2 n ij A viii kg"),
        (text.fold, "ß æ ø 日本 😀", "    "),
        (text.composed, "e\u0301 a\u0323\u0302 \u212b \u1112\u1161\u11ab ñ", "é ậ Å 한 ñ"),
        (text.composed, None, None),
        (text.clean, "cafe\u0301\u0020\u00a0x", "café x"),
        (text.slug, "  Ngày hội Đổi mới 2024!! ", "ngay-hoi-doi-moi-2024"),
        (text.slug, "!!!", ""),
        (text.alias_key, "  Lễ   HỘI\t", "le hoi"),
        (text.clean, "a\r\n\tb  c", "a b c"),
        (text.clean, "Không có chữ", ""),
        (text.clean, "API error: quota", ""),
        (text.clean, None, ""),
        (text.clean_lines, "a  b\r\n\r\n c", "a b\nc"),
        (text.is_boilerplate, "Hãy subscribe cho kênh", True),
        (text.is_boilerplate, "<", True),
        (text.is_boilerplate, "Xin chào", False),
        (text.terms, "Các bạn và BẠN có a x1 test_1", ["bạn", "x1", "test_1"]),
        (text.point_id, "video_transcript:1:2", "uuid"),
        (text.facts, "Phí 100.000 đồng, gọi 0823 644 212 hoặc a.b@c.vn", ["0823 644 212", "100.000", "a.b@c.vn"]),
        (bare, "SAMPLE CLUB\nMã lớp 1010\n0 1 0 1 1 0 0 1 1\nSMP", "Mã lớp 1010"),
        (bare, "smp sample club", ""),
        (text.without_fence, '```json\n{"a": 1}\n```', '{"a": 1}'),
        (text.json_fragment, 'x {"a": {"b": 1}} y', '{"a": {"b": 1}}'),
        (text.json_fragment, "none", None),
        (text.is_heading, "Điều 5. Quy định", True),
        (text.is_heading, "Điều" + " dài" * 60, False),
        (text.is_small_talk, "Cảm ơn bạn nhé!", True),
        (text.is_small_talk, "😊", True),
        (text.is_small_talk, "tìm ảnh khai mạc", False),
        (text.id_in_url, "https://x.com/123456/posts/123456789", "123456789"),
        (text.object_key, "\\a\\b/", "a/b"),
        (status.result_state, " skipped ", "DONE"),
        (status.import_state, "skipped", "PENDING"),
        (status.import_state, None, "DONE"),
        (status.finite, "NaN", None),
        (status.finite_int, "-2.7", -2),
    ],
)
def test_column_functions(spark, f, given, want):
    got = one(spark, f, given)
    if want == "uuid":
        import uuid

        want = str(uuid.uuid5(uuid.NAMESPACE_URL, given))
    assert got == want


@pytest.mark.parametrize(
    ("f", "pattern"),
    [
        (lambda c: text.without_watermark(text.clean_lines(c), ("sample club",)), text.DECORATION),  # F1
        (text.clean_lines, r"\r\n?"),  # F7
        (text.clean, r"[\s\p{Z}\p{Cc}]+"),  # F8
    ],
)
def test_texts_are_cleaned_once(spark, f, pattern):
    frame = spark.createDataFrame([("a",)], "c string").select(f(F.col("c")).alias("x"))
    assert frame._jdf.queryExecution().optimizedPlan().toString().count(pattern) == 1


def test_lines_are_cleaned_as_each_of_them_is(spark):
    for given in ("\r\r\n \t\n", "a\x85b\u2028c \n\x1f\n \u3000d\u00a0\r\x00e", " a\tb \n\n  c  d ", "\n", "error\n", "漢漢err漢or漢", "x" * 40 + " ERROR", "x" * 40 + "\nAPI  ERROR: a api error", "Rate l\u0131mit is 3", "l\u1ed6I a"):
        lines = [" ".join(re.sub(r"[\s\x00-\x1f\x7f-\x9f\u00a0\u3000]+", " ", x).split()) for x in given.replace("\r\n", "\n").replace("\r", "\n").split("\n")]
        want = "\n".join(x for x in lines if x)
        plain = want.replace("漢", "").lower()
        reported = plain in text.ERROR_TEXTS or any(re.search("(?i)" + p, want) for p in text.ERROR_PATTERNS)
        assert one(spark, text.clean_lines, given) == ("" if reported else want), given


def test_marks_beyond_the_beginning_of_a_line(spark):
    names = "sample club smp " * 30
    assert one(spark, bare, names) == ""
    assert one(spark, bare, names + "x") == names + "x"
    assert one(spark, bare, "Tiết " + names) == ("Tiết " + names).strip()
    assert one(spark, bare, "sample\nclub") == ""
    assert one(spark, bare, "a 1 0 b\t 11 00 c") == "a b c"
    assert one(spark, bare, "a b c d e f g 1 0  11 x") == "a b c d e f g 1 0 11 x"


def test_normal_forms_of_every_letter(spark):
    """All characters of the basic plane that decompose, alone and between marks, against another implementation."""
    import unicodedata

    odd = [chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000 and unicodedata.is_normalized("NFKD", chr(i)) is False and unicodedata.unidata_version >= "13"]
    rows = [(i, f"a{c}\u0323b\u0301{c}") for i, c in enumerate(odd)]
    frame = spark.createDataFrame(rows, "i long, t string")
    got = frame.select("i", text.composed(F.col("t")).alias("c"), text.fold(F.col("t")).alias("f")).collect()
    for r in got:
        t = rows[r["i"]][1]
        assert r["c"] == unicodedata.normalize("NFC", t)
        assert r["f"] == "".join(x for x in unicodedata.normalize("NFKD", t.replace("đ", "d").replace("Đ", "D")) if ord(x) < 128)
    assert len(got) > 3000


def test_clocks(spark):
    assert one(spark, text.clock, 3725.9) == "01:02:05" and one(spark, text.clock, 65.0) == "01:05" and one(spark, text.clock, -1.0) == ""
    assert one(spark, text.minutes, 6000.0) == "100:00"
    assert one(spark, lambda a, b: status.first_number(a, b), "x", "0") == 0.0
    assert one(spark, lambda a, b: text.is_grounded(a, b), "0823 644 212", "call 0823644212") is True
    assert str(one(spark, text.local_time, "2024-05-01T10:00:00+0700")) == "2024-05-01 10:00:00"


def test_vectors(spark):
    r = spark.sql("SELECT array(3.0, 4.0) AS a, array(0.0, 0.0) AS z").select(vector.norm(F.col("a")), vector.cosine(F.col("a"), F.col("z")), vector.unit(F.col("a")), vector.unit(F.col("z"))).first()
    assert tuple(r) == (5.0, 0.0, [0.6, 0.8], [0.0, 0.0])


def test_search_ties_and_zero(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    x = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [2.0, 0.0]), (3, "a", [1.0, 0.0]), (4, "b", [0.0, 0.0]), (5, "b", [-1.0, 0.0])], "id long, source string, vector array<double>")
    got = [tuple(r) for r in search.nearest(q, x, {"a": 1, "b": 5}).orderBy("source", "source_rank").select("id", "score", "source_rank").collect()]
    assert got == [(2, 1.0, 1), (4, 0.0, 1), (5, -1.0, 2)]


def test_fusion_by_hand(spark):
    ranked = spark.createDataFrame([(1, "a", 7, 1), (1, "b", 7, 2), (1, "a", 8, 2)], "query_id long, source string, e long, source_rank int")
    got = fusion.fused(ranked, "e").orderBy("rank").collect()
    assert [r["e"] for r in got] == [7, 8] and got[0]["fused_score"] == round(1 / 61 + 1 / 62, 9)
    assert fusion.fused(ranked, "e", {"a": 0.0}).where("e = 8").first()["fused_score"] == 0.0


def test_moments_do_not_overlap(spark):
    e = spark.sql("SELECT array(named_struct('score', 0.9D, 'start', 10D, 'end', 20D), named_struct('score', 0.8D, 'start', 15D, 'end', 25D), named_struct('score', 0.7D, 'start', 0D, 'end', 10D), named_struct('score', 0.6D, 'start', 30D, 'end', 40D), named_struct('score', 0.5D, 'start', 50D, 'end', 60D)) AS e")
    assert [x["start"] for x in e.select(fusion.apart_in_time(F.col("e")).alias("k")).first()["k"]] == [0.0, 10.0, 30.0]


def test_first_interval_wins_at_a_boundary(spark):
    points = spark.createDataFrame([(1, "v", 10.0), (2, "v", 99.0), (3, "w", 10.0)], "point_id long, video string, at double")
    segments = spark.createDataFrame([("v", 0, 0.0, 10.0, "a"), ("v", 1, 10.0, 20.0, "b"), ("v", 2, 20.0, 30.0, "c"), ("v", 3, 9.0, 5.0, "bad")], "video string, seg_idx int, start_sec double, end_sec double, text string")
    found = intervals.first_interval(points, segments, "video", "at", unit=7.0)
    assert {r["point_id"]: r["seg_idx"] for r in found.collect()} == {1: 0, 2: None, 3: None}
    assert {r["point_id"]: r["context"] for r in intervals.neighbours(found, segments, "video", "text").collect()} == {1: "a b", 2: "", 3: ""}


def test_short_segments_join_the_next(spark):
    rows = [(1, i, i + 1, " ".join(["w"] * n)) for i, n in enumerate([40, 10, 10, 15, 31, 5])]
    frame = spark.createDataFrame(rows, "v long, start long, end long, text string")
    got = sorted(greedy.merged_segments(frame.withColumn("id", F.col("start")), "v", "id").collect())
    assert [x["ids"] for x in got] == [[0], [1, 2, 3], [4], [5]] and (got[1]["start"], got[1]["end"]) == (1, 4)


def test_repeats_only_count_against_kept_frames_of_the_last_seconds(spark):
    rows = [("m", 0, 0.0, [1.0, 0.0]), ("m", 1, 3.0, [1.0, 0.1]), ("m", 2, 9.0, [0.0, 1.0]), ("m", 3, 11.0, [1.0, 0.0]), ("m", 4, 40.0, [1.0, 0.0]), ("n", 5, 0.0, [0.0, 0.0])]
    got = {r["frame_id"]: r["kept"] for r in greedy.without_repeats(spark.createDataFrame(rows, "media string, frame_id long, at double, vector array<double>"), "media").collect()}
    assert got == {0: True, 1: False, 2: True, 3: True, 4: True, 5: True}


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k long, s string, n long")
    new = spark.createDataFrame([(2, None, None), (3, "c", 3)], "k long, s string, n long")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(merge.upserted(old, new, ["k"])) == [(1, "a", 1), (2, None, None), (3, "c", 3)]
    assert rows(merge.upserted(old, new, ["k"], keep_if_null=["s"])) == [(1, "a", 1), (2, "b", None), (3, "c", 3)]
    assert rows(merge.updated_where(old, F.col("k") == 1, {"s": None, "n": F.col("n") + 5})) == [(1, None, 6), (2, "b", 2)]
    claims = spark.createDataFrame([("x", 1, False, 1), ("x", 2, False, 2), ("y", 1, False, 1), ("y", 2, True, 2), ("y", 3, True, 3)], "alias string, target long, override boolean, seq long")
    assert rows(entities.alias_owners(claims).select("alias", "target")) == [("x", 1), ("y", 3)]


def test_sources(spark, tmp_path):
    assert files.read_or_empty(spark, str(tmp_path / "none"), "a long").count() == 0
    twice = spark.createDataFrame([(1, "a"), (1, "b")], "id long, text string")
    with pytest.raises(Exception, match="repeated id 1"):
        files.corpus(twice, "id", "text").collect()
    keys = spark.createDataFrame([("a/b/x.PNG",), ("a/bc/x.png",), ("a/b/x.txt",)], "key string")
    assert [r[0] for r in files.listed(keys, "key", "a/b", r"\.png").collect()] == ["a/b/x.PNG"]
    assert filters.matching(keys, "key").count() == 3


def test_calls_fall_back_to_items_and_end_at_fatal_errors(spark):
    def double(xs):
        if any(x == 3 for x in xs):
            raise ValueError("three")
        return [2 * x for x in xs]

    def fatal(xs):
        raise hooks.Fatal("no key")

    rows = spark.range(1, 5, numPartitions=1)
    assert [tuple(r["r"]) for r in hooks.called(rows, "id", double, "long", "r").collect()] == [(2, None), (4, None), (None, "three"), (8, None)]
    with pytest.raises(Exception, match="no key"):
        hooks.called(rows, "id", fatal, "long", "r").collect()


def test_json_is_cleaned_at_any_depth():
    assert hooks.without_empties({" a ": " x ", "b": ["", [], {"c": None}], "": 1, "n": float("nan"), "z": 0, "f": False}) == {"a": "x", "z": 0, "f": False}
    assert hooks.without_empties([{}, [[""]]]) is None


def test_ranks_over_all_rows_and_quantiles(spark):
    rows = spark.createDataFrame([("a", i) for i in range(100)] + [("b", 7), ("b", 9)], "k string, v long").repartition(5)
    assert [r["n"] for r in sequences.global_rank(rows, ["k", "v"], "n").orderBy("k", "v").collect()] == list(range(1, 103))
    assert sorted(map(tuple, sequences.quantiles(rows, "k", "v", 0.95, "q").collect())) == [("a", 94), ("b", 9)]


