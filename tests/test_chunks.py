"""Layout repair, sections, packing and windows by cases and by plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from lodeworks.operators import chunks


def of(spark, f, *texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    return [r["x"] for r in frame.select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]


def test_layout_is_repaired(spark):
    cases = {
        "a\n\nb  c\td": "a b c d",
        "a\r\n\r\n\r\nb": "a\n\nb",
        "lead\nQUY ĐỊNH CHUNG\ntext\n- one\n2) two": "lead\n\nQUY ĐỊNH CHUNG text\n\n- one\n\n2) two",
        "gồm - Một - hai + Lần ba": "gồm\n\n- Một - hai\n\n+ Lần ba",
        "gọi 0823 2. Đối với lớp": "gọi 0823\n\n2. Đối với lớp",
        "x 3. Hình thức y": "x\n\n3. Hình thức y",
        " \n\n": "",
        None: "",
        "1. Đối với": "1. Đối với",
        "\n\n\nfirst\n \n\n\nlast　": "first\n\nlast",
        "ự ế": "ự ế",
        "ABC DE\nAbC": "ABC DE AbC",
    }
    assert of(spark, chunks.repaired, *cases) == list(cases.values())


def test_sections_of_titles_and_articles(spark):
    paragraphs = ["before", "Nội quy phòng máy", "1. Giờ mở cửa", "Mở từ 8 giờ.", "Điều 2. Vi phạm", "1. Không ăn uống", "2) Không hút thuốc", "CHƯƠNG CUỐI", "3. Phạt", "Quy định " + "rất dài " * 20, "Khác"]
    frame = spark.createDataFrame([(paragraphs,)], "p array<string>")
    got = [tuple(x) for x in frame.select(chunks.sectioned(F.col("p")).alias("s")).first()["s"]]
    assert got == [
        (None, "before"),
        ("Nội quy phòng máy", "Nội quy phòng máy"),
        ("Nội quy phòng máy — 1. Giờ mở cửa", "Mở từ 8 giờ."),
        ("Điều 2. Vi phạm", "1. Không ăn uống"),
        ("Điều 2. Vi phạm", "2) Không hút thuốc"),
        ("Nội quy phòng máy — 3. Phạt", paragraphs[9]),
        ("Nội quy phòng máy — 3. Phạt", "Khác"),
    ]


def test_parts_fit_where_they_can(spark):
    frame = spark.createDataFrame([("Một hai. Ba bốn, năm sáu; bảy tám chín mười. " + "x" * 30 + " cuối",)], "t string")
    got = frame.select(chunks.fitting(F.col("t"), F.lit(16)).alias("p")).first()["p"]
    assert got == ["Một hai.", "Ba bốn, năm sáu;", "bảy tám chín", "mười.", "x" * 30, "cuối"]


def rows(spark, *texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    return [tuple(r) for r in chunks.chunked(frame, "i", "t").orderBy("i", "chunk_index").collect()]


def test_chunks_overlap_within_their_section(spark):
    sentence = [f"Câu số {i} " + "chữ " * 25 + "hết." for i in range(30)]
    text = "Điều 1. Tên\n\n\n" + " ".join(sentence) + "\n\n\nĐiều 2. Khác\n\n\nNgắn.\n\n\nĐiều 3. Không có gì"
    got = rows(spark, text, None, "  ", "x" * 3000)
    first = [c for i, _, s, c in got if s == "Điều 1. Tên"]
    assert len(first) > 2 and all(c.startswith("Điều 1. Tên\n\nCâu số") and len(c) <= 1200 for c in first)
    for a, b in zip(first, first[1:]):
        assert b.split("\n\n")[1] == a.split("\n\n")[-1]  # the last sentence is there again
    assert (0, len(first), "Điều 2. Khác", "Điều 2. Khác\n\nNgắn.") in got and not any(s == "Điều 3. Không có gì" for _, _, s, _ in got)
    assert [r for r in got if r[0] in (1, 2)] == [] and [len(c) for i, _, _, c in got if i == 3] == [3000]


def test_a_small_chunk_joins_the_one_before(spark):
    long, short = "Dài " * 290 + "hết.", "Ngắn thôi."
    got = rows(spark, f"{long}\n\n\n{short}", f"{'Vừa ' * 100}.\n\n\n{'Nữa ' * 120}.\n\n\n{'Cuối ' * 100}.\n\n\nHết.")
    assert [len(c) for i, _, _, c in got if i == 0] == [1164 + 2 + 10]
    assert all(len(c) <= 1200 for _, _, _, c in got)


def windows(text, size, overlap):
    """Windows of words, line after line."""
    out, held = [], []
    for words in (x.split() for x in (text or "").split("\n")):
        if not words:
            continue
        if held and sum(map(len, held)) + len(words) > size:
            out.append(held)
            held = []
        held.append(words)
        while sum(map(len, held)) > size:
            out.append([held[0][:size]])
            held = [held[0][size - overlap :]]
    out += [held] if held else []
    return ["\n".join(" ".join(x) for x in w) for w in out]


@pytest.mark.parametrize(("size", "overlap"), [(10, 3), (5, 0), (200, 20)])
def test_windows(spark, size, overlap):
    rng = random.Random(size)
    texts = ["\n".join(" ".join(f"w{rng.randrange(99)}" for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 40, 450]))) for _ in range(rng.randrange(7))) for _ in range(40)] + [None, "", " \n\t"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = [tuple(r) for r in chunks.windowed(frame, "i", "t", size, overlap).orderBy("i", "window_index").collect()]
    assert got == [(i, n, w) for i, t in enumerate(texts) for n, w in enumerate(windows(t, size, overlap))]


def test_a_long_document_takes_its_time_in_proportion(spark):
    import time

    frame = spark.createDataFrame([(1, "Một câu ngắn. " * 20_000)], "i long, t string")
    began = time.time()
    assert chunks.chunked(frame, "i", "t").count() > 200 and time.time() - began < 60


def test_few_lines_in_capitals_are_found_at_once(spark):
    given = [
        "a b\nĐIỀU LỆ CHUNG\nTHE  END.\nTHE  END.\n c\n\nd\n\n\ne", "AAAAA\nb\n AAAAA \nAAAAAB\n12345\nПривет\nПРИВЕТ\nx\n2) y", "q\nA\\EB (C)|D\\Q\nq A\\EB (C)|D\\Q\nz\nA\\EB (C)|D\\Q",
        "x\n日本語日本語\ny\nABCDE", "ABCDE\x01\nb\nFGHIJ", "\n".join(f"LINE {'A' * i}\nb" for i in range(30)), "ABC\nDE FG\nÉÈÊÂÔ\nß ẞẞẞẞẞ\nß",
    ]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, t string").orderBy("i")
    got = rows.select("i", "t", chunks._by_capitals(F.col("t")).alias("a"), chunks._by_line(F.col("t")).alias("b")).collect()
    for r in got:
        assert r["a"] == r["b"], r["t"]
