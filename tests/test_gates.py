"""Gates by hand: each reason, each message, and what odd values come to."""

from pyspark.sql import functions as F

from lodeworks.operators import gates

BODY = "🔥 [HỘI THI] Đêm chung kết\ndiễn ra ngày 12/5!"


def test_reasons_of_extraction(spark):
    rows = [
        (False, "Tên", "0.9", "Đêm"), (None, "Tên", "0.9", "Đêm"), (True, " ", "0.9", "Đêm"), (True, None, "0.9", "Đêm"), (True, "!?", "0.9", "Đêm"), (True, "Tên", "cao", "Đêm"), (True, "Tên", "0.59", "Đêm"),
        (True, "Tên", None, "Đêm"), (True, "Tên", "0.6", " "), (True, "Tên", "0.6", None), (True, "Tên", "0.6", "đêm bán kết"), (True, "Tên", " 0.6 ", "HOI THI - dem CHUNG ket; dien"), (True, "Tên", "1", "12 5"), (True, "Tên", "1", "?!"),
    ]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, e boolean, n string, c string, q string")
    got = [r["r"] for r in frame.select("i", gates.extraction_reason(F.col("e"), F.col("n"), F.col("c"), F.col("q"), F.lit(BODY)).alias("r")).orderBy("i").collect()]
    assert got == [gates.NO_EVENT] * 2 + [gates.NO_NAME] * 2 + [gates.NO_SLUG, gates.ODD_CONFIDENCE, gates.LOW_CONFIDENCE, gates.LOW_CONFIDENCE] + [gates.NO_QUOTE] * 2 + [gates.FOREIGN_QUOTE, "", "", ""]


def media(spark, policy, *rows):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, id string, type string, mime string, source string, seconds double, size long, audio boolean")
    errors = gates.media_errors(*[F.col(c) for c in ("id", "type", "mime", "source", "seconds", "size", "audio")], policy)
    out = frame.withColumn("e", errors).withColumn("r", gates.route(F.col("type"), F.col("audio"), F.col("e"), policy)).orderBy("i").collect()
    return [(r["e"], r["r"] and tuple(r["r"])) for r in out]


def test_media_and_routes(spark):
    strict = gates.Policy(least_seconds=1, most_seconds=10, least_bytes=5, most_bytes=9, audio_required=True)
    got = media(
        spark, strict,
        ("a", "Video ", None, "x/a.MP4", 5.0, 7, True), ("a", "image", None, "a.b/c.png", None, None, False), (None, None, None, None, None, None, None), ("a", "audio", "audio/x", "noext", 0.5, 10, None),
        ("a", "video", "image/png", "x/.hidden", 11.0, 4, False), ("a", "image", "IMAGE/png", "a.mp4", None, None, None),
    )
    assert got[0] == ([], ("video", True, True, True, True, True)) and got[1] == ([], ("image", False, True, True, True, False))
    assert got[2] == (["media_id is required", "media_type is required"], None)
    assert got[3][0] == ["unsupported media_type: audio", "unsupported mime_type: audio/x", "media duration is below the configured minimum", "media size exceeds the configured maximum"]
    assert got[4][0] == ["unsupported mime_type: image/png", "media duration exceeds the configured maximum", "media size is below the configured minimum", "audio track is required by policy"]
    assert got[5][0] == ["unsupported media extension: .mp4"]
    loose = media(spark, gates.Policy(speech=False, ocr=False), ("a", "video", None, "a.mp4", 0.0, 0, None))
    assert loose == [([], ("video", True, False, True, True, False))]


def test_chunks_are_rejected_and_enriched(spark):
    rows = [(0, " a ", "d", " text ", None), (1, "a", "d", "other", None), (2, None, "d", "t", None), (3, "b", " ", "t", None), (4, "c", "d", " \t".replace("\t", " "), None), (5, "e", "d", "t", "then")]
    frame = spark.createDataFrame(rows, "place long, chunk_id string, document_id string, text string, created_at string")
    got = {r["place"]: r for r in gates.checked_chunks(frame, F.lit("now")).collect()}
    assert [got[i]["reason"] for i in range(6)] == ["", "duplicate chunk_id", "missing chunk_id", "missing document_id", "empty text", ""]
    assert got[0]["text"] == "text" and got[0]["created_at"] == "now" and got[5]["created_at"] == "then" and got[1]["content_hash"] is None and len(got[0]["content_hash"]) == 64


def test_registration(spark):
    objects = spark.createDataFrame([("k1", "p"), ("k2", "p"), ("k3", "q"), ("k4", "q"), ("k5", None)], "object_key string, post string")
    known, posts = spark.createDataFrame([("k1",), ("k3",), ("k3",)], "object_key string"), spark.createDataFrame([("p",)], "post string")
    rows = gates.registration(objects, known, posts)
    assert {r["object_key"]: r["outcome"] for r in rows.collect()} == {"k1": "skipped", "k2": "created", "k3": "skipped", "k4": "missing", "k5": "missing"}
    assert tuple(gates.registration_report(rows).first()) == (5, 1, 2, 2, 1, 1)
    assert {r["outcome"] for r in gates.registration(objects, known, posts, allow_missing=True).collect()} == {"skipped", "created"}


def test_frames_need_their_parent(spark):
    frames = spark.createDataFrame([(1, "b", "k", 0.5, 0), (9, "b", "l", 0.5, 1)], "video_media_id long, bucket_name string, object_key string, timestamp double, frame_index int")
    made = gates.registered_frames(frames, spark.createDataFrame([(1, 7)], "media_id long, post_id long"))
    m, f = made["media"].collect(), made["frames"].collect()
    assert [(r["post_id"], r["parent_media_id"], r["media_type"]) for r in m] == [(7, 1, "frame")] and f[0]["media_id"] == m[0]["media_id"]
    assert [r["object_key"] for r in made["rejected"].collect()] == ["l"]


def test_hits_of_older_payloads_and_notes(spark):
    one = spark.range(1)
    hit = one.select(gates.citation(F.lit(None), {"video_id": F.lit("v"), "timestamp_sec": F.lit("1.5")}).alias("h")).first()["h"]
    assert (hit["score"], hit["media_kind"], hit["timestamp_sec"], hit["caption"], hit["unit_id"]) == (0.0, "video_frame", 1.5, "", None)
    assert one.select(gates.media_kind(F.lit(" "), F.lit("")).alias("k")).first()["k"] == "image"
    none = F.array().cast("array<string>")
    notes = lambda total, errors: one.select(gates.result_notes(F.lit(total), {"no text": F.lit(True)}, errors, F.array(F.lit(2024)), none).alias("n")).first()["n"]
    assert notes(0, none) == ["no text", "nothing in years 2024"] and notes(0, F.array(F.lit("clip"))) == ["no text", "failed: clip"] and notes(3, F.lit(None).cast("array<string>")) == ["no text"]
    top = lambda c: one.select(gates.routed_score(F.lit(c), {"a": F.lit(1.0), "b": F.lit(None).cast("double")}, {"a": ["x"], "b": ["y"]}).alias("s")).first()["s"]
    assert (top("x"), top("y"), top("z")) == (1.0, None, 1.0)
