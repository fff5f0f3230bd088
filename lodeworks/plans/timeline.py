"""Queries on a time axis and on ordered sequences: intervals, scenes, merges, states, filters of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import chunks, entities, gates, greedy, intervals
from .registry import Tables, query
from .texts import FOLD


def _seconds(c: str = "ts"):
    return F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000


@query("SELECT event_id, year(ts + INTERVAL 7 HOUR)::INTEGER AS year FROM events WHERE ts >= TIMESTAMP '2023-12-31 17:00:00' AND ts < TIMESTAMP '2024-12-31 17:00:00' AND event_type IN ('click', 'view')")
def f1_f2_local_year(t: Tables) -> DataFrame:
    from ..operators.filters import matching

    rows = matching(t.events, "ts", years=[2024], any_of={"event_type": ["click", "view"]})
    return rows.select("event_id", F.year(F.col("ts") + F.expr("interval 7 hours")).alias("year"))


@query("SELECT doc_id FROM documents WHERE regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g') IN ('src0', 'src3')")
def f4_f5_events(t: Tables) -> DataFrame:
    from ..operators.filters import event_keys

    aliases = t.spark.createDataFrame([("the third", "SRC 3!")], "alias string, name string")
    keys = event_keys(t.spark, ["SRC0", " src0 ", "The  Third", "!!"], aliases)
    docs = t.documents.select("doc_id", text.slug(F.regexp_replace("source", "src", "src")).alias("key"))
    return docs.join(F.broadcast(keys.select(F.regexp_replace("key", "-", "").alias("key")).distinct()), "key", "left_semi").select("doc_id")


_SEG = """seg AS (SELECT user_id, floor(epoch(ts)) AS start_sec, floor(epoch(ts)) + 1800 AS end_sec, event_type AS text, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seg_idx FROM events WHERE event_type IN ('view', 'signup')),
pt AS (SELECT event_id AS point_id, user_id, epoch(ts) AS moment FROM events WHERE event_type = 'purchase')"""


def _segments(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    start = F.floor(_seconds()).cast("double")
    return t.events.where(F.col("event_type").isin("view", "signup")).select("user_id", start.alias("start_sec"), (start + 1800).alias("end_sec"), F.col("event_type").alias("text"), (F.row_number().over(w) - 1).alias("seg_idx"))


def _points(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'purchase'").select(F.col("event_id").alias("point_id"), "user_id", _seconds().alias("at"))


@query(f"""WITH {_SEG}, m AS (SELECT point_id, min(seg_idx) AS seg_idx FROM pt JOIN seg ON seg.user_id = pt.user_id AND moment BETWEEN start_sec AND end_sec GROUP BY point_id)
SELECT pt.point_id, m.seg_idx FROM pt LEFT JOIN m USING (point_id)""")
def j9_point_in_interval(t: Tables) -> DataFrame:
    return intervals.first_interval(_points(t), _segments(t), "user_id", "at").select("point_id", F.col("seg_idx").cast("long").alias("seg_idx"))


@query(f"""WITH {_SEG}, m AS (SELECT point_id, pt.user_id, min(seg_idx) AS i FROM pt JOIN seg ON seg.user_id = pt.user_id AND moment BETWEEN start_sec - 600 AND end_sec + 600 GROUP BY ALL),
c AS (SELECT point_id, string_agg(text, ' ' ORDER BY seg_idx) AS context FROM m JOIN seg ON seg.user_id = m.user_id AND seg_idx BETWEEN i - 1 AND i + 1 GROUP BY point_id) SELECT pt.point_id, coalesce(context, '') AS context FROM pt LEFT JOIN c USING (point_id)""")
def j10_context_window(t: Tables) -> DataFrame:
    segments = _segments(t)
    return intervals.neighbours(intervals.first_interval(_points(t), segments, "user_id", "at", tolerance=600.0), segments, "user_id", "text")


@query("""WITH d AS (SELECT doc_id, text, length(text) AS n, greatest(0, least(floor((doc_id % 10) / 10.0 * length(text))::INTEGER - 200, length(text) - 400)) AS f FROM documents) SELECT doc_id, CASE WHEN n <= 400 THEN text ELSE substring(text, f + 1, 400) END AS crop FROM d""")
def j11_cropped(t: Tables) -> DataFrame:
    at = (F.col("doc_id") % 10).cast("double")
    return t.documents.select("doc_id", intervals.cropped(F.col("text"), F.lit(0.0), F.lit(10.0), at).alias("crop"))


@query("""WITH s AS (SELECT o_orderkey, o_custkey, o_orderdate AS a, o_orderdate + to_days((o_orderkey % 60)::INTEGER) AS b FROM orders) SELECT x.o_custkey, count(*) AS overlaps FROM s x JOIN s y ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey AND x.a < y.b AND y.a < x.b GROUP BY x.o_custkey""")
def j14_overlaps(t: Tables) -> DataFrame:
    start = _seconds("o_orderdate")
    held = t.orders.select("o_custkey", start.alias("start"), (start + F.col("o_orderkey") % 60 * 86_400).alias("end"))
    return intervals.overlapping_pairs(held, "o_custkey", "start", "end").withColumnRenamed("pairs", "overlaps")


@query("""SELECT CASE WHEN event_id % 4 = 0 THEN 'ends before it starts' WHEN event_type = 'error' THEN 'empty' ELSE 'fine' END AS reason, count(*) AS n FROM events GROUP BY 1""")
def f14_segment_reasons(t: Tables) -> DataFrame:
    start = F.col("value")
    end = F.when(F.col("event_id") % 4 == 0, F.col("value") - 1).otherwise(F.col("value") + 1)
    content = F.when(F.col("event_type") == "error", "  ").otherwise(F.col("event_type"))
    return t.events.groupBy(F.coalesce(intervals.segment_reason(start, end, content), F.lit("fine")).alias("reason")).agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, coalesce(p_name, l_partkey::VARCHAR) AS label, round(l_discount * 10 + l_tax / 3, 4) AS confidence, concat_ws(' ', round(l_quantity / 3, 1), round(l_partkey / 7, 1)) AS box FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 20) ON p_partkey = l_partkey WHERE l_discount * 10 + l_tax / 3 >= 0.35""")
def f16_confident(t: Tables) -> DataFrame:
    boxes = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("class_id"), (F.col("l_discount") * 10 + F.col("l_tax") / 3).alias("confidence"), F.array(F.col("l_quantity") / 3, F.col("l_partkey") / 7).alias("box"))
    found = gates.detections(boxes, t.part.where("p_size > 20").select(F.col("p_partkey").alias("class_id"), F.col("p_name").alias("label")), 0.35)
    return found.select("l_orderkey", "l_linenumber", "label", "confidence", F.array_join(F.transform("box", lambda x: x.cast("string")), " ").alias("box"))


_QUALITY = """q AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 100 AS blur, l_quantity * 5 AS bright, l_tax * 500 AS contrast FROM lineitem)"""


def _frames(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 100).alias("blur"), (F.col("l_quantity") * 5).alias("bright"), (F.col("l_tax") * 500).alias("contrast"))


@query(f"""WITH {_QUALITY} SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN blur < 80 THEN 'blur' END, CASE WHEN bright < 30 THEN 'dark' END, CASE WHEN bright > 225 THEN 'bright' END, CASE WHEN contrast < 10 THEN 'flat' END) AS reasons,
round(0.45 * least(1, greatest(0, blur / 400)) + 0.25 * least(1, greatest(0, 1 - abs(bright - 127.5) / 127.5)) + 0.30 * least(1, greatest(0, contrast / 64)), 6) AS quality FROM q""")
def f17_t31_quality(t: Tables) -> DataFrame:
    from ..operators.filters import quality_reasons, quality_score

    c = (F.col("blur"), F.col("bright"), F.col("contrast"))
    return _frames(t).select("l_orderkey", "l_linenumber", F.array_join(quality_reasons(*c), ",").alias("reasons"), F.round(quality_score(*c), 6).alias("quality"))


@query(f"""WITH {_QUALITY}, s AS (SELECT *, blur >= 80 AND bright BETWEEN 30 AND 225 AND contrast >= 10 AS ok, round(blur + bright + contrast, 6) AS score FROM q), r AS (SELECT *, bool_or(ok) OVER (PARTITION BY l_orderkey) AS any_ok, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber) AS k FROM s)
SELECT l_orderkey, l_linenumber, NOT ok AS fallback FROM r WHERE ok OR (NOT any_ok AND k = 1)""")
def f18_fallback(t: Tables) -> DataFrame:
    from ..operators.filters import quality_reasons, survivors_or_best

    rows = _frames(t)
    ok = F.size(quality_reasons(F.col("blur"), F.col("bright"), F.col("contrast"))) == 0
    scored = rows.withColumn("ok", ok).withColumn("score", F.round(F.col("blur") + F.col("bright") + F.col("contrast"), 6))
    return survivors_or_best(scored, "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "fallback")


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS status, CASE WHEN event_type IN ('view', 'error') THEN NULL ELSE value END AS content FROM events")
def f19_persist_guard(t: Tables) -> DataFrame:
    e = F.col("event_type")
    return t.events.select("event_id", F.when(e != "view", e).alias("status"), F.when(~e.isin("view", "error"), F.col("value")).alias("content"))


#: Parts as media, some of which break each rule.
_MEDIA = """m AS (SELECT p_partkey, CASE WHEN p_partkey % 17 = 0 THEN ' ' ELSE 'm' || p_partkey END AS media_id, CASE p_partkey % 7 WHEN 0 THEN ' Image' WHEN 1 THEN '' WHEN 2 THEN 'Audio' ELSE 'video' END AS media_type, CASE p_partkey % 5 WHEN 0 THEN 'image/png' WHEN 1 THEN NULL ELSE 'Video/mp4' END AS mime,
 CASE p_partkey % 6 WHEN 0 THEN 'a/b' || p_partkey || '.MP4' WHEN 1 THEN 'a.b/c' WHEN 2 THEN 'x/y.png/' WHEN 3 THEN NULL WHEN 4 THEN 'z.tar.gz' ELSE '.hidden' END AS source, CASE WHEN p_partkey % 9 > 0 THEN p_size * 30.0 END AS seconds, CASE WHEN p_partkey % 8 > 0 THEN (p_retailprice * 1000)::BIGINT END AS bytes, CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 4 > 1 END AS audio FROM part)"""
_ERRORS = """e AS (SELECT *, lower(trim(media_type)) AS kind, lower(trim(coalesce(mime, ''))) AS mt, lower(regexp_extract(coalesce(source, ''), '[^/](\\.[^./]+)/*$', 1)) AS ext FROM m), f AS (SELECT *, concat_ws('; ', CASE WHEN trim(media_id) = '' THEN 'media_id is required' END, CASE WHEN kind = '' THEN 'media_type is required' END, CASE WHEN kind NOT IN ('', 'video', 'image') THEN 'unsupported media_type: ' || media_type END,
 CASE WHEN ext <> '' AND NOT (CASE WHEN kind = 'image' THEN ext IN ('.jpg', '.jpeg', '.png', '.webp') ELSE ext IN ('.mp4', '.mov', '.mkv', '.webm', '.avi') END) THEN 'unsupported media extension: ' || ext END, CASE WHEN ext = '' AND mt <> '' AND NOT starts_with(mt, CASE WHEN kind = 'image' THEN 'image/' ELSE 'video/' END) THEN 'unsupported mime_type: ' || mime END,
 CASE WHEN seconds < 60 THEN 'media duration is below the configured minimum' END, CASE WHEN seconds > 1200 THEN 'media duration exceeds the configured maximum' END, CASE WHEN bytes < 950000 THEN 'media size is below the configured minimum' END, CASE WHEN bytes > 1500000 THEN 'media size exceeds the configured maximum' END, CASE WHEN kind <> 'image' AND audio IS false THEN 'audio track is required by policy' END) AS errors FROM e)"""


def _media(t: Tables) -> DataFrame:
    policy = gates.Policy(least_seconds=60, most_seconds=1200, least_bytes=950_000, most_bytes=1_500_000, audio_required=True)
    k = F.col("p_partkey")
    m = t.part.select(
        "p_partkey",
        F.when(k % 17 == 0, " ").otherwise(F.concat(F.lit("m"), k.cast("string"))).alias("media_id"),
        F.when(k % 7 == 0, " Image").when(k % 7 == 1, "").when(k % 7 == 2, "Audio").otherwise("video").alias("media_type"),
        F.when(k % 5 == 0, "image/png").when(k % 5 > 1, "Video/mp4").alias("mime"),
        F.when(k % 6 == 0, F.concat(F.lit("a/b"), k.cast("string"), F.lit(".MP4"))).when(k % 6 == 1, "a.b/c").when(k % 6 == 2, "x/y.png/").when(k % 6 == 4, "z.tar.gz").when(k % 6 == 5, ".hidden").alias("source"),
        F.when(k % 9 > 0, F.col("p_size") * 30.0).alias("seconds"),
        F.when(k % 8 > 0, F.round(F.col("p_retailprice") * 1000).cast("long")).alias("bytes"),
        F.when(k % 4 > 0, k % 4 > 1).alias("audio"),
    )
    errors = gates.media_errors(*[F.col(c) for c in ("media_id", "media_type", "mime", "source", "seconds", "bytes", "audio")], policy)
    return m.withColumn("errors", errors).withColumn("route", gates.route(F.col("media_type"), F.col("audio"), F.col("errors"), policy))


@query(f"WITH {_MEDIA}, {_ERRORS} SELECT p_partkey, errors FROM f")
def f21_validation(t: Tables) -> DataFrame:
    return _media(t).select("p_partkey", F.array_join("errors", "; ").alias("errors"))


@query(f"WITH {_MEDIA}, {_ERRORS} SELECT p_partkey, CASE WHEN errors = '' THEN CASE WHEN kind = 'image' THEN 'image' ELSE 'video' END END AS type, CASE WHEN errors = '' THEN kind <> 'image' END AS keyframes, CASE WHEN errors = '' THEN kind <> 'image' AND audio IS DISTINCT FROM false END AS speech FROM f")
def f22_route(t: Tables) -> DataFrame:
    return _media(t).select("p_partkey", "route.type", "route.keyframes", "route.speech")


@query("""WITH a AS (SELECT event_id, list_filter(list_distinct([year(ts)::BIGINT, user_id + 1995, try_cast('x' AS BIGINT), 2024]), lambda y: y BETWEEN 2000 AND 2100) AS y FROM events) SELECT event_id, array_to_string(list_sort(y), ',') AS years FROM a""")
def f3_f25_years(t: Tables) -> DataFrame:
    from ..operators.filters import valid_years

    given = F.array(F.year("ts").cast("string"), (F.col("user_id") + 1995).cast("string"), F.lit("x"), F.lit("2024"))
    return t.events.select("event_id", F.array_join(F.array_sort(valid_years(given, 2000, 2100)), ",").alias("years"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'not a tool' WHEN event_id % 5 = 1 THEN 'error' ELSE 'ok' END AS kind, CASE WHEN event_id % 5 > 1 THEN json_extract_string(props, '$.k') END AS k FROM events""")
def f26_tool_results(t: Tables) -> DataFrame:
    from ..operators.filters import tool_result

    k = F.col("event_id") % 5
    role = F.when(k == 0, "user").otherwise("tool")
    body = F.when(k == 1, F.element_at(F.array(F.lit(""), F.lit("{bad"), F.lit('{"success": false}'), F.lit('{"status": "error"}')), (F.floor(F.col("event_id") / 5) % 4 + 1).cast("int"))).otherwise(F.col("props"))
    return t.events.select("event_id", tool_result(role, body).alias("kind"), F.when(k > 1, F.get_json_object(body, "$.k")).alias("k"))


@query("""SELECT page_id, CASE WHEN page_id % 4 > 0 THEN n_chars / 1000.0 ELSE 0 END AS score, nullif(CASE WHEN page_id % 3 = 0 THEN '' WHEN page_id % 3 = 1 THEN 'v' || page_id END, '') AS video_id, CASE WHEN page_id % 5 > 0 THEN page_id * 0.5 END AS timestamp_sec, coalesce(d.source, '') AS caption, '' AS ocr_text,
CASE WHEN page_id % 7 = 0 THEN 'custom' WHEN page_id % 3 = 1 THEN 'video_frame' ELSE 'image' END AS media_kind FROM pages p LEFT JOIN documents d ON d.doc_id = p.page_id""")
def f27_citation_fields(t: Tables) -> DataFrame:
    """Pages as hits whose payloads lack one key or another."""
    rows = t.pages.select(F.col("page_id"), F.col("page_id").alias("doc_id")).join(t.documents, "doc_id", "left")
    k = F.col("page_id")
    payload = {
        "video_id": F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(F.lit("v"), k.cast("string"))),
        "timestamp_sec": F.when(k % 5 > 0, (k * 0.5).cast("string")).otherwise("later"),
        "caption": F.col("source"),
        "media_kind": F.when(k % 7 == 0, " custom ").when(k % 7 == 1, " "),
    }
    hit = gates.citation(F.when(k % 4 > 0, F.coalesce("n_chars", F.lit(0)) / 1000), payload)
    return rows.select("page_id", hit.alias("h")).select("page_id", "h.score", "h.video_id", "h.timestamp_sec", "h.caption", "h.ocr_text", "h.media_kind")


@query("""WITH b AS (SELECT user_id, max(value) FILTER (WHERE event_type = 'click') AS c, max(value) FILTER (WHERE event_type = 'view' AND value < 150) AS v, count_if(event_type = 'purchase' AND value > 100) AS n, list_sort(list_distinct(list(event_type) FILTER (WHERE event_type = 'error'))) AS e FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN user_id % 4 = 0 THEN c WHEN user_id % 4 = 1 THEN v ELSE greatest(c, v) END AS top, concat_ws('; ', CASE WHEN c IS NULL THEN 'no clicks' END, CASE WHEN n = 0 AND coalesce(len(e), 0) = 0 THEN 'nothing in years 2024, 2025' END, CASE WHEN n = 0 AND coalesce(len(e), 0) = 0 AND user_id % 2 = 0 THEN 'nothing in events x' END, CASE WHEN len(e) > 0 THEN 'failed: error' END) AS notes FROM b""")
def f30_f31_dispatch(t: Tables) -> DataFrame:
    """Users as questions of four classes to two branches, and what is said of their results."""
    e, v = F.col("event_type"), F.col("value")
    b = t.events.groupBy("user_id").agg(F.max(F.when(e == "click", v)).alias("c"), F.max(F.when((e == "view") & (v < 150), v)).alias("v"), F.count_if((e == "purchase") & (v > 100)).alias("n"), F.collect_set(F.when(e == "error", e)).alias("e"))
    kind = F.concat(F.lit("class"), (F.col("user_id") % 4).cast("string"))
    top = gates.routed_score(kind, {"clicks": F.col("c"), "views": F.col("v")}, {"clicks": ["class0"], "views": ["class1"]})
    events = F.when(F.col("user_id") % 2 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    notes = gates.result_notes(F.col("n"), {"no clicks": F.col("c").isNull()}, F.col("e"), F.array(F.lit(2024), F.lit(2025)), events)
    return b.select("user_id", top.alias("top"), F.array_join(notes, "; ").alias("notes"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 6 THEN 'invalid_frame_index' WHEN l_quantity < 3 THEN 'invalid_timestamp' WHEN l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5) THEN 'missing_frame_image' ELSE '' END AS reason FROM lineitem""")
def f32_admission(t: Tables) -> DataFrame:
    held = t.part.where("p_size > 5").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("held"))
    rows = t.lineitem.join(held, "l_partkey", "left")
    return rows.select("l_orderkey", "l_linenumber", entities.first_reason(("invalid_frame_index", F.col("l_linenumber") > 6), ("invalid_timestamp", F.col("l_quantity") < 3), ("missing_frame_image", F.col("held").isNull())).alias("reason"))


@query("""WITH s AS (SELECT p_partkey, p_partkey * 10 AS a, p_partkey * 10 + p_size * 7 AS b FROM part), p AS (SELECT p_partkey, a, b, CASE WHEN b - a < 10 THEN [round_even((a + b) / 2.0, 0)::BIGINT] ELSE
 list_sort(list_distinct(list_concat([round_even(a + 0.15 * (b - a), 0)::BIGINT, round_even(a + 0.5 * (b - a), 0)::BIGINT, round_even(a + 0.85 * (b - a), 0)::BIGINT], CASE WHEN (b - a) / 25.0 > 2.5 THEN list_concat(generate_series(a, b, 62), [b]) ELSE [] END))) END AS places FROM s)
SELECT p_partkey, array_to_string(CASE WHEN len(places) <= 8 THEN places ELSE list_transform(range(8), lambda i: places[round_even(i * (len(places) - 1) / 7.0, 0)::INTEGER + 1]) END, ',') AS places FROM p""")
def w12_w13_places(t: Tables) -> DataFrame:
    a = F.col("p_partkey") * 10
    places = greedy.frame_places(a, a + F.col("p_size") * 7, F.lit(25.0))
    return t.part.select("p_partkey", F.transform(greedy.limited(places), lambda x: x.cast("string")).alias("p")).select("p_partkey", F.array_join("p", ",").alias("places"))


@query("""WITH RECURSIVE f AS (SELECT label % 2 AS media, vec_id AS frame_id, vec_id * 0.7 AS moment, list_transform(embedding[1:3], lambda x: x::DOUBLE) AS v, row_number() OVER (PARTITION BY label % 2 ORDER BY vec_id) AS i FROM embeddings),
r AS (SELECT media, 0::BIGINT AS i, NULL::BIGINT AS frame_id, NULL::BOOLEAN AS kept, NULL::DOUBLE AS similarity, []::STRUCT(t DOUBLE, v DOUBLE[])[] AS held FROM f GROUP BY media
UNION ALL SELECT media, i, frame_id, s < 0.9, round(s, 6), CASE WHEN s < 0.9 THEN list_append(near, {'t': moment, 'v': v}) ELSE near END FROM (
 SELECT *, greatest(0, coalesce(list_max(list_transform(near, lambda k: list_cosine_similarity(k.v, v))), 0)) AS s FROM (
  SELECT f.media, f.i, f.frame_id, f.moment::DOUBLE AS moment, f.v, list_filter(r.held, lambda k: f.moment - k.t <= 10) AS near FROM r JOIN f ON f.media = r.media AND f.i = r.i + 1)))
SELECT media, frame_id, kept, similarity FROM r WHERE i > 0""")
def w14_without_repeats(t: Tables) -> DataFrame:
    """Vectors of three components, so that many are alike; pieces of a minute, so that decisions are handed on."""
    frames = t.embeddings.select((F.col("label") % 2).alias("media"), F.col("vec_id").alias("frame_id"), (F.col("vec_id") * 0.7).alias("at"), F.slice("embedding", 1, 3).alias("vector"))
    return greedy.without_repeats(frames, "media", piece_seconds=60.0)


_FRAME_SCORES = "f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value FROM events)"


def _scores(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("user_id", (F.row_number().over(w) - 1).alias("pos"), "value")


@query(f"""WITH {_FRAME_SCORES}, t AS (SELECT user_id, greatest(0, max(pos) - 9) AS tail, arg_max(value, pos) AS last FROM f GROUP BY user_id),
e AS (SELECT f.user_id, value, last, unnest(list_distinct(list_concat(list_transform(generate_series(greatest(0, ceil((pos - 9) / 5.0)::BIGINT), pos // 5), lambda x: x * 5), CASE WHEN pos >= tail THEN [tail] ELSE [] END))) AS first FROM f JOIN t USING (user_id))
SELECT user_id, first, round((sum(value) + (10 - count(*)) * any_value(last)) / 10, 6) AS mean, count(*) AS frames FROM e GROUP BY user_id, first""")
def w15_window_means(t: Tables) -> DataFrame:
    return intervals.window_means(_scores(t), "user_id", "pos", "value", 10, 5)


@query(f"""WITH {_FRAME_SCORES}, c AS (SELECT *, coalesce(lag(CASE WHEN value > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos), 0) AS cut FROM f), s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY pos)::BIGINT AS scene FROM c)
SELECT user_id, scene, min(pos)::INTEGER AS first, max(pos)::INTEGER AS last, count(*) AS frames FROM s GROUP BY user_id, scene""")
def w16_scenes(t: Tables) -> DataFrame:
    return intervals.islands(_scores(t), "user_id", "pos", "value", 100.0)


@query("""WITH RECURSIVE s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS i, turn, text, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS n FROM conversations),
w AS (SELECT conv_id, i, i AS first, n FROM s WHERE i = 1 UNION ALL SELECT s.conv_id, s.i, CASE WHEN w.n < 30 THEN w.first ELSE s.i END, CASE WHEN w.n < 30 THEN w.n + s.n ELSE s.n END FROM w JOIN s ON s.conv_id = w.conv_id AND s.i = w.i + 1)
SELECT w.conv_id, string_agg(s.turn::VARCHAR, ',' ORDER BY w.i) AS turns, count(*)::INTEGER AS parts FROM w JOIN s ON s.conv_id = w.conv_id AND s.i = w.i GROUP BY w.conv_id, w.first""")
def w17_merged_segments(t: Tables) -> DataFrame:
    turns = t.conversations.select("conv_id", "turn", F.col("turn").alias("start"), F.col("turn").alias("end"), "text")
    return greedy.merged_segments(turns, "conv_id", "turn").select("conv_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("turns"), F.size("ids").alias("parts"))


@query("""WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events WHERE value < 100) SELECT event_type, event_id FROM r WHERE k = 1""")
def w18_oldest_pending(t: Tables) -> DataFrame:
    first = F.min(F.struct("ts", "event_id"))
    return t.events.where("value < 100").groupBy("event_type").agg(first.alias("f")).select("event_type", "f.event_id")


@query("SELECT user_id, count(*) AS failures, CASE WHEN count(*) <= 30 THEN 'PENDING' ELSE 'FAILED' END AS state FROM events WHERE event_type = 'error' GROUP BY user_id")
def w19_retry_state(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("failures"), F.when(F.count("*") <= 30, "PENDING").otherwise("FAILED").alias("state"))


@query("""WITH g AS (SELECT conv_id, role, min(turn) AS first, list_sort(list_distinct(list(turn))) AS chips, count(*) AS hits FROM conversations GROUP BY ALL) SELECT conv_id, role, first, hits, array_to_string(chips, ',') AS chips, row_number() OVER (PARTITION BY conv_id ORDER BY first, role)::INTEGER AS place FROM g""")
def w20_w21_cards(t: Tables) -> DataFrame:
    g = t.conversations.groupBy("conv_id", "role").agg(F.min("turn").alias("first"), F.count("*").alias("hits"), F.sort_array(F.collect_set("turn")).alias("c"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("first", "role"))
    return g.select("conv_id", "role", "first", "hits", F.array_join(F.transform("c", lambda x: x.cast("string")), ",").alias("chips"), place.alias("place"))


@query("""WITH u AS (SELECT user_id, 0 AS source, event_id, value FROM events WHERE event_type = 'view' UNION ALL SELECT user_id, 1, event_id, value FROM events WHERE event_type = 'click')
SELECT user_id, source, event_id, row_number() OVER (PARTITION BY user_id ORDER BY source, value DESC, event_id)::INTEGER AS place, source = 0 AND max(CASE WHEN source = 0 THEN value END) OVER (PARTITION BY user_id) < 150 AS weak FROM u""")
def w22_two_sources(t: Tables) -> DataFrame:
    """Merged by source, sorted only within one: scores of two sources are never compared."""
    e = t.events.where(F.col("event_type").isin("view", "click"))
    u = e.select("user_id", F.when(F.col("event_type") == "view", 0).otherwise(1).alias("source"), "event_id", "value")
    per = Window.partitionBy("user_id")
    weak = (F.col("source") == 0) & (F.max(F.when(F.col("source") == 0, F.col("value"))).over(per) < 150)
    return u.select("user_id", "source", "event_id", F.row_number().over(per.orderBy("source", F.desc("value"), "event_id")).alias("place"), weak.alias("weak"))


@query("""SELECT user_id, event_id, round(CASE WHEN min(value) OVER (PARTITION BY user_id) < 0 OR max(value) OVER (PARTITION BY user_id) > 1 THEN 1 / (1 + exp(-value / 100)) ELSE value END, 6) AS score FROM events""")
def t32_sigmoid(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id")
    outside = (F.min("value").over(w) < 0) | (F.max("value").over(w) > 1)
    return t.events.select("user_id", "event_id", F.round(F.when(outside, 1 / (1 + F.exp(-F.col("value") / 100))).otherwise(F.col("value")), 6).alias("score"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS arrived, (event_id % 7 + 1) * 100 AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::BIGINT AS arrived, 0::BIGINT AS out, []::STRUCT(t BIGINT, n BIGINT)[] AS w FROM e GROUP BY user_id
UNION ALL SELECT user_id, i, event_id, arrived, out, list_append(list_filter(w, lambda x: x.t > out - 21600000000), {'t': out, 'n': n}) FROM (
 SELECT *, CASE WHEN k = 0 THEN now ELSE greatest(now, w[k].t + 21600000000) END AS out FROM (
  SELECT *, coalesce(list_min(list_filter(range(0, len(w) + 1), lambda j: coalesce(list_sum(list_transform(w[j + 1:], lambda x: x.n)), 0) + n <= 1000)), len(w)) AS k FROM (
   SELECT e.user_id, e.i, e.event_id, e.arrived, e.n, greatest(e.arrived, s.out) AS now, list_filter(s.w, lambda x: x.t > greatest(e.arrived, s.out) - 21600000000) AS w FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1))))
SELECT event_id, out - arrived AS waited FROM s WHERE i > 0""")
def r9_token_budget(t: Tables) -> DataFrame:
    """A budget of 1000 tokens in six hours for each user: how long each request waits, and with it those behind it."""
    from ..streaming.budget import budgeted_events

    sent = budgeted_events(t.spark, t.sf_dir, 1000, 6 * 3600)
    return sent.select(F.col("id").alias("event_id"), (F.col("released") - F.col("at")).alias("waited"))


def _laid_out(t: Tables) -> DataFrame:
    """Documents with the layout of regulations: paragraphs apart, titles and numbered items, articles with clauses, and a word for each line."""
    apart = lambda mark: F.replace("text", F.lit(". "), F.lit(mark))
    k = F.col("doc_id") % 4
    ruled = F.concat(F.lit("Nội quy "), F.coalesce("source", F.lit("")), F.lit("\n\n\n"), F.replace(apart(".\n2) "), F.lit(", "), F.lit(" - The")))
    articles = F.concat(F.lit("ĐIỀU LỆ CHUNG\nĐiều 1. Tên\n\n\n"), apart(".\n\n\n3. "), F.lit("\n\n\nChương 2 Khác\n\n\n1. Mục\n\n\n"), F.replace("text", F.lit(" "), F.lit("\r\n\n")))
    return t.documents.select("doc_id", F.when(k == 1, apart(".\n\n\n")).when(k == 2, ruled).when(k == 3, articles).otherwise(F.col("text")).alias("text"))


def _cut_sql(at: str, s: str) -> str:
    """A text as a list, cut where a pattern of two groups stands, between them."""
    return f"list_filter(list_transform(string_split(regexp_replace({s}, '{at}', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '')"


_CAPITALS = "(length(regexp_replace({0}, '[^A-Za-zÀ-ỹĐđ]', '', 'g')) >= 5 AND regexp_replace({0}, '[^A-Za-zÀ-ỹĐđ]', '', 'g') = upper(regexp_replace({0}, '[^A-Za-zÀ-ỹĐđ]', '', 'g')) AND regexp_replace({0}, '[^A-Za-zÀ-ỹĐđ]', '', 'g') <> lower(regexp_replace({0}, '[^A-Za-zÀ-ỹĐđ]', '', 'g')))"
_HEADS = "(length({0}) <= 120 AND (regexp_matches({0}, '{1}') OR regexp_matches({2}, '{1}')))"
_HEADING_SQL = r"(?i)^(Chuong|Muc|Dieu|Khoan|Chương|Mục|Điều|Khoản|Nội quy|Quy định|[0-9]+(\.[0-9]+)*[\).]?|Doi voi|Đối với|Hinh thuc xu phat|Hình thức xử phạt)([^\p{L}\p{N}_]|$)"
_REPAIRED = f"""laid AS (SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN replace(text, '. ', '.' || repeat(chr(10), 3)) WHEN 2 THEN 'Nội quy ' || coalesce(source, '') || repeat(chr(10), 3) || replace(replace(text, '. ', '.' || chr(10) || '2) '), ', ', ' - The')
  WHEN 3 THEN 'ĐIỀU LỆ CHUNG' || chr(10) || 'Điều 1. Tên' || repeat(chr(10), 3) || replace(text, '. ', '.' || repeat(chr(10), 3) || '3. ') || repeat(chr(10), 3) || 'Chương 2 Khác' || repeat(chr(10), 3) || '1. Mục' || repeat(chr(10), 3) || replace(text, ' ', chr(13) || chr(10) || chr(10)) ELSE text END AS text FROM documents),
lined AS (SELECT doc_id, list_transform(string_split(replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(9), ' '), chr(10)), lambda x: trim(regexp_replace(x, ' {{2,}}', ' ', 'g'))) AS l FROM laid),
put AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i, l FROM lined), blocks AS (SELECT doc_id, trim(string_agg(CASE WHEN line = '' THEN '' WHEN (i > 2 AND l[i - 1] = '' AND l[i - 2] = '') OR {_CAPITALS.format("line")} OR regexp_matches(line, '^([-+•]|[0-9]{{1,3}}[.)])\\s+') THEN chr(10) || chr(10) || line ELSE ' ' || line END, '' ORDER BY i), ' ' || chr(10)) AS t FROM put GROUP BY doc_id),
fixed AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\\s+-\\s+([A-ZÀ-ỴĐ])', chr(10) || chr(10) || '- \\1', 'g'), '\\s+\\+\\s+(Lần|Làm|Tự|[A-ZÀ-ỴĐ])', chr(10) || chr(10) || '+ \\1', 'g') AS t FROM blocks)"""


@query(f"WITH {_REPAIRED} SELECT doc_id, sha256(t) AS repaired, length(t) AS n FROM fixed")
def t23_repaired(t: Tables) -> DataFrame:
    fixed = _laid_out(t).select("doc_id", chunks.repaired(F.col("text")).alias("t"))
    return fixed.select("doc_id", F.sha2("t", 256).alias("repaired"), F.length("t").alias("n"))


_GREEDY = """{g} AS (SELECT doc_id, i, s, p, 1 AS j, length(w[1]) AS n, 0 AS grp, w, budget FROM {of} WHERE len(w) > 0 UNION ALL SELECT doc_id, i, s, p, j + 1, CASE WHEN n + 1 + length(w[j + 1]) > budget THEN length(w[j + 1]) ELSE n + 1 + length(w[j + 1]) END, CASE WHEN n + 1 + length(w[j + 1]) > budget THEN grp + 1 ELSE grp END, w, budget FROM {g} WHERE j < len(w)),
{g}_ AS (SELECT doc_id, i, s, p, grp, any_value(budget) AS budget, string_agg(w[j], ' ' ORDER BY j) AS x FROM {g} GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {_REPAIRED}, paragraphs AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(t, '\n{{2,}}'), lambda p: trim(p, ' ' || chr(10))), lambda p: p <> '') AS l FROM fixed), each AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM paragraphs),
looked AS (SELECT *, {_HEADS.format("x", _HEADING_SQL, FOLD("x"))} AS cand, regexp_matches(x, '^\\(?[0-9]{{1,3}}[.)]\\s+') AS clause, regexp_matches(x, '^[0-9]{{1,3}}[.)]\\s+') AS numbered, regexp_matches(x, '(?i)^(Nội quy|Quy định)([^\\p{{L}}\\p{{N}}_]|$)') AS title, regexp_matches(x, '(?i)^(Điều|Khoản)([^\\p{{L}}\\p{{N}}_]|$)') AS article,
  length(x) <= 180 AND ({_CAPITALS.format("x")} OR regexp_matches(x, '(?i)^(Chương|Mục|Điều|Khoản)\\s+[0-9]+|^[0-9]{{1,3}}[.)]\\s+')) AS alone FROM each),
headed AS (SELECT *, cand AND NOT (clause AND coalesce(last_value(CASE WHEN cand AND NOT clause THEN article END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)) AS heads FROM looked),
titled AS (SELECT *, last_value(CASE WHEN heads AND title THEN x END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS under FROM headed),
sections AS (SELECT *, last_value(CASE WHEN heads AND NOT title AND numbered AND under IS NOT NULL THEN under || ' — ' || x WHEN heads THEN x END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM titled),
kept AS (SELECT doc_id, i, x, section, greatest(1, 1200 - CASE WHEN section IS NULL OR starts_with(x, section) THEN 0 ELSE length(section) + 2 END) AS budget FROM sections WHERE NOT (heads AND alone)),
sentences AS (SELECT doc_id, i, section, budget, unnest(l) AS x, generate_subscripts(l, 1) AS s FROM (SELECT *, CASE WHEN length(x) <= budget THEN [x] ELSE {_cut_sql('([.!?…])(' + chr(92) + 's+[A-ZÀ-ỴĐ0-9"“‘(' + chr(92) + '[' + chr(39) * 2 + '])', 'x')} END AS l FROM kept)),
clauses AS (SELECT doc_id, i, s, 0 AS p, {_cut_sql('([,;:])(' + chr(92) + 's+)', 'x')} AS w, budget FROM sentences WHERE length(x) > budget), {_GREEDY.format(g="g1", of="clauses")},
words AS (SELECT doc_id, i, s, grp AS p, list_filter(regexp_split_to_array(x, '\\s+'), lambda v: v <> '') AS w, budget FROM g1_ WHERE length(x) > budget), {_GREEDY.format(g="g2", of="words")},
parts AS (SELECT doc_id, i, s, 0 AS p, 0 AS q, x FROM sentences WHERE length(x) <= budget UNION ALL SELECT doc_id, i, s, grp, 0, x FROM g1_ WHERE length(x) <= budget UNION ALL SELECT doc_id, i, s, p, grp, x FROM g2_),
ordered AS (SELECT parts.doc_id, parts.i, s, p, q, parts.x, section, CASE WHEN section IS NULL OR starts_with(parts.x, section) THEN 0 ELSE length(section) + 2 END AS head FROM parts JOIN kept ON kept.doc_id = parts.doc_id AND kept.i = parts.i),
ended AS (SELECT *, sum(length(x) + 2) OVER (PARTITION BY doc_id ORDER BY i, s, p, q)::BIGINT AS e FROM ordered),
a AS MATERIALIZED (SELECT doc_id, list(x ORDER BY i, s, p, q) AS x, list(section ORDER BY i, s, p, q) AS sec, list(length(x) ORDER BY i, s, p, q) AS n, list(head ORDER BY i, s, p, q) AS h, list(e ORDER BY i, s, p, q) AS e FROM ended GROUP BY doc_id),
r AS (SELECT doc_id, 1::BIGINT AS i, 1::BIGINT AS first, NULL::BIGINT AS f, NULL::BIGINT AS l FROM a UNION ALL
 SELECT doc_id, i, CASE WHEN NOT ends THEN first WHEN other OR NOT (h[k] + e[i - 1] - e[k] + n[k] < 1200 AND h[k] + e[i] - e[k] + n[k] <= 1200) THEN i ELSE k END, CASE WHEN ends THEN first END, CASE WHEN ends THEN i - 1 END FROM (
  SELECT *, other OR h[first] + e[i] - e[first] + n[first] > 1200 AS ends, coalesce(list_min(list_filter(range(first, i), lambda y: e[i - 1] - e[y] + n[y] <= 150)), i - 1) AS k FROM (
   SELECT a.*, r.i + 1 AS i, r.first, a.sec[r.i + 1] IS DISTINCT FROM a.sec[r.i] AS other FROM r JOIN a ON a.doc_id = r.doc_id WHERE r.i < len(a.n)))),
cut AS (SELECT doc_id, f, l FROM r WHERE f IS NOT NULL UNION ALL SELECT r.doc_id, r.first, r.i FROM r JOIN a ON a.doc_id = r.doc_id AND r.i = len(a.n)),
c AS (SELECT cut.doc_id, f, l, row_number() OVER (PARTITION BY cut.doc_id ORDER BY l, f) AS k, sec[f] AS section, h[f] AS head, e[l] - e[f] + n[f] AS body, coalesce(h[f] = 0 AND x[f] = sec[f] AND l > f, false) AS led, n[f] AS own FROM cut JOIN a ON a.doc_id = cut.doc_id),
m AS (SELECT doc_id, k, 0::BIGINT AS grp, section, head + body AS n, f, l FROM c WHERE k = 1 UNION ALL SELECT doc_id, k, CASE WHEN joins THEN grp ELSE grp + 1 END, section, CASE WHEN joins THEN before + 2 + rest ELSE head + body END, CASE WHEN joins AND led THEN f + 1 ELSE f END, l FROM (
 SELECT *, head + body < 250 AND was IS NOT DISTINCT FROM section AND before + 2 + rest <= 1200 AS joins FROM (SELECT c.*, m.grp, m.n AS before, m.section AS was, CASE WHEN c.led THEN c.body - c.own - 2 ELSE c.body END AS rest FROM m JOIN c ON c.doc_id = m.doc_id AND c.k = m.k + 1)))
SELECT m.doc_id, grp::INTEGER AS chunk_index, any_value(m.section) AS section, CASE WHEN h[min(f)] > 0 THEN any_value(m.section) || chr(10) || chr(10) ELSE '' END || string_agg(array_to_string(x[f:l], chr(10) || chr(10)), chr(10) || chr(10) ORDER BY k) AS chunk FROM m JOIN a ON a.doc_id = m.doc_id GROUP BY m.doc_id, grp, x, h""")
def t23_t25_chunks(t: Tables) -> DataFrame:
    return chunks.chunked(_laid_out(t), "doc_id", "text")


@query("""WITH RECURSIVE d AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> '')), lambda w: len(w) > 0) AS l FROM documents),
r AS (SELECT doc_id, 0::BIGINT AS i, 0::BIGINT AS line, 0::BIGINT AS word, 0::BIGINT AS n, NULL::BIGINT AS out_line, NULL::BIGINT AS out_word, 0::BIGINT AS cuts, l FROM d UNION ALL
 SELECT doc_id, i, CASE WHEN fresh THEN i ELSE line END, CASE WHEN fresh THEN c * 180 ELSE word END, CASE WHEN fresh THEN m - c * 180 ELSE n + m END, CASE WHEN n > 0 AND fresh THEN line END, CASE WHEN n > 0 AND fresh THEN word END, CASE WHEN fresh THEN c ELSE 0 END, l FROM (
  SELECT *, n = 0 OR n + m > 200 AS fresh, greatest(0, ceil((m - 200) / 180.0))::BIGINT AS c FROM (SELECT doc_id, i + 1 AS i, line, word, n, len(l[i + 1]) AS m, l FROM r WHERE i < len(l)))),
w AS (SELECT doc_id, i, 0 AS k, out_line AS line, out_word AS word, i - 1 AS last, l FROM r WHERE out_line IS NOT NULL UNION ALL SELECT doc_id, i, 1 + unnest(range(cuts)), i, unnest(range(cuts)) * 180, -1, l FROM r WHERE cuts > 0 UNION ALL SELECT doc_id, i + 1, 0, line, word, i, l FROM r WHERE i = len(l) AND n > 0)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1)::INTEGER AS window_index, CASE WHEN last < 0 THEN array_to_string(l[line][word + 1:word + 200], ' ') ELSE array_to_string(list_concat([array_to_string(l[line][word + 1:], ' ')], list_transform(l[line + 1:last], lambda x: array_to_string(x, ' '))), chr(10)) END AS window FROM w""")
def t27_t28_token_windows(t: Tables) -> DataFrame:
    return chunks.windowed(t.documents, "doc_id", "text")


#: Texts of which every third is cut to a few words, so that they are glued; others are repeated until they are too long.
_SPOKEN = "SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN left(text, 40) ELSE repeat(text || ' ', (turn % 6 + 1)::INTEGER) END AS text FROM conversations"


@query(f"""WITH RECURSIVE p AS ({_SPOKEN}), s AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS i, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS n FROM p),
g AS (SELECT conv_id, i, i AS first, n FROM s WHERE i = 1 UNION ALL SELECT s.conv_id, s.i, CASE WHEN g.n < 30 THEN g.first ELSE s.i END, CASE WHEN g.n < 30 THEN g.n + s.n ELSE s.n END FROM g JOIN s ON s.conv_id = g.conv_id AND s.i = g.i + 1),
m AS (SELECT g.conv_id, min(s.turn) * 12.5 AS a, max(s.turn) * 12.5 + 10 AS b, list_filter(regexp_split_to_array(string_agg(s.text, ' ' ORDER BY s.i), '\\s+'), lambda w: w <> '') AS w FROM g JOIN s ON s.conv_id = g.conv_id AND s.i = g.i GROUP BY g.conv_id, g.first),
i AS (SELECT *, unnest(CASE WHEN len(w) > 300 THEN generate_series(0, len(w) - 41, 160) WHEN len(w) > 0 THEN [0] ELSE [] END) AS k FROM m),
u AS (SELECT conv_id, printf('%d:%.3f-%.3f', conv_id, a::DOUBLE, b::DOUBLE) AS place, len(w) > 300 AS cut, (k // 160)::INTEGER AS chunk_index, array_to_string(CASE WHEN len(w) > 300 THEN w[k + 1:k + 200] ELSE w END, ' ') AS text FROM i)
SELECT conv_id, 'transcript:' || place || CASE WHEN cut THEN '#' || chunk_index ELSE '' END AS unit_id, chunk_index, text FROM u""")
def t28_transcript_units(t: Tables) -> DataFrame:
    """Short segments are merged first, long ones are cut then."""
    start = F.col("turn") * 12.5
    text_ = F.when(F.col("turn") % 3 == 1, F.left("text", F.lit(40))).otherwise(F.repeat(F.concat("text", F.lit(" ")), (F.col("turn") % 6 + 1).cast("int")))
    spoken = t.conversations.select("conv_id", "turn", start.alias("start"), (start + 10).alias("end"), text_.alias("text"))
    return greedy.transcript_units(greedy.merged_segments(spoken, "conv_id", "turn"), "conv_id").drop("chunk_total")


@query("""SELECT date_trunc('hour', ts)::VARCHAR AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2""")
def x1_stream_windows(t: Tables) -> DataFrame:
    from ..streaming.windows import hourly_counts

    return hourly_counts(t.spark, t.sf_dir)


@query("""SELECT event_type AS task_type, event_id AS job_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type <> 'error') WHERE k = 1""")
def x2_stream_jobs(t: Tables) -> DataFrame:
    from ..streaming.jobs import created_jobs

    return created_jobs(t.spark, t.sf_dir)
