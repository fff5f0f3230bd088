"""Queries around services: exports, uploads, payload filters, objects, messages, calls, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import gates, hooks, scans
from ..sources import files
from .registry import Tables, query


@query("SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang")
def s15_export(t: Tables) -> DataFrame:
    """Exported as JSON to the shared folder and counted from there."""
    return files.json_lines_round_trip(t.documents).groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT page_id, CASE WHEN regexp_matches(lower(url), '\\.(html?|md)$') THEN 'document' WHEN regexp_matches(lower(url), '\\.(png|jpe?g|webp)$') THEN 'image' WHEN regexp_matches(lower(url), '\\.(mp4|mov)$') THEN 'video' ELSE 'unknown' END AS kind, regexp_extract(url, '([^/]*)$', 1) AS name FROM pages")
def s22_upload_kinds(t: Tables) -> DataFrame:
    return t.pages.select("page_id", files.kind_of("url").alias("kind"), F.regexp_extract("url", "([^/]*)$", 1).alias("name"))


@query("SELECT DISTINCT o_orderkey, o_orderstatus FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate")
def s26_catalog(t: Tables) -> DataFrame:
    done = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    return t.orders.join(done, "o_orderkey").where("l_shipdate >= o_orderdate").select("o_orderkey", "o_orderstatus").distinct()


@query("SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src2') AND lang = 'en'")
def f6_f8_payload_filters(t: Tables) -> DataFrame:
    from ..operators.filters import matching

    wanted = [x for s in (" src1", "src2 ", " ", "") if (x := s.strip())]
    return matching(t.documents, "doc_id", any_of={"source": wanted, "lang": ["en"]}).select("doc_id", "source")


@query("SELECT l_orderkey, count(*) AS kept, count(*) FILTER (WHERE l_discount >= 0.05) AS above FROM lineitem GROUP BY l_orderkey")
def f10_optional_threshold(t: Tables) -> DataFrame:
    from ..operators.filters import at_least

    every, above = at_least(t.lineitem, "l_discount", None), at_least(t.lineitem, "l_discount", 0.05)
    return every.groupBy("l_orderkey").agg(F.count("*").alias("kept")).join(above.groupBy("l_orderkey").agg(F.count("*").alias("above")), "l_orderkey", "left").select("l_orderkey", "kept", F.coalesce("above", F.lit(0)).alias("above"))


@query("SELECT item_id, trim(regexp_replace(text, '[\\s\\p{Z}\\p{Cc}]+', ' ', 'g')) AS query FROM benchmark")
def f28_t17_normalised(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", text.squeeze(F.col("text")).alias("query"))


@query("SELECT count(*) AS pages, count(DISTINCT regexp_extract(url, '^[a-z]+://([^/]+)', 1)) AS hosts FROM pages")
def a24_distinct_pages(t: Tables) -> DataFrame:
    return t.pages.agg(F.count("*").alias("pages"), F.countDistinct(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)).alias("hosts"))


@query("SELECT page_id FROM pages WHERE sha1(url) NOT IN (SELECT sha1(url) FROM pages WHERE length(html) > 1500)")
def j22_not_yet_indexed(t: Tables) -> DataFrame:
    pages = t.pages.select("page_id", F.length("html").alias("size"), text.point_id(F.col("url")).alias("point"))
    return pages.join(pages.where("size > 1500").select("point"), "point", "left_anti").select("page_id")


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k FROM events""")
def t7_clean_json(t: Tables) -> DataFrame:
    made = F.concat(F.lit('{"props": '), "props", F.lit(', "a": [" ", {}, [null]], " ": 1, "b": {"c": {"d": ""}}}'))
    cleaned = t.events.select("event_id", hooks.clean_json(made).alias("j"))
    return cleaned.select("event_id", F.get_json_object("j", "$.props.k").alias("k"))


@query("""SELECT event_id, lower(trim(event_type)) || CASE WHEN value > 100 THEN ':' || round(value, 2)::VARCHAR ELSE '' END AS objects FROM events""")
def t8_objects(t: Tables) -> DataFrame:
    raw = F.array(F.struct(F.upper("event_type").alias("label"), F.when(F.col("value") > 100, F.round("value", 2)).alias("confidence")), F.struct(F.lit("  ").alias("label"), F.lit(0.5).alias("confidence")))
    kept = F.filter(F.transform(raw, lambda o: F.struct(F.lower(F.trim(o["label"])).alias("label"), o["confidence"].alias("confidence"))), lambda o: o["label"] != "")
    line = F.transform(kept, lambda o: F.concat(o["label"], F.coalesce(F.concat(F.lit(":"), o["confidence"].cast("string")), F.lit(""))))
    return t.events.select("event_id", F.array_join(line, ",").alias("objects"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text ELSE text || ' ' || role END AS flat FROM conversations")
def t39_flat_messages(t: Tables) -> DataFrame:
    """A message's content is a text or a list of parts, of which the texts count."""
    parts = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")), F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text")), F.struct(F.lit("text").alias("type"), F.col("role").alias("text"))))
    content = F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(parts)
    held = F.from_json(content, "array<struct<type:string,text:string>>")
    texts = F.filter(F.transform(held, lambda p: p["text"]), lambda x: x.isNotNull())
    return t.conversations.select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(F.array_join(texts, " ")).alias("flat"))


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, 'frames' AS bucket, l_orderkey || '/' || l_linenumber AS key, o_custkey FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus = 'F')
SELECT 'media' AS kind, o_custkey AS post, l_orderkey AS parent, key FROM f WHERE o_custkey IS NOT NULL UNION ALL SELECT 'frames', NULL, l_orderkey, l_linenumber::VARCHAR FROM f WHERE o_custkey IS NOT NULL UNION ALL SELECT 'rejected', NULL, l_orderkey, key FROM f WHERE o_custkey IS NULL""")
def e10_registered_frames(t: Tables) -> DataFrame:
    """Lines as frames of their orders: the rows made for each, and those without a parent."""
    media = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("media_id"), F.col("o_custkey").alias("post_id"))
    key = F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    frames = t.lineitem.select(F.col("l_orderkey").alias("video_media_id"), F.lit("frames").alias("bucket_name"), key.alias("object_key"), (F.col("l_linenumber") * 2.5).alias("timestamp"), F.col("l_linenumber").alias("frame_index"))
    rows, kind = gates.registered_rows(frames, media), F.col("kind")
    made = F.when(kind == "frames", F.col("frame_index").cast("string")).otherwise(F.col("object_key"))
    return rows.select("kind", F.when(kind == "media", F.col("post_id")).alias("post"), F.col("video_media_id").alias("parent"), made.alias("key"))


@query("SELECT doc_id, CASE WHEN length(text) <= 5000 THEN length(text) END AS value, CASE WHEN length(text) > 5000 THEN 'too long' END AS error FROM documents")
def e13_calls_with_fallback(t: Tables) -> DataFrame:
    def measure(texts: list[str]) -> list[int]:
        if any(len(x) > 5000 for x in texts):
            raise ValueError("too long")
        return [len(x) for x in texts]

    return hooks.called(t.documents.select("doc_id", "text"), "text", measure, "int", "r").select("doc_id", "r.value", "r.error")


@query("""WITH RECURSIVE d AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) AS i FROM documents),
r AS (SELECT doc_id, i, 0::BIGINT AS batch, 1 AS items, n_chars AS size FROM d WHERE i = 1 UNION ALL
SELECT d.doc_id, d.i, CASE WHEN r.items >= 32 OR r.size + d.n_chars > 100000 THEN r.batch + 1 ELSE r.batch END, CASE WHEN r.items >= 32 OR r.size + d.n_chars > 100000 THEN 1 ELSE r.items + 1 END, CASE WHEN r.items >= 32 OR r.size + d.n_chars > 100000 THEN d.n_chars ELSE r.size + d.n_chars END FROM r JOIN d ON d.i = r.i + 1)
SELECT doc_id, batch FROM r""")
def r10_batches(t: Tables) -> DataFrame:
    return scans.batches(t.documents, "doc_id", "n_chars", 32, 100_000)
