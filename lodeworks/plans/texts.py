"""Text queries: cleaning, keys, terms, facts, headings, over documents, pages, events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import status, text
from .registry import Tables, query

_FOLD = "regexp_replace(strip_accents(replace(replace({0}, 'đ', 'd'), 'Đ', 'D')), '[^\\x00-\\x7F]', '', 'g')"
_SQUEEZE = "trim(regexp_replace({0}, '[\\s\\p{{Z}}\\p{{Cc}}]+', ' ', 'g'))"
FOLD, SQUEEZE = _FOLD.format, _SQUEEZE.format


def _spelled(t: Tables) -> DataFrame:
    """The documents, two thirds of them with letters that are decomposed, of full width or ligatures."""
    k = F.col("doc_id") % 3
    marked = F.replace(F.replace(F.replace("text", F.lit("é"), F.lit("e\u0301")), F.lit("ü"), F.lit("u\u0308")), F.lit("ñ"), F.lit("n\u0303"))
    wide = F.replace(F.translate("text", "abT", "ａｂＴ"), F.lit("fi"), F.lit("ﬁ"))
    return t.documents.select("doc_id", "text", F.when(k == 1, marked).when(k == 2, wide).otherwise(F.col("text")).alias("spelled"))


_SPELLED = "(SELECT doc_id, text, CASE doc_id % 3 WHEN 1 THEN replace(replace(replace(text, 'é', 'e' || chr(769)), 'ü', 'u' || chr(776)), 'ñ', 'n' || chr(771)) WHEN 2 THEN replace(translate(text, 'abT', 'ａｂＴ'), 'fi', 'ﬁ') ELSE text END AS spelled FROM documents)"


@query(f"SELECT doc_id, sha256({FOLD('text')}) AS folded FROM documents")
def t1_fold(t: Tables) -> DataFrame:
    """However its letters are written, a text folds to what it folds to in plain letters."""
    return _spelled(t).select("doc_id", F.sha2(text.fold(F.col("spelled")), 256).alias("folded"))


@query(f"""SELECT doc_id, left(regexp_replace(regexp_replace(lower({FOLD('text')}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 255) AS slug FROM documents""")
def t2_slug(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.slug(F.col("text")).alias("slug"))


@query(f"SELECT p_partkey, {SQUEEZE('lower(' + FOLD('p_name') + ')')} AS alias_key FROM part")
def t3_alias_key(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.alias_key(F.col("p_name")).alias("alias_key"))


@query(f"SELECT doc_id, {SQUEEZE('nfc_normalize(spelled)')} AS clean FROM {_SPELLED}")
def t4_clean(t: Tables) -> DataFrame:
    return _spelled(t).select("doc_id", text.clean(F.col("spelled")).alias("clean"))


@query(f"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(nfc_normalize(spelled), chr(10)), lambda l: {SQUEEZE('l')}), lambda l: l <> ''), chr(10)) AS lines FROM {_SPELLED}""")
def t5_clean_lines(t: Tables) -> DataFrame:
    return _spelled(t).select("doc_id", text.clean_lines(F.col("spelled")).alias("lines"))


@query(f"""SELECT conv_id, turn, CASE WHEN upper(trim(role)) = 'USER' THEN {SQUEEZE('text')} ELSE '' END AS shown FROM conversations""")
def t6_gated(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.when(F.upper(F.trim("role")) == "USER", text.clean(F.col("text"))).otherwise("").alias("shown"))


@query("SELECT page_id, regexp_replace(replace(trim(url), '\\', '/'), '^/+|/+$', '', 'g') AS object_key FROM pages")
def t9_object_key(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.object_key(F.col("url")).alias("object_key"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE '.' || strftime(ts, '%f') END || 'Z' AS at FROM events""")
def t10_utc_text(t: Tables) -> DataFrame:
    return t.events.select("event_id", text.utc_text(F.col("ts")).alias("at"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS at FROM orders""")
def t11_local_time(t: Tables) -> DataFrame:
    written = t.orders.select("o_orderkey", F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.element_at(F.array(F.lit("Z"), F.lit("+0000"), F.lit("+07:00")), (F.col("o_orderkey") % 3 + 1).cast("int"))).alias("iso"))
    return written.select("o_orderkey", F.date_format(text.local_time(F.col("iso")), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("""SELECT event_id, CASE WHEN value * 100 < 3600 THEN printf('%02d:%02d', floor(value * 100 / 60)::BIGINT, floor(value * 100)::BIGINT % 60)
  ELSE printf('%02d:%02d:%02d', floor(floor(value * 100) / 3600)::BIGINT, floor(floor(value * 100) / 60)::BIGINT % 60, floor(value * 100)::BIGINT % 60) END AS clock,
  printf('%02d:%02d', floor(floor(value * 100) / 60)::BIGINT, floor(value * 100)::BIGINT % 60) AS minutes
  FROM events WHERE value >= 0""")
def t12_t13_clock(t: Tables) -> DataFrame:
    seconds = F.col("value") * 100
    return t.events.where("value >= 0").select("event_id", text.clock(seconds).alias("clock"), text.minutes(seconds).alias("minutes"))


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS i FROM conversations)
SELECT conv_id, string_agg('[' || i || '] (' || role || ') ' || text, chr(10) || chr(10) ORDER BY i) AS context FROM n GROUP BY conv_id""")
def t14_context(t: Tables) -> DataFrame:
    from ..operators.sequences import numbered_context

    return numbered_context(t.conversations, "conv_id", ["turn", "text"], "role", "text")


@query(f"SELECT doc_id, CASE WHEN {SQUEEZE('text')} = '' THEN 0 ELSE len(string_split({SQUEEZE('text')}, ' ')) END::INTEGER AS tokens FROM documents")
def t18_token_count(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.token_count(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, sha256({SQUEEZE('text')}) AS content_hash FROM documents")
def t19_content_hash(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))


@query("""WITH h AS (SELECT page_id, url, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(url)) AS h FROM pages)
SELECT page_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substring('89ab', (('0x' || h[17:17])::INTEGER % 4) + 1, 1) || h[18:20] || '-' || h[21:32] AS point_id FROM h""")
def t20_point_id(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.point_id(F.col("url")).alias("point_id"))


@query("""SELECT doc_id, len(list_filter(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')), lambda x: length(x) > 1 AND x NOT IN ('ai', 'các', 'có', 'cho', 'của', 'được', 'khi', 'là', 'một', 'những', 'và', 'về', 'với')))::INTEGER AS n_terms,
array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')), lambda x: length(x) > 1 AND x NOT IN ('ai', 'các', 'có', 'cho', 'của', 'được', 'khi', 'là', 'một', 'những', 'và', 'về', 'với'))), ' ') AS terms FROM documents""")
def t21_terms(t: Tables) -> DataFrame:
    found = text.terms(F.col("text"))
    return t.documents.select("doc_id", F.size(found).alias("n_terms"), F.array_join(F.array_sort(found), " ").alias("terms"))


@query(f"SELECT content_key, count(*) AS n, min(doc_id) AS first_id FROM (SELECT doc_id, {SQUEEZE('lower(text)')} AS content_key FROM documents) GROUP BY content_key")
def t22_content_key(t: Tables) -> DataFrame:
    return t.documents.groupBy(text.content_key(F.col("text")).alias("content_key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE length(line) <= 120 AND regexp_matches(line, '(?i)^(Chuong|Muc|Dieu|Khoan|Chương|Mục|Điều|Khoản|Nội quy|Quy định|[0-9]+(\\.[0-9]+)*[\\).]?|Doi voi|Đối với|Hinh thuc xu phat|Hình thức xử phạt)([^\\p{L}\\p{N}_]|$)')) AS headings
FROM l GROUP BY doc_id""")
def t24_headings(t: Tables) -> DataFrame:
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(text.is_heading(F.col("line"))).alias("headings"))


@query("""WITH c AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l)), lambda l: l <> '')) AS chunk, generate_subscripts(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l)), lambda l: l <> ''), 1) - 1 AS pos FROM documents),
h AS (SELECT *, sha256(chunk) AS content_hash FROM c), u AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(doc_id || ':' || pos || ':' || content_hash)) AS h FROM h)
SELECT doc_id, pos::INTEGER AS pos, content_hash, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substring('89ab', (('0x' || h[17:17])::INTEGER % 4) + 1, 1) || h[18:20] || '-' || h[21:32] AS chunk_id FROM u""")
def t26_chunk_rows(t: Tables) -> DataFrame:
    chunks = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = t.documents.select("doc_id", F.posexplode(chunks).alias("pos", "chunk")).withColumn("content_hash", F.sha2("chunk", 256))
    return rows.select("doc_id", "pos", "content_hash", text.point_id(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("pos").cast("string"), "content_hash")).alias("chunk_id"))


@query("""SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), value) AS first_number FROM events""")
def t33_first_number(t: Tables) -> DataFrame:
    return t.events.select("event_id", status.first_number(F.get_json_object("props", "$.k"), F.col("value")).alias("first_number"))


_STATES = """CASE upper(trim(event_type)) WHEN 'CLICK' THEN 'SUCCESS' WHEN 'ERROR' THEN 'error ' WHEN 'VIEW' THEN 'skipped' WHEN 'SIGNUP' THEN 'not_found' ELSE event_type END"""


@query(f"""WITH s AS (SELECT event_id, {_STATES} AS s FROM events),
m AS (SELECT event_id, s, upper(trim(s)) AS u FROM s)
SELECT event_id, CASE WHEN u IN ('DONE', 'SUCCESS', 'SKIPPED', 'NOT_FOUND') THEN 'DONE' WHEN u IN ('ERROR', 'FAILED', 'FAILURE') THEN 'FAILED' ELSE u END AS result_state,
CASE WHEN u IN ('DONE', 'SUCCESS', 'NOT_FOUND') THEN 'DONE' WHEN u = 'SKIPPED' THEN 'PENDING' WHEN u IN ('ERROR', 'FAILED', 'FAILURE') THEN 'FAILED' ELSE u END AS import_state,
CASE WHEN u = 'ERROR' OR (u = 'SKIPPED' AND event_id % 2 = 0) THEN 'FAILED' ELSE s END AS worker_state, u IN ('DONE', 'SUCCESS') AS done FROM m""")
def t34_f11_states(t: Tables) -> DataFrame:
    s = t.events.select("event_id", F.when(F.col("event_type") == "click", "SUCCESS").when(F.col("event_type") == "error", "error ").when(F.col("event_type") == "view", "skipped").when(F.col("event_type") == "signup", "not_found").otherwise(F.col("event_type")).alias("s"))
    reason = F.when(F.col("event_id") % 2 == 0, "Load failed: no file").otherwise("disabled by route")
    c = F.col("s")
    return s.select("event_id", status.result_state(c).alias("result_state"), status.import_state(c).alias("import_state"), status.worker_state(c, reason).alias("worker_state"), status.is_done(c).alias("done"))


@query("""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS prefix, regexp_extract(url, '^[a-z]+://[^/]+/(.*)$', 1) AS rest, length(regexp_extract(url, '^[a-z]+://([^/]+)/(.+)$', 2)) = 0 AS bad FROM pages""")
def t35_key_parts(t: Tables) -> DataFrame:
    url = F.col("url")
    return t.pages.select("page_id", F.regexp_extract(url, "^[a-z]+://([^/]+)", 1).alias("prefix"), F.regexp_extract(url, "^[a-z]+://[^/]+/(.*)$", 1).alias("rest"), (F.length(F.regexp_extract(url, "^[a-z]+://([^/]+)/(.+)$", 2)) == 0).alias("bad"))


@query("""SELECT page_id, coalesce(list_sort(list_transform(regexp_extract_all(trim(url), '[0-9]{6,}'), lambda x: {'n': -length(x), 'x': x}))[1].x, CASE WHEN length(trim(url)) <= 255 THEN trim(url) ELSE 'url-' || sha1(trim(url)) END) AS post_id FROM pages""")
def t36_id_in_url(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.id_in_url(F.col("url")).alias("post_id"))


_FACT_SQL = "list_sort(list_distinct(list_transform(list_concat(list_concat(regexp_extract_all(text, '\\b\\d{1,3}(?:\\.\\d{3})+\\b'), regexp_extract_all(text, '\\b0\\d[\\d\\s.]{7,12}\\d\\b')), regexp_extract_all(text, '\\b[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\\.[A-Za-z0-9_.]+\\b')), lambda x: trim(x))))"


@query(f"SELECT doc_id, array_to_string({_FACT_SQL}, '; ') AS facts, len({_FACT_SQL})::INTEGER AS n FROM documents")
def t37_facts(t: Tables) -> DataFrame:
    found = text.facts(F.col("text"))
    return t.documents.select("doc_id", F.array_join(found, "; ").alias("facts"), F.size(found).alias("n"))


@query(f"""WITH f AS (SELECT doc_id, unnest({_FACT_SQL}) AS fact FROM documents), g AS (SELECT f.*, d.text FROM f JOIN documents d ON d.doc_id = f.doc_id + 1)
SELECT doc_id, count(*) AS facts, count(*) FILTER (WHERE contains(lower(text), lower(fact)) OR (length(regexp_replace(fact, '[^0-9]', '', 'g')) >= 4 AND contains(regexp_replace(text, '[^0-9]', '', 'g'), regexp_replace(fact, '[^0-9]', '', 'g')))) AS grounded FROM g GROUP BY doc_id""")
def t38_grounded(t: Tables) -> DataFrame:
    found = t.documents.select("doc_id", F.explode(text.facts(F.col("text"))).alias("fact"))
    source = t.documents.select((F.col("doc_id") - 1).alias("doc_id"), "text")
    return found.join(source, "doc_id").groupBy("doc_id").agg(F.count("*").alias("facts"), F.count_if(text.is_grounded(F.col("fact"), F.col("text"))).alias("grounded"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k FROM events""")
def t40_fenced_json(t: Tables) -> DataFrame:
    fenced = F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```"))
    return t.events.select("event_id", F.get_json_object(text.json_fragment(text.without_fence(fenced)), "$.k").alias("k"))


@query("""SELECT o_orderkey, coalesce(nullif(trim(CASE WHEN o_orderkey % 2 = 0 THEN ' ' ELSE o_orderpriority END), ''), CASE WHEN o_orderkey % 3 = 0 THEN '1999' END, CASE WHEN year(o_orderdate) BETWEEN 1900 AND 2200 THEN year(o_orderdate)::VARCHAR END) AS label FROM orders""")
def t41_label(t: Tables) -> DataFrame:
    from ..operators.entities import occurrence_label

    given = F.when(F.col("o_orderkey") % 2 == 0, " ").otherwise(F.col("o_orderpriority"))
    return t.orders.select("o_orderkey", occurrence_label(given, F.when(F.col("o_orderkey") % 3 == 0, 1999), F.col("o_orderdate"), (1900, 2200)).alias("label"))


@query("SELECT doc_id, CASE WHEN length(text) > 90 THEN rtrim(left(text, 90)) || '…' ELSE text END AS title FROM documents")
def t43_excerpt(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.excerpt(F.col("text"), 90).alias("title"))


@query("""WITH a AS (SELECT source, doc_id >> 10 AS p, sha256(string_agg(doc_id || chr(0) || left(sha256(text), 16), chr(0) ORDER BY doc_id)) AS d FROM documents GROUP BY ALL),
b AS (SELECT source, p >> 10 AS p, sha256(string_agg(d, chr(0) ORDER BY a.p)) AS d FROM a GROUP BY source, p >> 10), c AS (SELECT source, p >> 10 AS p, sha256(string_agg(d, chr(0) ORDER BY b.p)) AS d FROM b GROUP BY source, p >> 10)
SELECT source, left(sha256(string_agg(d, chr(0) ORDER BY p)), 16) AS fingerprint FROM c GROUP BY source""")
def t44_fingerprint(t: Tables) -> DataFrame:
    from ..operators.sequences import tree_fingerprint

    return tree_fingerprint(t.documents.withColumn("text", F.left(F.sha2("text", 256), F.lit(16))), "source", "doc_id", "text")


@query("""SELECT conv_id, array_to_string(CASE WHEN len(r) <= 5 THEN r ELSE list_concat(list_concat(r[1:3], ['…']), r[len(r) - 1:len(r)]) END, ',') AS roles FROM (SELECT conv_id, list(role ORDER BY turn, text) AS r FROM conversations GROUP BY conv_id)""")
def t45_bounded_list(t: Tables) -> DataFrame:
    from ..operators.sequences import bounded_list

    return bounded_list(t.conversations, "conv_id", ["turn", "text"], "role", 3, 2, "roles")


def _quoted(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _case(values, column: str = "text"):
    """One of the values for most rows, what the table holds for the others; in SQL as _CASE says it."""
    k = F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(len(values) + 5)).cast("int")
    return F.coalesce(F.get(F.array(*map(F.lit, values)), k), F.col(column))


def _case_sql(values, column: str = "text") -> str:
    return f"coalesce({_quoted(values)}[((conv_id * 7 + turn) % {len(values) + 5})::INTEGER + 1], {column})"


_REPORTS = (*[x.upper() if i % 3 == 0 else f" {x} " if i % 3 == 1 else x for i, x in enumerate(text.ERROR_TEXTS)], "API  Error: x", "Lỗi mạng", "LỖI", "loi he thong", "Không thể đọc và xử lý ảnh", "khong the  nhan dien", "Timed out waiting", "an exception: none", "Rate limit", "errors are fine", "not an error", "lời chào", "không thể quên", "failures", "traceback (most recent call last) here", "Traceback")
_ERR = f"""(lower(trim(text)) IN {_quoted(text.ERROR_TEXTS).replace("[", "(", 1)[:-1]}) OR lower({FOLD('lower(trim(text))')}) IN {_quoted(text.ERROR_TEXTS).replace("[", "(", 1)[:-1]}) OR regexp_matches(text, '(?i)^(api\\s+)?(error|failed|failure|exception|traceback|timeout|timed out)\\b')
 OR regexp_matches(text, '(?i)\\b(traceback \\(most recent call last\\)|exception:|api error|connection error|rate limit)\\b') OR regexp_matches(text || ' ', '(?i)^(lỗi|loi)[^\\p{{L}}\\p{{N}}_]') OR regexp_matches(text, '(?is)^(không thể|khong the).*(xử lý|xu ly|phân tích|phan tich|trích xuất|trich xuat|nhận diện|nhan dien)'))"""


@query(f"SELECT conv_id, turn, text, {_ERR} AS error_like FROM (SELECT conv_id, turn, {_case_sql(_REPORTS)} AS text FROM conversations)")
def f12_error_like(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", _case(_REPORTS).alias("text")).withColumn("error_like", text.is_error_like(F.col("text")))


@query("""SELECT event_id, CASE WHEN isfinite(x) THEN x END AS finite, trunc(CASE WHEN isfinite(x) THEN x END)::BIGINT AS whole FROM (SELECT event_id, try_cast(CASE WHEN event_id % 4 = 0 THEN 'NaN' WHEN event_id % 4 = 1 THEN 'x' WHEN event_id % 4 = 2 THEN (-value)::VARCHAR ELSE value::VARCHAR END AS DOUBLE) AS x FROM events)""")
def f13_finite(t: Tables) -> DataFrame:
    k = F.col("event_id") % 4
    made = F.when(k == 0, "NaN").when(k == 1, "x").when(k == 2, (-F.col("value")).cast("string")).otherwise(F.col("value").cast("string"))
    return t.events.select("event_id", status.finite(made).alias("finite"), status.finite_int(made).alias("whole"))


_SILENCE = (*[f"Và {x.upper()}!" for x in text.BOILERPLATE], "Đừng quên  ĐĂNG KÝ!", "ĐĂNG  KÝ KÊNH", "<", "…", "", "đăng ký học", "cảm ơn các bạn")


@query(f"""WITH f AS (SELECT conv_id, turn, {SQUEEZE('lower(' + FOLD(_case_sql(_SILENCE)) + ')')} AS s FROM conversations)
SELECT conv_id, turn, NOT regexp_matches(s, '[a-z0-9]') OR len(list_filter({_quoted(text.BOILERPLATE)}, lambda p: contains(s, p))) > 0 AS boilerplate FROM f""")
def f15_boilerplate(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", text.is_boilerplate(_case(_SILENCE)).alias("boilerplate"))


_TALK = (
    "Xin chào bạn nhé!", "😊 ???", ":))", "cảm ơn cậu", "chào ae", "hi admin", "ukm", "biết rồi", "em khoẻ không", "làm gì được", "HELLOOO", "ok thanks bot nha", "Tạm biệt các bạn", "good night", "hahaha", "bạn là ai vậy", "tên là gì",
    "giúp được những gì", "có gì hay không", "dạo này thế nào", "đang làm gì đấy", "test", "1234", "aaaa", "hello ca nha", "chao you guys", "hi all", "chào mừng tân sinh viên", "ảnh mọi người", "ok", "được rồi", "chào lumi", "tìm ảnh", "cảm ơn nhiều nhé", "test ảnh", "yo", "bye bye", "good",
)


@query(f"""WITH f AS (SELECT conv_id, turn, {SQUEEZE("regexp_replace(lower(" + FOLD(_case_sql(_TALK)) + "), '[^a-z0-9]+', ' ', 'g')")} AS s FROM conversations)
SELECT conv_id, turn, s = '' OR {" OR ".join(f"regexp_matches(s, '{p.replace('OWN', '|lumi')}')" for p in text.SMALL_TALK)} AS small_talk FROM f""")
def f24_small_talk(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", text.is_small_talk(_case(_TALK), ("lumi",)).alias("small_talk"))


@query()
def t15_t16_watermark(t: Tables) -> DataFrame:
    marked = F.concat(F.lit("0101 1010 0110 11\nTHE SAMPLE CLUB\n"), "text", F.lit("\nSMP"))
    return t.documents.select("doc_id", text.without_watermark(text.clean_lines(marked), ("sample club", "the sample club", "smp")).alias("text"))
