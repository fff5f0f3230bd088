"""The operators' queries, each over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, htmltext, langid, licenses, neardup, packing, pii, quality, repair, secretscan, topk, vectorcodes, winnowing
from .common import table

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.searched(table(spark, sf_dir, "embeddings"))


def op2_secretscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.reported(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.grouped(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.reported(table(spark, sf_dir, "documents"))


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compared(table(spark, sf_dir, "documents"))


def op7_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extracted(table(spark, sf_dir, "pages"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scans(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trips(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(table(spark, sf_dir, "documents"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.audited(repair.damaged(table(spark, sf_dir, "conversations")), F.col("there"))


def op12_vectorcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compressed(table(spark, sf_dir, "embeddings"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_topk, op2_secretscan, op3_packing, op4_neardup, op5_pii, op6_winnowing, op7_htmltext, op8_licenses, op9_bpe, op10_langid, op11_repair, op12_vectorcodes, op13_quality)}
OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.x) = len(q.x) WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS "rank" FROM s
)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 10
"""

OP4_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w
), n AS (
  SELECT doc_id, len(s) AS n FROM g
), u AS (
  SELECT doc_id, unnest(s) AS s FROM g
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM u a JOIN u b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)
), f AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r(doc_id, reached) AS (
  SELECT doc_id, doc_id FROM n
  UNION
  SELECT r.doc_id, f.b FROM r JOIN f ON f.a = reached
), c AS (
  SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id
)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
"""

OP11_SQL = """
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '') AS c FROM conversations
), summed AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_concat([4294967295], list_transform(c, lambda x: ord(x)::BIGINT)), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 20 AS k FROM keyed, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN k = 0 THEN [] WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy FROM summed
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS final FROM damaged
), marked AS (
  SELECT *, left(role, 1) AS initial, final = '' AS blank, final <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate,
    coalesce(lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) NOT IN ('su', 'ua', 'au'), false) AS illegal FROM numbered
), faults AS (
  SELECT *, NOT blank AND NOT duplicate AND final NOT IN ('.', '!', '?') AS truncated FROM marked
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count_if(blank)::BIGINT AS blank, count_if(duplicate)::BIGINT AS duplicate, count_if(truncated)::BIGINT AS truncated, count_if(illegal)::BIGINT AS illegal, count(*) AS n FROM faults GROUP BY conv_id
), paths AS (
  SELECT conv_id, 0::BIGINT AS i, {'c': 0::BIGINT, 'w': ''} AS p0, {'c': 1000000000::BIGINT, 'w': ''} AS p1, {'c': 2::BIGINT, 'w': 'I'} AS pu, {'c': 4::BIGINT, 'w': 'II'} AS pa FROM counted
  UNION ALL
  SELECT conv_id, i, d0, d1, u, list_sort([da, {'c': u.c + 2, 'w': u.w || 'I'}])[1] FROM (
    SELECT *, list_sort([du, {'c': d0.c + 2, 'w': d0.w || 'I'}, {'c': d1.c + 2, 'w': d1.w || 'I'}, {'c': da.c + 2, 'w': da.w || 'I'}])[1] AS u FROM (
      SELECT f.conv_id, f.i, {'c': p0.c + 3, 'w': p0.w || 'D'} AS d0,
        list_sort([{'c': p1.c + 3, 'w': p1.w || 'D'}, {'c': CASE WHEN initial = 's' AND NOT blank AND NOT duplicate THEN p0.c + truncated::INT ELSE 1000000000 END, 'w': p0.w || 'K'}])[1] AS d1,
        list_sort(list_concat([{'c': pu.c + 3, 'w': pu.w || 'D'}], CASE WHEN blank OR duplicate THEN [] WHEN initial = 'u' THEN list_transform([p0, p1, pa], lambda p: {'c': p.c + truncated::INT, 'w': p.w || 'K'}) ELSE list_transform([p0, p1, pa], lambda p: {'c': p.c + 2 + truncated::INT, 'w': p.w || 'R'}) END))[1] AS du,
        list_sort(list_concat([{'c': pa.c + 3, 'w': pa.w || 'D'}], CASE WHEN blank OR duplicate THEN [] WHEN initial = 'a' THEN [{'c': pu.c + truncated::INT, 'w': pu.w || 'K'}] ELSE [{'c': pu.c + 2 + truncated::INT, 'w': pu.w || 'R'}] END))[1] AS da
      FROM paths p JOIN faults f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1
    )
  )
), chosen AS (
  SELECT p.conv_id, list_sort([p0, pa])[1] AS best FROM paths p JOIN counted c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.n = p.i
), letters AS (
  SELECT conv_id, unnest(string_split(best.w, '')) AS letter, generate_subscripts(string_split(best.w, ''), 1) AS j FROM chosen WHERE best.w <> ''
), placed AS (
  SELECT *, count_if(letter <> 'I') OVER (PARTITION BY conv_id ORDER BY j) AS i, count_if(letter <> 'D') OVER (PARTITION BY conv_id ORDER BY j) AS e FROM letters
), lined AS (
  SELECT l.conv_id, l.j, l.e, l.letter, f.role, f.text, max(CASE WHEN l.e = 1 AND l.letter = 'K' AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS led
  FROM placed l LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.i AND l.letter <> 'I' WHERE l.letter <> 'D'
), joined AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (e - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY j) AS lines FROM lined GROUP BY conv_id
), every AS (
  SELECT DISTINCT conv_id FROM conversations
)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.c, 0) AS cost, coalesce(best.w, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM every e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN chosen h ON h.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN joined j ON j.conv_id IS NOT DISTINCT FROM e.conv_id
"""

_DISTANCE = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT"
_ASSIGNED = f"SELECT vec_id, x.part, any_value(x) AS x, min({{'d': {_DISTANCE}, 'e': entry}}) AS m FROM parts x JOIN BOOK b ON b.part = x.part GROUP BY vec_id, x.part"
_ROUNDS = "".join(
    f"""
), a{r} AS MATERIALIZED ({_ASSIGNED.replace("BOOK", f"b{r}")}
), s{r} AS (
  SELECT part, m.e AS entry, i, sum(x[i])::BIGINT AS s, count(*) AS k FROM a{r}, unnest(range(1, len(x) + 1)) AS u(i) GROUP BY ALL
), b{r + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(n.c, b.c) AS c FROM b{r} b LEFT JOIN (SELECT part, entry, list((s - (s % k + k) % k) // k ORDER BY i) AS c FROM s{r} GROUP BY ALL) n ON n.part = b.part AND n.entry = b.entry"""
    for r in range(6)
)
OP12_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda e: floor(4096 * e::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, p AS part, v[p * (len(v) // 8) + 1:(p + 1) * (len(v) // 8)] AS x FROM v, unnest(range(8)) AS u(p)
), b0 AS MATERIALIZED (
  SELECT part, x AS c, dense_rank() OVER (ORDER BY vec_id) - 1 AS entry FROM parts QUALIFY entry < 16{_ROUNDS}
), f AS MATERIALIZED ({_ASSIGNED.replace("BOOK", "b6")}
), coded AS (
  SELECT vec_id, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM f GROUP BY vec_id
), books AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b6
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN v USING (vec_id), books
"""

ORACLES: dict[str, str] = {"op1_topk": OP1_SQL, "op4_neardup": OP4_SQL, "op11_repair": OP11_SQL, "op12_vectorcodes": OP12_SQL}
