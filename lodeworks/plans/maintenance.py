"""Sources, sinks and upkeep: upserts, diffs, payload updates, syncs, listings, constraint checks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


from ..operators import aliases, entities, gates, merge, reconcile
from ..sources import files
from ..sources.points import Points
from .registry import Tables, query
from .texts import FOLD


def _posts_old(t: Tables) -> DataFrame:
    return t.documents.where(~F.col("lang").eqNullSafe("fr")).select("doc_id", "lang", "source", "n_chars")


def _posts_new(t: Tables) -> DataFrame:
    d = t.documents.where(~F.col("lang").eqNullSafe("de"))
    return d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("lang"), F.upper("source").alias("source"), F.when(F.col("doc_id") % 5 != 0, F.col("n_chars") + 1).alias("n_chars"))


_OLD = "o AS (SELECT doc_id, lang, source, n_chars FROM documents WHERE lang IS DISTINCT FROM 'fr')"
_NEW = "n AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang END AS lang, upper(source) AS source, CASE WHEN doc_id % 5 <> 0 THEN n_chars + 1 END AS n_chars FROM documents WHERE lang IS DISTINCT FROM 'de')"


@query(f"WITH {_OLD}, {_NEW} SELECT doc_id, coalesce(n.lang, o.lang) AS lang, CASE WHEN n.doc_id IS NULL THEN o.source ELSE n.source END AS source, CASE WHEN n.doc_id IS NULL THEN o.n_chars ELSE n.n_chars END AS n_chars FROM o FULL JOIN n USING (doc_id)")
def e1_post_upsert(t: Tables) -> DataFrame:
    return merge.upserted(_posts_old(t), _posts_new(t), ["doc_id"], keep_if_null=["lang"])


@query("WITH n AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL), o AS (SELECT * FROM n WHERE c_nationkey < 20), w AS (SELECT c_nationkey, c_mktsegment, n + 100 AS n FROM n WHERE c_nationkey > 10) SELECT c_nationkey, c_mktsegment, coalesce(w.n, o.n) AS n FROM o FULL JOIN w USING (c_nationkey, c_mktsegment)")
def e2_composite_upsert(t: Tables) -> DataFrame:
    n = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return merge.upserted(n.where("c_nationkey < 20"), n.where("c_nationkey > 10").withColumn("n", F.col("n") + 100), ["c_nationkey", "c_mktsegment"])


@query(f"WITH {_OLD}, {_NEW} SELECT doc_id, coalesce(n.lang, o.lang) AS lang, coalesce(o.source, n.source) AS source, CASE WHEN n.doc_id IS NULL THEN o.n_chars ELSE n.n_chars END AS n_chars FROM o FULL JOIN n USING (doc_id)")
def e3_series_upsert(t: Tables) -> DataFrame:
    return merge.upserted(_posts_old(t), _posts_new(t), ["doc_id"], keep_if_null=["lang"], immutable=["source"])


@query(f"WITH {_OLD}, {_NEW} SELECT doc_id, coalesce(n.lang, o.lang) AS lang, coalesce(n.source, o.source) AS source, coalesce(n.n_chars, o.n_chars) AS n_chars FROM o FULL JOIN n USING (doc_id)")
def e4_non_null_wins(t: Tables) -> DataFrame:
    return merge.upserted(_posts_old(t), _posts_new(t), ["doc_id"], keep_if_null=["lang", "source", "n_chars"])


@query(f"WITH {_OLD}, {_NEW} SELECT doc_id, CASE WHEN n.doc_id IS NULL THEN o.lang ELSE n.lang END AS lang, CASE WHEN n.doc_id IS NULL THEN o.source ELSE n.source END AS source, CASE WHEN n.doc_id IS NULL THEN o.n_chars ELSE n.n_chars END AS n_chars FROM o FULL JOIN n USING (doc_id)")
def e9_overwrite_all(t: Tables) -> DataFrame:
    return merge.upserted(_posts_old(t), _posts_new(t), ["doc_id"])


@query("""WITH a AS (SELECT s_nationkey AS target, lower(left(s_name, 14)) AS alias, s_suppkey % 7 = 0 AS override, s_suppkey AS seq FROM supplier),
r AS (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY override DESC, CASE WHEN override THEN -seq ELSE seq END) AS k, count(*) OVER (PARTITION BY alias) AS claims FROM a) SELECT alias, target, claims FROM r WHERE k = 1""")
def e5_alias_owner(t: Tables) -> DataFrame:
    claims = t.supplier.select(F.lower(F.left("s_name", F.lit(14))).alias("alias"), F.col("s_nationkey").alias("target"), (F.col("s_suppkey") % 7 == 0).alias("override"), F.col("s_suppkey").alias("seq"))
    return entities.alias_owners(claims)


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_returnflag = 'N' AS is_new_primary, max(CASE WHEN l_returnflag = 'N' THEN l_linenumber END) OVER (PARTITION BY l_orderkey) AS last_primary FROM lineitem)
SELECT l_orderkey, l_linenumber, coalesce(l_linenumber = last_primary, false) AS is_primary FROM r""")
def e6_last_primary(t: Tables) -> DataFrame:
    links = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "N").alias("asked"))
    return entities.with_last_primary(links, "l_orderkey", "l_linenumber", "asked").select("l_orderkey", "l_linenumber", "is_primary")


@query("""WITH l AS (SELECT c_custkey, c_custkey % 90 AS occurrence, c_acctbal < 9600 AS unlinked FROM customer), used AS (SELECT DISTINCT s_nationkey FROM l JOIN supplier ON s_suppkey = occurrence WHERE NOT unlinked), o AS (SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM used))
SELECT 'links' AS kind, c_custkey AS id FROM l WHERE unlinked UNION ALL SELECT 'series', n_nationkey FROM o UNION ALL SELECT 'occurrences', s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM o)""")
def e7_unlinked_removed(t: Tables) -> DataFrame:
    series = t.nation.select(F.col("n_nationkey").alias("series_id"))
    occurrences = t.supplier.select(F.col("s_suppkey").alias("occurrence_id"), F.col("s_nationkey").alias("series_id"))
    links = t.customer.select(F.col("c_custkey").alias("post_id"), (F.col("c_custkey") % 90).alias("occurrence_id"))
    gone = aliases.after_unlinking(series, occurrences, links, t.customer.where("c_acctbal < 9600").select(F.col("c_custkey").alias("post_id")))
    ids = {"links": "post_id", "series": "series_id", "occurrences": "occurrence_id"}
    each = [rows.select(F.lit(kind).alias("kind"), F.col(ids[kind]).cast("long").alias("id")) for kind, rows in gone.items()]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query("""WITH c AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations), w AS (SELECT conv_id, turn, 'kept' AS role, n FROM c WHERE conv_id % 4 = 0 AND turn % 2 = 0)
SELECT * FROM c WHERE conv_id NOT IN (SELECT conv_id FROM w) UNION ALL SELECT * FROM w""")
def e8_children_replaced(t: Tables) -> DataFrame:
    c = t.conversations.select("conv_id", "turn", "role", F.length("text").alias("n"))
    new = c.where((F.col("conv_id") % 4 == 0) & (F.col("turn") % 2 == 0)).withColumn("role", F.lit("kept"))
    return merge.replaced_children(c, new, "conv_id")


@query("""WITH o AS (SELECT doc_id, sha256(text) AS h, lang, 'v1' AS v FROM documents WHERE lang IS DISTINCT FROM 'fr'), n AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS h, lang, CASE WHEN doc_id % 11 = 0 THEN 'v2' ELSE 'v1' END AS v FROM documents WHERE lang IS DISTINCT FROM 'es' AND NOT (lang = 'en' AND n_chars < 1500))
SELECT doc_id, CASE WHEN o.doc_id IS NULL THEN 'insert' WHEN n.doc_id IS NULL AND o.lang IN (SELECT lang FROM n) THEN 'delete' WHEN n.doc_id IS NULL THEN 'out of scope' WHEN o.h = n.h AND o.v = n.v THEN 'unchanged' ELSE 'update' END AS action FROM o FULL JOIN n USING (doc_id)""")
def e11_index_diff(t: Tables) -> DataFrame:
    d = t.documents
    old = d.where(~F.col("lang").eqNullSafe("fr")).select("doc_id", F.sha2("text", 256).alias("h"), "lang", F.lit("v1").alias("v"))
    changed = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = d.where("lang is distinct from 'es' and not (lang <=> 'en' and n_chars < 1500)").select("doc_id", F.sha2(changed, 256).alias("h"), "lang", F.when(F.col("doc_id") % 11 == 0, "v2").otherwise("v1").alias("v"))
    return merge.index_actions(old, new, "doc_id", ["h", "v"], "lang")


@query("""WITH o AS (SELECT doc_id, sha256(text) AS h, lang FROM documents WHERE doc_id NOT BETWEEN 300 AND 310), n AS (SELECT doc_id, CASE WHEN doc_id BETWEEN 100 AND 140 AND doc_id % 7 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS h, lang FROM documents WHERE doc_id % 5000 NOT IN (20, 21, 23) AND lang IS DISTINCT FROM 'es')
SELECT doc_id, CASE WHEN o.doc_id IS NULL THEN 'insert' WHEN n.doc_id IS NULL AND o.lang IN (SELECT lang FROM n) THEN 'delete' WHEN n.doc_id IS NULL THEN 'out of scope' ELSE 'update' END AS action FROM o FULL JOIN n USING (doc_id) WHERE o.h IS DISTINCT FROM n.h""")
def s5_e11_reconciled(t: Tables) -> DataFrame:
    """What differs between two versions of the documents, found by hash trees over ranges of ids."""
    from ..session import shared_folder

    folder = f"{shared_folder(t.spark)}/lodeworks/reconcile-{uuid.uuid4().hex}"
    held = t.documents.select("doc_id", F.sha2("text", 256).alias("h"), F.sha2(F.concat("text", F.lit("!")), 256).alias("changed"), "lang")
    marked = F.when(F.col("doc_id").between(100, 140) & (F.col("doc_id") % 7 == 0), F.col("changed")).otherwise(F.col("h"))
    old = held.where(~F.col("doc_id").between(300, 310)).select("doc_id", "h", "lang")
    new = held.where(~(F.col("doc_id") % 5000).isin(20, 21, 23) & ~F.col("lang").eqNullSafe("es")).select("doc_id", marked.alias("h"), "lang")
    a, b = (reconcile.snapshot(x, f"{folder}/{n}", "doc_id", ["h"], "lang", width=512) for n, x in (("old", old), ("new", new)))
    return reconcile.differences(a, b, "doc_id", ["h"], "lang")


@query("WITH u AS (SELECT text, min(doc_id) AS first_id, length(text) AS v FROM documents GROUP BY text) SELECT d.doc_id, u.v::INTEGER AS v, d.doc_id = u.first_id AS made FROM documents d JOIN u USING (text)")
def e12_embed_once(t: Tables) -> DataFrame:
    keyed = t.documents.select("doc_id", "text", F.sha2("text", 256).alias("h"))
    once = keyed.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.first("text").alias("text")).select("h", "first_id", F.length("text").alias("v"))
    return keyed.select("doc_id", "h").join(once, "h").select("doc_id", "v", (F.col("doc_id") == F.col("first_id")).alias("made"))


_OBJECTS = "o AS (SELECT page_id, url AS object_key, page_id % 120 AS post, page_id % 3 = 0 AS held, page_id % 120 IN (SELECT doc_id FROM documents WHERE lang <> 'es') AS told FROM pages), r AS (SELECT *, CASE WHEN held THEN 'skipped' WHEN NOT told THEN 'missing' ELSE 'created' END AS outcome FROM o)"


def _registered(t: Tables) -> DataFrame:
    objects = t.pages.select("page_id", F.concat_ws("#", "url", F.col("page_id").cast("string")).alias("object_key"), (F.col("page_id") % 120).alias("post"))
    return gates.registration(objects, objects.where("page_id % 3 = 0"), t.documents.where("lang <> 'es'").select(F.col("doc_id").alias("post")))


@query(f"WITH {_OBJECTS} SELECT count(*) AS found, count_if(outcome = 'created')::BIGINT AS created, count_if(outcome = 'skipped')::BIGINT AS skipped, count_if(outcome = 'missing')::BIGINT AS skipped_missing_metadata, count(DISTINCT CASE WHEN outcome = 'created' THEN post END) AS posts, count(DISTINCT CASE WHEN NOT told THEN post END) AS missing_metadata FROM r")
def e14_registration(t: Tables) -> DataFrame:
    return gates.registration_report(_registered(t))


@query(f"WITH {_OBJECTS} SELECT page_id, post, outcome FROM r")
def e14_outcomes(t: Tables) -> DataFrame:
    return _registered(t).select("page_id", "post", "outcome")


@query("""WITH a AS (SELECT p_partkey, unnest([p_name, p_brand, p_type]) AS alias, unnest([0, 1, 2]) AS k FROM part), r AS (SELECT lower(alias) AS alias, p_partkey, row_number() OVER (PARTITION BY lower(alias) ORDER BY p_partkey, k) AS n FROM a) SELECT alias, p_partkey AS canonical FROM r WHERE n = 1""")
def e15_first_spelling(t: Tables) -> DataFrame:
    each = t.part.select("p_partkey", F.posexplode(F.array("p_name", "p_brand", "p_type")).alias("k", "alias"))
    return each.groupBy(F.lower("alias").alias("alias")).agg(F.min(F.struct("p_partkey", "k")).alias("f")).select("alias", F.col("f.p_partkey").alias("canonical"))


@query("""WITH RECURSIVE f AS (SELECT p_type || ' ' || p_name AS name, count(*) AS n, CASE WHEN p_type = 'PROMO' AND p_name LIKE '%ring' THEN 'Promo Ring' WHEN p_type = 'PROMO' THEN 'Promo' END AS anchor FROM part GROUP BY p_type, p_name),
b AS (SELECT name, (row_number() OVER (ORDER BY lower(name), name) - 1) // 40 AS batch FROM f WHERE anchor IS NULL), one AS (SELECT name, min(name) OVER (PARTITION BY batch, split_part(name, ' ', 3)) AS canon FROM b),
two AS (SELECT DISTINCT canon AS name, CASE WHEN split_part(canon, ' ', 3) = 'widget' THEN 'promo' ELSE split_part(canon, ' ', 3) END AS canon FROM one),
e AS (SELECT '3' || name AS a, '2' || canon AS b FROM one UNION ALL SELECT '2' || name, '1' || canon FROM two UNION ALL SELECT '3' || name, '0' || anchor FROM f WHERE anchor IS NOT NULL UNION ALL SELECT DISTINCT '1' || canon, '0Promo' FROM two WHERE canon = 'promo'),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(name, reached) AS (SELECT a, a FROM u UNION SELECT r.name, u.b FROM r JOIN u ON u.a = r.reached), c AS (SELECT name, min(reached) AS root, count(*) FILTER (WHERE reached LIKE '0%') AS anchors FROM r GROUP BY name)
SELECT f.name, n, substring(root, 2) AS cluster, sum(n) OVER (PARTITION BY root)::BIGINT AS weight, anchors FROM f JOIN c ON c.name = '3' || f.name""")
def e16_anchored_clusters(t: Tables) -> DataFrame:
    """Kinds of parts: the promotional ones are anchored, the others are clustered by their last word in batches, then over all; one cluster leads to an anchor."""
    name = F.concat_ws(" ", "p_type", "p_name")
    names = t.part.groupBy(name.alias("name")).agg(F.count("*").alias("n"))
    promo = t.part.where("p_type = 'PROMO'").select(name.alias("alias"), F.when(F.col("p_name").endswith("ring"), "Promo Ring").otherwise("Promo").alias("anchor")).distinct()
    anchors = promo.unionByName(t.region.limit(1).select(F.lit("promo").alias("alias"), F.lit("Promo").alias("anchor")))

    def by_last_word(asked: DataFrame) -> DataFrame:
        return asked.select("name", F.min("name").over(Window.partitionBy("batch", F.split_part("name", F.lit(" "), F.lit(3)))).alias("canon"))

    def over_all(asked: DataFrame) -> DataFrame:
        word = lambda n: F.split_part("name", F.lit(" "), F.lit(n))
        return asked.select("name", F.when(word(3) == "widget", "promo").otherwise(word(3)).alias("canon"))

    return aliases.clustered(names, anchors, by_last_word, over_all)


@query("""WITH RECURSIVE rec AS (SELECT p_partkey AS seq, p_brand || ' ' || p_size % 5 AS raw, p_brand || ' ' || (p_size + p_partkey) % 7 AS canon FROM part), k AS (SELECT seq, raw, canon, lower(raw) AS kr, lower(canon) AS kc, regexp_replace(lower(canon), '[^a-z0-9]+', '-', 'g') AS slug FROM rec),
held AS (SELECT DISTINCT lower(p_brand || ' 3') AS key, 'old-' || right(p_brand, 1) AS slug FROM part WHERE p_brand LIKE '%1'), own AS (SELECT key, min(seq) AS seq FROM (SELECT kr AS key, seq FROM k UNION ALL SELECT kc, seq FROM k) GROUP BY key),
l AS (SELECT k.*, hc.slug AS hc, hr.slug AS hr, c.seq AS oc, r.seq AS o_r FROM k JOIN own c ON c.key = kc JOIN own r ON r.key = kr LEFT JOIN held hc ON hc.key = kc LEFT JOIN held hr ON hr.key = kr),
p AS (SELECT *, CASE WHEN hc IS NOT NULL THEN NULL WHEN oc < seq THEN oc WHEN hr IS NOT NULL THEN NULL WHEN o_r < seq THEN o_r END AS up, CASE WHEN hc IS NOT NULL THEN hc WHEN oc < seq THEN NULL WHEN hr IS NOT NULL THEN hr WHEN o_r < seq THEN NULL ELSE slug END AS series FROM l),
climb AS (SELECT seq, up, series FROM p UNION ALL SELECT climb.seq, p.up, p.series FROM climb JOIN p ON p.seq = climb.up), f AS (SELECT seq, series FROM climb WHERE series IS NOT NULL), o AS (SELECT own.key, coalesce(held.slug, f.series) AS series FROM own JOIN f USING (seq) LEFT JOIN held ON held.key = own.key)
SELECT p.seq, f.series AS slug, (hc IS NOT NULL OR oc < p.seq OR hr IS NOT NULL OR o_r < p.seq) AS known, (a.series <> f.series)::INTEGER + (raw <> canon AND b.series <> f.series)::INTEGER AS conflicts FROM p JOIN f USING (seq) JOIN o a ON a.key = kc JOIN o b ON b.key = kr""")
def e17_reconciled(t: Tables) -> DataFrame:
    """Parts as records of names that overlap: which series each is written to, and the aliases that belong to others."""
    brand, size = F.col("p_brand"), F.col("p_size")
    records = t.part.select(F.col("p_partkey").alias("seq"), F.concat_ws(" ", brand, (size % 5).cast("string")).alias("raw"), F.concat_ws(" ", brand, ((size + F.col("p_partkey")) % 7).cast("string")).alias("canon"))
    known = t.part.where("p_brand like '%1'").select(F.concat(brand, F.lit(" 3")).alias("alias"), F.concat(F.lit("old-"), F.right(brand, F.lit(1))).alias("slug")).distinct()
    return aliases.reconciled(records, known)


@query("""WITH c AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents), k AS (SELECT (doc_id << 24) + pos AS place, CASE WHEN pos % 9 = 8 THEN ' ' ELSE left(sha256(line), 12) END AS id, CASE WHEN doc_id % 13 = 5 THEN '' ELSE doc_id::VARCHAR END AS doc, CASE WHEN pos % 7 = 6 THEN '  ' ELSE line END AS line FROM c),
f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY place) AS n FROM k), r AS (SELECT *, CASE WHEN trim(id) = '' THEN 'missing chunk_id' WHEN n > 1 THEN 'duplicate chunk_id' WHEN doc = '' THEN 'missing document_id' WHEN trim(line) = '' THEN 'empty text' ELSE '' END AS reason FROM f)
SELECT place, reason, CASE WHEN reason = '' THEN sha256(trim(line)) END AS content_hash, CASE WHEN reason = '' THEN CASE WHEN place % 2 = 0 THEN 'then' ELSE 'now' END END AS created_at FROM r""")
def e18_chunk_validation(t: Tables) -> DataFrame:
    """Lines of documents as chunks, with rows for each reason."""
    c = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    place = F.shiftleft("doc_id", 24) + F.col("pos")
    chunks = c.select(
        place.alias("place"),
        F.when(F.col("pos") % 9 == 8, " ").otherwise(F.left(F.sha2("line", 256), F.lit(12))).alias("chunk_id"),
        F.when(F.col("doc_id") % 13 == 5, "").otherwise(F.col("doc_id").cast("string")).alias("document_id"),
        F.when(F.col("pos") % 7 == 6, "  ").otherwise(F.col("line")).alias("text"),
        F.when(place % 2 == 0, "then").alias("created_at"),
    )
    return gates.checked_chunks(chunks, F.lit("now")).select("place", "reason", "content_hash", "created_at")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O')")
def e19_job_needed(t: Tables) -> DataFrame:
    active = t.lineitem.where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.select("o_orderkey").join(active, "o_orderkey", "left_anti")


@query("""SELECT 'balance' AS rule, count(*) AS n FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'discount', count(*) FROM lineitem WHERE l_discount NOT BETWEEN 0 AND 0.05
UNION ALL SELECT 'one first line', count(*) FROM (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1 GROUP BY l_orderkey HAVING count(*) > 1) UNION ALL SELECT 'unique', count(*) FROM (SELECT o_orderkey FROM orders GROUP BY o_orderkey HAVING count(*) > 1)""")
def e20_constraints(t: Tables) -> DataFrame:
    return merge.violations(
        **{
            "unique": t.orders.groupBy("o_orderkey").count().where("count > 1"),
            "customer": t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"), "left_anti"),
            "balance": t.customer.where("c_acctbal < 0"),
            "discount": t.lineitem.where("l_discount not between 0 and 0.05"),
            "one first line": t.lineitem.where("l_linenumber = 1").groupBy("l_orderkey").count().where("count > 1"),
        }
    )


@query("SELECT p_partkey, coalesce(CASE WHEN p_size > 25 THEN p_brand END, p_type) AS label FROM part")
def e21_coalesced_columns(t: Tables) -> DataFrame:
    legacy = t.part.select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_brand")).alias("new"), F.col("p_type").alias("old"))
    return legacy.withColumn("label", F.coalesce("new", "old")).drop("new", "old")


@query("""WITH k AS (SELECT source, doc_id, lang, ('0x' || left(sha256('seed' || doc_id), 10))::BIGINT AS p FROM documents), a AS (SELECT source, p >> 10 AS p, sha256(string_agg(k.p || chr(0) || doc_id, chr(0) ORDER BY k.p, k.p || chr(0) || doc_id)) AS d FROM k GROUP BY source, k.p >> 10),
b AS (SELECT source, p >> 10 AS p, sha256(string_agg(d, chr(0) ORDER BY a.p)) AS d FROM a GROUP BY source, a.p >> 10), c AS (SELECT source, p >> 10 AS p, sha256(string_agg(d, chr(0) ORDER BY b.p)) AS d FROM b GROUP BY source, b.p >> 10), f AS (SELECT source, left(sha256(string_agg(d, chr(0) ORDER BY p)), 16) AS order_hash FROM c GROUP BY source)
SELECT source, order_hash, invalid FROM f JOIN (SELECT source, count(*) FILTER (WHERE lang NOT IN ('en', 'de', 'fr')) AS invalid FROM documents GROUP BY source) USING (source)""")
def e22_pool_lock(t: Tables) -> DataFrame:
    """A digest of each source's shuffled order, and how many of its rows are not valid."""
    from ..operators.sequences import tree_fingerprint

    place = F.conv(F.left(F.sha2(F.concat(F.lit("seed"), F.col("doc_id").cast("string")), 256), F.lit(10)), 16, 10).cast("long")
    shuffled = t.documents.select("source", place.alias("place"), F.col("doc_id").cast("string").alias("id"))
    invalid = t.documents.groupBy("source").agg(F.count_if(~F.col("lang").isin("en", "de", "fr")).alias("invalid"))
    return tree_fingerprint(shuffled, "source", "place", "id").withColumnRenamed("fingerprint", "order_hash").join(invalid, "source")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events WHERE event_type = 'click'")
def s1_scan(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'click'").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("SELECT l_orderkey, l_linenumber, o_orderpriority FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT'")
def s2_s3_children(t: Tables) -> DataFrame:
    return t.lineitem.join(t.orders.where("o_orderpriority = '1-URGENT'"), F.col("o_orderkey") == F.col("l_orderkey")).select("l_orderkey", "l_linenumber", "o_orderpriority")


@query("SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON p_partkey = l_partkey")
def s4_children_joined(t: Tables) -> DataFrame:
    return t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", "l_linenumber", "p_name")


@query("SELECT doc_id FROM documents WHERE source = 'src0' AND lang IN ('en', 'fr')")
def s5_scroll(t: Tables) -> DataFrame:
    return t.documents.where((F.col("source") == "src0") & F.col("lang").isin("en", "fr")).select("doc_id")


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT page_id * 3 FROM pages)")
def s6_multi_get(t: Tables) -> DataFrame:
    ids = t.pages.select((F.col("page_id") * 3).alias("doc_id"))
    return t.documents.join(ids, "doc_id", "left_semi").select("doc_id", "lang", "source")


@query("SELECT doc_id, lang FROM documents UNION ALL SELECT doc_id, lang FROM documents WHERE false")
def s7_missing_is_empty(t: Tables) -> DataFrame:
    missing = files.read_or_empty(t.spark, f"{t.sf_dir}/no_such_table.parquet", "doc_id long, lang string")
    return t.documents.select("doc_id", "lang").unionByName(missing)


@query("SELECT page_id, url FROM pages WHERE url LIKE 'http%' AND regexp_matches(lower(url), '(\\.html|\\.htm|/[0-9a-z-]*)$')")
def s8_listing(t: Tables) -> DataFrame:
    return files.listed(t.pages.select("page_id", "url"), "url", "", r"\.html|\.htm|/[0-9a-z-]*").where(F.col("url").startswith("http"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, CASE WHEN event_id % 10 = 0 THEN NULL ELSE props END IS NULL AS unreadable FROM events WHERE event_id % 10 <> 0 UNION ALL SELECT event_id, NULL, true FROM events WHERE event_id % 10 = 0")
def s9_json_metadata(t: Tables) -> DataFrame:
    raw = F.when(F.col("event_id") % 10 == 0, F.lit("{broken")).otherwise(F.col("props"))
    parsed = files.json_object(raw)
    return t.events.select("event_id", F.try_variant_get(parsed, "$.k", "string").alias("k"), parsed.isNull().alias("unreadable"))


@query("SELECT count(*) AS n, sum(length(text))::BIGINT AS chars FROM conversations")
def s10_json_lines(t: Tables) -> DataFrame:
    """Written as JSON lines, with a line separator of Unicode inside each record, and read back."""
    rows = t.conversations.select("conv_id", "turn", F.concat(F.lit("a b"), "text").alias("text"))
    back = files.json_lines_round_trip(rows)
    return back.agg(F.count("*").alias("n"), F.sum(F.length("text") - 3).alias("chars"))


@query("WITH c AS (SELECT doc_id, trim(regexp_replace(text, '[\\s\\p{Z}\\p{Cc}]+', ' ', 'g')) AS text FROM documents) SELECT doc_id, length(text)::INTEGER AS chars FROM c WHERE text <> ''")
def s11_corpus(t: Tables) -> DataFrame:
    return files.corpus(t.documents, "doc_id", "text").select("doc_id", F.length("text").alias("chars"))


@query("SELECT count(*) AS labels, count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')) AS unknown FROM labels")
def s12_referential(t: Tables) -> DataFrame:
    held = t.documents.where("lang = 'en'").select("doc_id", F.lit(True).alias("held"))
    return t.labels.join(held, "doc_id", "left").agg(F.count("*").alias("labels"), F.count_if(F.col("held").isNull()).alias("unknown"))


@query("SELECT conv_id, turn, coalesce(d.doc_id, e.doc_id) AS media, CASE WHEN d.doc_id IS NOT NULL THEN 'id' WHEN e.doc_id IS NOT NULL THEN 'index' ELSE 'none' END AS by FROM conversations c LEFT JOIN (SELECT doc_id FROM documents WHERE lang IN ('en', 'de')) d ON d.doc_id = conv_id LEFT JOIN (SELECT doc_id FROM documents WHERE coalesce(lang, '') NOT IN ('en', 'de')) e ON e.doc_id = conv_id * 3 + turn")
def s14_bundle_import(t: Tables) -> DataFrame:
    by_id = t.documents.where(F.col("lang").isin("en", "de")).select(F.col("doc_id").alias("a"))
    by_index = t.documents.where(~F.coalesce("lang", F.lit("")).isin("en", "de")).select(F.col("doc_id").alias("b"))
    rows = t.conversations.join(by_id, F.col("a") == F.col("conv_id"), "left").join(by_index, F.col("b") == F.col("conv_id") * 3 + F.col("turn"), "left")
    return rows.select("conv_id", "turn", F.coalesce("a", "b").alias("media"), F.when(F.col("a").isNotNull(), "id").when(F.col("b").isNotNull(), "index").otherwise("none").alias("by"))


@query("SELECT doc_id, CASE WHEN lang = 'de' THEN 'DE' WHEN lang = 'fr' THEN NULL ELSE lang END AS lang, source FROM documents")
def s17_s19_payload_updates(t: Tables) -> DataFrame:
    rows = merge.updated_where(t.documents.select("doc_id", "lang", "source"), F.col("lang") == "de", {"lang": "DE"})
    return merge.updated_where(rows, F.col("lang") == "fr", {"lang": None})


@query("""WITH p AS (SELECT vec_id, label, lang, source, embedding[1]::DOUBLE AS x FROM embeddings JOIN documents ON doc_id = vec_id), u AS (SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN label + 100 ELSE label END AS label, CASE WHEN vec_id % 5 = 0 THEN 'new' ELSE lang END AS lang, source, CASE WHEN vec_id % 5 = 0 THEN -x ELSE x END AS x FROM p),
s AS (SELECT vec_id, label, lang, CASE WHEN vec_id % 3 = 0 THEN 'by id' ELSE source END AS source, x FROM u)
SELECT vec_id, label, CASE WHEN lang = 'de' THEN 'DE' WHEN lang = 'fr' THEN NULL ELSE lang END AS lang, source, round(x, 6) AS x FROM s WHERE vec_id % 7 <> 0 AND source IS DISTINCT FROM 'src-3'""")
def s16_s20_points_deleted(t: Tables) -> DataFrame:
    """A collection after upserts, payloads set by id and by condition, payloads cleared, and deletes; the last change is repeated."""
    from ..session import shared_folder

    points = Points(t.spark, f"{shared_folder(t.spark)}/lodeworks/points-{uuid.uuid4().hex}", buckets=16)
    held = t.embeddings.join(t.documents, F.col("doc_id") == F.col("vec_id"))
    id_, number = F.col("vec_id").cast("string").alias("id"), F.col("id").cast("long")
    points.upsert(held.select(id_, F.col("embedding").alias("vector"), "label", "lang", "source"), "first")
    turned = F.transform("embedding", lambda x: -x)
    points.upsert(held.where("vec_id % 5 = 0").select(id_, turned.alias("vector"), (F.col("label") + 100).alias("label"), F.lit("new").alias("lang"), "source"), "second")
    points.set_payloads(held.where("vec_id % 3 = 0").select(id_, F.lit("by id").alias("source")), "sources")
    points.set_where(F.col("lang") == "de", {"lang": "DE"}, "german")
    points.set_where(F.col("lang") == "fr", {"lang": None}, "french")
    points.delete(held.where("vec_id % 7 = 0").select(id_), "sevenths")
    for _ in range(2):
        points.delete_where(F.col("source") == "src-3", "source three")
    return points.read().select(number.alias("vec_id"), "label", "lang", "source", F.round(F.col("vector")[0].cast("double"), 6).alias("x"))


@query("WITH s AS (SELECT source, count(*) AS n, min(lang) AS lang FROM documents GROUP BY source) SELECT d.doc_id, s.n, CASE WHEN s.n > 40 THEN s.lang END AS lang FROM documents d JOIN s USING (source)")
def s21_backfill(t: Tables) -> DataFrame:
    s = t.documents.groupBy("source").agg(F.count("*").alias("n"), F.min("lang").alias("lang"))
    return t.documents.select("doc_id", "source").join(s, "source").select("doc_id", "n", F.when(F.col("n") > 40, F.col("lang")).alias("lang"))


@query("WITH a AS (SELECT doc_id, n_chars FROM documents WHERE lang IS DISTINCT FROM 'fr'), b AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents WHERE lang IS DISTINCT FROM 'de') SELECT doc_id, CASE WHEN b.doc_id IS NULL THEN 'upload' WHEN a.doc_id IS NULL THEN 'extra' WHEN a.n_chars <> b.n_chars THEN 'replace' ELSE 'same' END AS action FROM a FULL JOIN b USING (doc_id)")
def s23_sync(t: Tables) -> DataFrame:
    remote = t.documents.where(~F.col("lang").eqNullSafe("de")).select("doc_id", "n_chars").withColumn("n_chars", F.when(F.col("doc_id") % 5 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    return merge.synced(t.documents.where(~F.col("lang").eqNullSafe("fr")).select("doc_id", "n_chars"), remote, "doc_id", "n_chars")


@query("""WITH e AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/' || url WHEN 1 THEN '../' || page_id WHEN 2 THEN 'a/../b' ELSE 'ok/' || page_id END AS path, length(html) AS size FROM pages)
SELECT count(*) FILTER (WHERE path LIKE '/%' OR regexp_matches(path, '(^|/)\\.\\.(/|$)')) AS unsafe, sum(size)::BIGINT AS expanded, sum(size) > 1000000 AS too_large FROM e""")
def s24_archive_safety(t: Tables) -> DataFrame:
    k = F.col("page_id") % 4
    path = F.when(k == 0, F.concat(F.lit("/"), "url")).when(k == 1, F.concat(F.lit("../"), F.col("page_id").cast("string"))).when(k == 2, "a/../b").otherwise(F.concat(F.lit("ok/"), F.col("page_id").cast("string")))
    return files.archive_report(t.pages.select(path.alias("path"), F.length("html").alias("size")), "path", "size", 1_000_000)


@query("SELECT doc_id, lower(text) AS text, lower(source) AS source FROM documents")
def s25_materialised(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.lower("text").alias("text"), F.lower("source").alias("source"))


_QUOTED = "CASE doc_id % 11 WHEN 5 THEN ' ' WHEN 6 THEN 'nowhere to be found' WHEN 7 THEN '»' || replace(substring(text, 3, 50), ' ', ' * ') || '!' WHEN 8 THEN '!!!' ELSE substring(text, 5, 40) END"


@query(f"""WITH r AS (SELECT doc_id, text, doc_id % 11 <> 0 AS has_event, CASE doc_id % 11 WHEN 1 THEN '  ' WHEN 2 THEN '!!!' ELSE source END AS name, CASE doc_id % 11 WHEN 3 THEN 'sure' WHEN 4 THEN '0.59' WHEN 9 THEN NULL ELSE '0.6' END AS confidence, {_QUOTED} AS quote FROM documents)
SELECT doc_id, CASE WHEN NOT has_event THEN 'khong_co_su_kien' WHEN trim(name) = '' THEN 'thieu_ten' WHEN regexp_replace(lower({FOLD('name')}), '[^a-z0-9]', '', 'g') = '' THEN 'ten_khong_tao_duoc_slug' WHEN confidence IS NOT NULL AND try_cast(confidence AS DOUBLE) IS NULL THEN 'do_tin_cay_khong_doc_duoc' WHEN coalesce(try_cast(confidence AS DOUBLE), 0) < 0.6 THEN 'do_tin_cay_thap'
 WHEN trim(quote) = '' THEN 'thieu_trich_dan' WHEN NOT contains(regexp_replace(lower({FOLD('text')}), '[^a-z0-9]', '', 'g'), regexp_replace(lower({FOLD('quote')}), '[^a-z0-9]', '', 'g')) THEN 'trich_dan_khong_co_trong_bai' ELSE '' END AS reason FROM r""")
def f20_gate(t: Tables) -> DataFrame:
    """Events extracted from documents, with rows for each reason and quotes in other letters."""
    k = F.col("doc_id") % 11
    rows = t.documents.select(
        "doc_id",
        "text",
        (k != 0).alias("has_event"),
        F.when(k == 1, "  ").when(k == 2, "!!!").otherwise(F.col("source")).alias("name"),
        F.when(k == 3, "sure").when(k == 4, "0.59").when(k == 9, None).otherwise("0.6").alias("confidence"),
        F.expr(_QUOTED).alias("quote"),
    )
    return rows.select("doc_id", gates.extraction_reason(*[F.col(c) for c in ("has_event", "name", "confidence", "quote", "text")]).alias("reason"))
