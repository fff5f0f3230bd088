"""Joins, aggregations and set operations over the order tables, events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .registry import Tables, query


@query("""WITH s AS (SELECT o_custkey, n_name, o_orderpriority = '1-URGENT' AS p FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
g AS (SELECT l_orderkey, count(DISTINCT p_brand) AS n, min(p_brand) AS one, min(p_brand) FILTER (WHERE l_linenumber = 1 AND l_returnflag = 'R') AS primary_brand FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN primary_brand IS NOT NULL THEN primary_brand WHEN n = 1 THEN one END AS brand FROM g""")
def j1_primary_or_only(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    primary = F.min(F.when((F.col("l_linenumber") == 1) & (F.col("l_returnflag") == "R"), F.col("p_brand")))
    g = rows.groupBy("l_orderkey").agg(F.countDistinct("p_brand").alias("n"), F.min("p_brand").alias("one"), primary.alias("primary"))
    return g.select("l_orderkey", F.when(F.col("primary").isNotNull(), F.col("primary")).when(F.col("n") == 1, F.col("one")).alias("brand"))


@query("SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def j2_dimensions(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    return rows.select("o_orderkey", "c_name", "n_name", "r_name")


@query("SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE year(o_orderdate) = 1995 AND c_mktsegment = 'BUILDING' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def j3_j4_pending(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).where((F.year("o_orderdate") == 1995) & (F.col("c_mktsegment") == "BUILDING"))
    done = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return rows.select("o_orderkey").join(done, "o_orderkey", "left_anti")


@query("SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)")
def j5_skip_known(t: Tables) -> DataFrame:
    return t.part.join(t.lineitem.where("l_quantity > 49"), F.col("l_partkey") == F.col("p_partkey"), "left_anti").select("p_partkey", "p_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def j6_orphans(t: Tables) -> DataFrame:
    return t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@query("""SELECT d.doc_id, d.lang, l.quality, l.toxic, coalesce(c.turns, 0) AS turns, coalesce(b.text, '') <> '' AS has_item FROM documents d LEFT JOIN labels l USING (doc_id)
LEFT JOIN (SELECT conv_id AS doc_id, count(*) AS turns FROM conversations GROUP BY conv_id) c USING (doc_id) LEFT JOIN (SELECT item_id AS doc_id, text FROM benchmark) b USING (doc_id)""")
def j7_j8_enriched(t: Tables) -> DataFrame:
    turns = t.conversations.groupBy(F.col("conv_id").alias("doc_id")).agg(F.count("*").alias("turns"))
    items = t.benchmark.select(F.col("item_id").alias("doc_id"), F.col("text").alias("item"))
    rows = t.documents.join(t.labels, "doc_id", "left").join(turns, "doc_id", "left").join(items, "doc_id", "left")
    return rows.select("doc_id", "lang", "quality", "toxic", F.coalesce("turns", F.lit(0)).alias("turns"), (F.coalesce("item", F.lit("")) != "").alias("has_item"))


@query("""SELECT count(*) AS lines, count(o_orderkey) AS found, count(*) - count(o_orderkey) AS no_order, count(c_custkey) AS customers, count(*) FILTER (WHERE o_orderkey IS NOT NULL AND c_custkey IS NULL) AS no_customer
FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') o ON o_orderkey = l_orderkey LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON c_custkey = o_custkey""")
def j12_two_hops(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders.where("o_orderstatus <> 'P'"), F.col("o_orderkey") == F.col("l_orderkey"), "left").join(t.customer.where("c_acctbal > 0"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.agg(F.count("*").alias("lines"), F.count("o_orderkey").alias("found"), (F.count("*") - F.count("o_orderkey")).alias("no_order"), F.count("c_custkey").alias("customers"), F.count_if(F.col("o_orderkey").isNotNull() & F.col("c_custkey").isNull()).alias("no_customer"))


@query("""WITH a AS (SELECT lower(p_name) AS alias, p_partkey, CASE WHEN p_size % 2 = 0 THEN p_partkey END AS series, CASE WHEN p_size % 2 = 1 THEN p_partkey END AS occurrence FROM part),
o AS (SELECT l_partkey, min(l_suppkey) AS series FROM lineitem GROUP BY l_partkey) SELECT a.p_partkey, a.alias, coalesce(a.series, o.series) AS series FROM a LEFT JOIN o ON o.l_partkey = a.occurrence""")
def j13_alias_hop(t: Tables) -> DataFrame:
    """An alias names its series, or an occurrence that leads to one."""
    odd = F.col("p_size") % 2 == 1
    aliases = t.part.select("p_partkey", F.lower("p_name").alias("alias"), F.when(~odd, F.col("p_partkey")).alias("own"), F.when(odd, F.col("p_partkey")).alias("l_partkey"))
    hop = t.lineitem.groupBy("l_partkey").agg(F.min("l_suppkey").alias("hop"))
    return aliases.join(hop, "l_partkey", "left").select("p_partkey", "alias", F.coalesce("own", "hop").alias("series"))


@query("SELECT count(*) AS missing FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def j16_references(t: Tables) -> DataFrame:
    return t.lineitem.join(t.supplier.where("s_acctbal > 0"), F.col("s_suppkey") == F.col("l_suppkey"), "left_anti").agg(F.count("*").alias("missing"))


@query("SELECT a.user_id, count(*) AS compared, count(*) FILTER (WHERE a.event_type = b.event_type) AS same FROM events a JOIN events b ON b.event_id = a.event_id + 1 AND b.user_id = a.user_id GROUP BY a.user_id")
def j17_consistency(t: Tables) -> DataFrame:
    later = t.events.select((F.col("event_id") - 1).alias("event_id"), "user_id", F.col("event_type").alias("again"))
    return t.events.join(later, ["event_id", "user_id"]).groupBy("user_id").agg(F.count("*").alias("compared"), F.count_if(F.col("event_type") == F.col("again")).alias("same"))


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem WHERE (l_partkey, l_suppkey) NOT IN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY l_partkey, l_suppkey")
def j18_exists_by_pair(t: Tables) -> DataFrame:
    held = t.lineitem.where("l_returnflag = 'R'").select("l_partkey", "l_suppkey")
    return t.lineitem.join(held, ["l_partkey", "l_suppkey"], "left_anti").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))


@query("""SELECT e.event_id, coalesce(a.c_custkey, b.c_custkey) AS reused FROM events e LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) a ON a.c_custkey = e.user_id LEFT JOIN (SELECT c_nationkey, min(c_custkey) AS c_custkey FROM customer GROUP BY c_nationkey) b ON b.c_nationkey = e.user_id % 25""")
def j19_reuse_by_either(t: Tables) -> DataFrame:
    """Two equality joins and the first hit, in place of one join on either."""
    by_id = t.customer.where(F.col("c_custkey") % 2 == 0).select(F.col("c_custkey").alias("user_id"), F.col("c_custkey").alias("a"))
    by_nation = t.customer.groupBy("c_nationkey").agg(F.min("c_custkey").alias("b"))
    rows = t.events.join(by_id, "user_id", "left").join(by_nation, F.col("c_nationkey") == F.col("user_id") % 25, "left")
    return rows.select("event_id", F.coalesce("a", "b").alias("reused"))


@query("SELECT p.page_id, p.url, d.lang, d.source FROM pages p LEFT JOIN documents d ON d.doc_id = p.page_id * 7")
def j20_tolerant_lookup(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "lang", "source")
    return t.pages.join(docs, F.col("doc_id") == F.col("page_id") * 7, "left").select("page_id", "url", "lang", "source")


@query("SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_name LIKE 'Supplier%' AND n_regionkey = 2")
def j21_composite_lookup(t: Tables) -> DataFrame:
    nations = t.nation.where("n_regionkey = 2").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return t.supplier.where(F.col("s_name").startswith("Supplier")).join(nations, "s_nationkey").select("s_suppkey", "s_name", "n_name")


@query("SELECT coalesce(event_type, 'total') AS event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ROLLUP (event_type)")
def a1_by_type(t: Tables) -> DataFrame:
    rows = t.events.rollup("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
    return rows.withColumn("event_type", F.coalesce("event_type", F.lit("total")))


@query("SELECT count(DISTINCT nullif(source, '')) AS sources, count(DISTINCT nullif(lang, '')) AS langs, count(*) FILTER (WHERE lang = 'en') AS english FROM documents")
def a2_a3_distinct(t: Tables) -> DataFrame:
    return t.documents.agg(F.countDistinct(F.nullif("source", F.lit(""))).alias("sources"), F.countDistinct(F.nullif("lang", F.lit(""))).alias("langs"), F.count_if(F.col("lang") == "en").alias("english"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def a4_per_key(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT l_orderkey, l_returnflag AS label, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_orderkey, string_agg(label || '=' || n, ',' ORDER BY label) AS histogram, string_agg(label || ' x' || n, ', ' ORDER BY n DESC, label) AS prompt FROM c GROUP BY l_orderkey""")
def a7_a31_label_counts(t: Tables) -> DataFrame:
    from ..operators.census import label_counts

    return label_counts(t.lineitem, "l_orderkey", "l_returnflag")


@query("""WITH k AS (SELECT unnest(['click', 'error', 'purchase', 'refund', 'signup', 'view']) AS reason) SELECT reason, count(event_id) AS n FROM k LEFT JOIN events ON event_type = reason GROUP BY reason""")
def a8_zero_filled(t: Tables) -> DataFrame:
    from ..operators.census import zero_filled

    return zero_filled(t.events, "event_type", ["click", "error", "purchase", "refund", "signup", "view"], "reason")


@query("""SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE role = 'user') AS asked, sum(length(text))::BIGINT AS chars, string_agg(role, ' ' ORDER BY turn, text) AS roles, bool_or(length(text) < 20) AS has_short FROM conversations GROUP BY conv_id""")
def a9_summary(t: Tables) -> DataFrame:
    c = t.conversations
    roles = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text", "role"))), lambda x: x["role"]), " ")
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("asked"), F.sum(F.length("text")).alias("chars"), roles.alias("roles"), F.bool_or(F.length("text") < 20).alias("has_short"))


@query("""WITH p AS (SELECT source, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang <> 'en') AS other, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source)
SELECT count(*) AS sources, count(*) FILTER (WHERE en > 0) AS with_en, count(*) FILTER (WHERE other > 0) AS with_other, sum(en)::BIGINT AS en, sum(other)::BIGINT AS other, sum(chars)::BIGINT AS chars FROM p""")
def a10_census(t: Tables) -> DataFrame:
    per = t.documents.groupBy("source").agg(F.count_if(F.col("lang") == "en").alias("en"), F.count_if(F.col("lang") != "en").alias("other"), F.sum("n_chars").alias("chars"))
    return per.agg(F.count("*").alias("sources"), F.count_if(F.col("en") > 0).alias("with_en"), F.count_if(F.col("other") > 0).alias("with_other"), F.sum("en").alias("en"), F.sum("other").alias("other"), F.sum("chars").alias("chars"))


@query("""WITH g AS (SELECT sha256(text) AS h, count(*) AS n FROM documents GROUP BY 1), m AS (SELECT md5(text) AS h, count(*) AS n FROM documents GROUP BY 1)
SELECT (SELECT count(*) FROM g WHERE n > 1) AS groups, (SELECT coalesce(sum(n), 0) FROM g WHERE n > 1)::BIGINT AS files, (SELECT coalesce(sum(n - 1), 0) FROM g WHERE n > 1)::BIGINT AS surplus, (SELECT count(*) FROM g WHERE n > 1) = (SELECT count(*) FROM m WHERE n > 1) AS agree""")
def a11_u5_duplicates(t: Tables) -> DataFrame:
    from ..operators.census import duplicate_report

    return duplicate_report(t.documents, F.sha2("text", 256), F.md5("text"))


@query("""WITH d AS (SELECT text, count(*) AS n, count(DISTINCT lang) AS langs, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY text) SELECT n, langs, first_id, last_id FROM d WHERE n > 1""")
def a12_conflicts(t: Tables) -> DataFrame:
    g = t.documents.groupBy("text").agg(F.count("*").alias("n"), F.countDistinct("lang").alias("langs"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    return g.where("n > 1").drop("text")


@query("SELECT n, count(*) AS orders FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) GROUP BY n")
def a13_distribution(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("orders"))


@query("""SELECT source, list_sort(list(n_chars))[len(list(n_chars)) // 2 + 1] AS upper_median, max(n_chars) AS longest, round(avg(CASE WHEN n_chars <= 512 THEN 1.0 ELSE 0 END), 6) AS share_short FROM documents GROUP BY source""")
def a14_upper_median(t: Tables) -> DataFrame:
    """By counts of lengths: a source's rows meet as its distinct lengths, however many they are."""
    sizes = t.documents.groupBy("source", "n_chars").agg(F.count("*").alias("k"))
    w = Window.partitionBy("source")
    upto = sizes.withColumn("upto", F.sum("k").over(w.orderBy("n_chars"))).withColumn("n", F.sum("k").over(w))
    middle = F.min(F.when(F.col("upto") >= F.floor(F.col("n") / 2) + 1, F.col("n_chars")))
    share = F.round(F.sum(F.when(F.col("n_chars") <= 512, F.col("k")).otherwise(0)) / F.sum("k"), 6)
    return upto.groupBy("source").agg(middle.alias("upper_median"), F.max("n_chars").alias("longest"), share.alias("share_short"))


@query("""SELECT event_type, quantile_disc(value, 0.95) AS p95, round(avg(value), 6) AS mean, max(value) AS high FROM events WHERE event_type <> 'error' GROUP BY event_type""")
def a15_a16_latency(t: Tables) -> DataFrame:
    from ..operators.sequences import quantiles

    rows = t.events.where("event_type <> 'error'")
    rest = rows.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("high"))
    return quantiles(rows, "event_type", "value", 0.95, "p95").join(rest, "event_type")


@query("""WITH f AS (SELECT p_type, count(*) AS n FROM part GROUP BY p_type) SELECT split_part(p_type, ' ', 1) AS cluster, count(*) AS names, sum(n)::BIGINT AS weight FROM f GROUP BY 1""")
def a20_cluster_weights(t: Tables) -> DataFrame:
    return t.part.groupBy("p_type").agg(F.count("*").alias("n")).groupBy(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("cluster")).agg(F.count("*").alias("names"), F.sum("n").alias("weight"))


@query("""WITH c AS (SELECT user_id, ts::DATE AS day, list_distinct(list(event_type)) AS tools, count(*) AS calls FROM events GROUP BY ALL)
SELECT user_id, count(*) AS days, round(avg(CASE WHEN list_has_all(tools, ['click', 'view']) THEN 1.0 ELSE 0 END), 6) AS right_share, round(avg(CASE WHEN len(tools) = calls THEN 1.0 ELSE 0 END), 6) AS tidy, sum(calls)::BIGINT AS calls, max(calls) AS most, sum(calls - len(tools))::BIGINT AS waste FROM c GROUP BY user_id""")
def a21_u6_routing(t: Tables) -> DataFrame:
    days = t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.collect_set("event_type").alias("tools"), F.count("*").alias("calls"))
    right = F.size(F.array_except(F.array(F.lit("click"), F.lit("view")), "tools")) == 0
    return days.groupBy("user_id").agg(
        F.count("*").alias("days"),
        F.round(F.avg(F.when(right, 1.0).otherwise(0.0)), 6).alias("right_share"),
        F.round(F.avg(F.when(F.size("tools") == F.col("calls"), 1.0).otherwise(0.0)), 6).alias("tidy"),
        F.sum("calls").alias("calls"),
        F.max("calls").alias("most"),
        F.sum(F.col("calls") - F.size("tools")).alias("waste"),
    )


@query("""SELECT round(coalesce(count(*) FILTER (WHERE toxic = 0) / nullif(count(*), 0), 0), 6) AS clean, round(coalesce(count(*) FILTER (WHERE quality = 1 AND toxic = 0) / nullif(count(*) FILTER (WHERE quality = 1), 0), 0), 6) AS clean_good, round(coalesce(count(*) FILTER (WHERE quality = 9) / nullif(count(*) FILTER (WHERE quality = 8), 0), 0), 6) AS none FROM labels""")
def a22_ratios(t: Tables) -> DataFrame:
    def ratio(a, b):
        return F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)

    q, x = F.col("quality"), F.col("toxic")
    return t.labels.agg(ratio(F.count_if(x == 0), F.count("*")).alias("clean"), ratio(F.count_if((q == 1) & (x == 0)), F.count_if(q == 1)).alias("clean_good"), ratio(F.count_if(q == 9), F.count_if(q == 8)).alias("none"))


@query("""SELECT user_id, ts::DATE::VARCHAR AS day, CASE WHEN bool_or(event_type = 'error') THEN 'partial' WHEN bool_and(event_type = 'view') THEN 'skipped' ELSE 'success' END AS status, bool_or(event_type = 'purchase') AS bought FROM events GROUP BY 1, 2""")
def a25_a26_status_fold(t: Tables) -> DataFrame:
    e = F.col("event_type")
    return t.events.groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.when(F.bool_or(e == "error"), "partial").when(F.bool_and(e == "view"), "skipped").otherwise("success").alias("status"), F.bool_or(e == "purchase").alias("bought"))


@query("""WITH p AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, sum(n)::BIGINT AS total, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS merged FROM p GROUP BY user_id""")
def a27_a30_merged_counters(t: Tables) -> DataFrame:
    from ..operators.census import merged_counters

    parts = t.events.select("user_id", F.create_map("event_type", F.lit(1)).alias("c"))
    return merged_counters(parts, "user_id", "c")


@query("""SELECT vec_id, round(list_min(embedding[1:8]), 6)::DOUBLE AS x1, round(list_max(embedding[1:8]), 6)::DOUBLE AS x2, round(list_min(embedding[9:16]), 6)::DOUBLE AS y1, round(list_max(embedding[9:16]), 6)::DOUBLE AS y2 FROM (SELECT vec_id, embedding::DOUBLE[] AS embedding FROM embeddings)""")
def a28_bounding_box(t: Tables) -> DataFrame:
    from ..operators.census import bounding_box

    e = F.col("embedding").cast("array<double>")
    box = bounding_box(F.zip_with(F.slice(e, 1, 8), F.slice(e, 9, 8), lambda x, y: F.struct(x.alias("x"), y.alias("y"))))
    return t.embeddings.select("vec_id", box.alias("b")).select("vec_id", *[F.round(f"b.{c}", 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'supplier', count(*) FROM supplier")
def a29_table_counts(t: Tables) -> DataFrame:
    from ..operators.merge import violations

    return violations(customer=t.customer, orders=t.orders, part=t.part, supplier=t.supplier).withColumnRenamed("rule", "name")


@query("""WITH g AS (SELECT lang, round(avg(n_chars), 3) AS mean, count(*) AS n FROM documents GROUP BY lang) SELECT string_agg(lang || '=' || n, ',' ORDER BY lang) AS categories, CASE WHEN sum(n) <= 5 THEN 'recall says nothing' END AS warning FROM g""")
def a32_envelope(t: Tables) -> DataFrame:
    g = t.documents.groupBy("lang").agg(F.count("*").alias("n"))
    return g.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lang", "n"))), lambda x: F.concat_ws("=", x["lang"], x["n"].cast("string"))), ",").alias("categories"), F.when(F.sum("n") <= 5, "recall says nothing").alias("warning"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n FROM orders")
def o1_ordered(t: Tables) -> DataFrame:
    from ..operators.sequences import global_rank

    return global_rank(t.orders.select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"], "n").select("o_orderkey", "n")


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer")
def o2_score_then_id(t: Tables) -> DataFrame:
    from ..operators.sequences import global_rank

    return global_rank(t.customer.select((-F.col("c_acctbal")).alias("minus"), "c_custkey"), ["minus", "c_custkey"], "n").select("c_custkey", "n")


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_orderkey % 2 = 0 THEN epoch(l_shipdate) ELSE l_linenumber END, l_linenumber) AS n FROM lineitem")
def o3_order_by_policy(t: Tables) -> DataFrame:
    by = F.when(F.col("l_orderkey") % 2 == 0, F.unix_timestamp(F.col("l_shipdate").cast("timestamp"))).otherwise(F.col("l_linenumber"))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(by, "l_linenumber")).cast("long").alias("n"))


@query("SELECT p_partkey, ((row_number() OVER (ORDER BY lower(p_name), p_partkey) - 1) // 40)::BIGINT AS batch FROM part")
def o4_batches(t: Tables) -> DataFrame:
    from ..functions.text import fold
    from ..operators.sequences import global_rank

    ranked = global_rank(t.part.select(F.lower(fold(F.col("p_name"))).alias("key"), "p_partkey"), ["key", "p_partkey"], "n")
    return ranked.select("p_partkey", F.floor((F.col("n") - 1) / 40).alias("batch"))


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def u2_difference(t: Tables) -> DataFrame:
    keys = t.orders.select("o_custkey", "o_orderstatus")
    return keys.where("o_orderstatus = 'F'").select("o_custkey").subtract(keys.where("o_orderstatus = 'O'").select("o_custkey"))


@query("""SELECT a.doc_id, len(list_intersect(list_distinct(string_split(a.text, ' ')), list_distinct(string_split(b.text, ' '))))::INTEGER AS shared FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1""")
def u4_shared_terms(t: Tables) -> DataFrame:
    words = F.array_distinct(F.split("text", " "))
    a, b = t.documents.select("doc_id", words.alias("a")), t.documents.select((F.col("doc_id") - 1).alias("doc_id"), words.alias("b"))
    return a.join(b, "doc_id").select("doc_id", F.size(F.array_intersect("a", "b")).alias("shared"))


@query("""WITH w AS (SELECT conv_id, list(role ORDER BY turn, text) AS r FROM conversations GROUP BY conv_id) SELECT conv_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(r), lambda x: {'i': list_position(r, x), 'x': x})), lambda y: y.x), ',') AS roles FROM w""")
def u7_ordered_distinct(t: Tables) -> DataFrame:
    first = t.conversations.groupBy("conv_id", "role").agg(F.min(F.struct("turn", "text")).alias("first"))
    held = first.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("first.turn", "first.text", "role"))).alias("r"))
    return held.select("conv_id", F.array_join(F.transform("r", lambda x: x["role"]), ",").alias("roles"))
