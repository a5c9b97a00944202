"""Joins, aggregations, windows, sorts and set operations on ordered records, and changes of stored tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import records as R
from tessera.operators import retrieve as V
from tessera.plans.base import query

Q = F.col


def cents():
    return F.sum(F.round(Q("value") * 100).cast("long"))



@query("SELECT user_id, event_type, count(*) AS calls, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY ALL")
def metrics_by_user_event(t):
    return t("events").groupBy("user_id", "event_type").agg(F.count("*").alias("calls"), cents().alias("cents"))


@query("""
SELECT event_id, user_id, event_type, value, calls, cents FROM events
LEFT JOIN (SELECT user_id, event_type, count(*) AS calls, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY ALL) AS s USING (user_id, event_type)""")
def metrics_join_back(t):
    e = t("events").select("event_id", "user_id", "event_type", "value")
    return e.join(e.groupBy("user_id", "event_type").agg(F.count("*").alias("calls"), cents().alias("cents")), ["user_id", "event_type"], "left")


@query("SELECT count(*) AS calls, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events")
def metrics_total(t):
    return t("events").agg(F.count("*").alias("calls"), cents().alias("cents"))


@query("SELECT DISTINCT user_id, event_type, count(*) OVER (PARTITION BY user_id, event_type) AS calls FROM events")
def metrics_summary_distinct(t):
    return t("events").groupBy("user_id", "event_type").agg(F.count("*").alias("calls")).distinct()


@query("""
SELECT e.event_type, CASE e.event_type WHEN 'click' THEN 'Team' WHEN 'view' THEN 'Collector' END AS parent, count(*) AS n FROM events e GROUP BY ALL""")
def dimension_lookup(t):
    dim = F.create_map(F.lit("click"), F.lit("Team"), F.lit("view"), F.lit("Collector"))
    return t("events").groupBy("event_type").agg(F.count("*").alias("n")).withColumn("parent", F.try_element_at(dim, "event_type"))


@query("SELECT event_type, count(*) AS n FROM events WHERE value < 85 GROUP BY event_type")
def invalid_histogram(t):
    return t("events").where("value < 85").groupBy("event_type").agg(F.count("*").alias("n"))


def host():
    return F.regexp_extract("url", "^https?://([^/?#]*)", 1)

HOSTS = "(SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host FROM pages) AS p"


@query(f"SELECT page_id, host, url FROM {HOSTS} QUALIFY row_number() OVER (PARTITION BY host ORDER BY page_id) = 1")
def dedup_first_by_host(t):
    return R.first_wins(t("pages").select("page_id", host().alias("host"), "url"), ["host"], ["page_id"])


@query("""
SELECT role, conv_id, max(turn) AS turn, max_by(text, turn) AS text, min(turn) AS first_pos FROM conversations GROUP BY role, conv_id""")
def dedup_last_by_role(t):
    return R.last_wins(t("conversations").select("role", "conv_id", "turn", "text"), ["role", "conv_id"], "turn", "text")


@query("SELECT source, text, min(doc_id) AS doc_id FROM documents GROUP BY source, text")
def dedup_processed(t):
    return R.first_wins(t("documents").select("doc_id", "source", "text"), ["source", "text"], ["doc_id"])


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def new_docs_anti(t):
    return R.new_rows(t("documents").select("doc_id", "source"), t("labels"), ["doc_id"])


@query("SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)")
def selected_docs_semi(t):
    return R.selected_rows(t("documents").select("doc_id", "source"), t("labels").where("quality = 1"), ["doc_id"])


@query("""
SELECT CAST(u.page_id AS BIGINT) AS pos, p.host AS host, p.page_id AS page_id FROM pages u JOIN
(SELECT host, max(page_id) AS page_id FROM (SELECT page_id, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host FROM pages) AS x GROUP BY host) AS p ON regexp_extract(u.url, '^https?://([^/?#]*)', 1) = p.host""")
def join_in_list_order(t):
    p = t("pages").select("page_id", host().alias("host"))
    return R.in_list_order(p.select(Q("page_id").alias("pos"), "host"), p, "host", "page_id")


@query("SELECT 'doc' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'passage', item_id, text FROM benchmark UNION ALL SELECT 'turn', conv_id, text FROM conversations")
def union_sources(t):
    return R.union_all(
        t("documents").select(F.lit("doc").alias("kind"), Q("doc_id").alias("id"), "text"), t("benchmark").select(F.lit("passage").alias("kind"), Q("item_id").alias("id"), "text"), t("conversations").select(F.lit("turn").alias("kind"), Q("conv_id").alias("id"), "text")
    )


@query("SELECT DISTINCT text FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark) AS x")
def union_distinct(t):
    return t("documents").select("text").union(t("benchmark").select("text")).distinct()


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def except_keys(t):
    return t("customer").select("c_custkey").subtract(t("orders").select(Q("o_custkey").alias("c_custkey")))


@query("SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders")
def intersect_keys(t):
    return t("customer").select("c_custkey").intersect(t("orders").select(Q("o_custkey").alias("c_custkey")))


@query("""
SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS parts, list_sort(list_distinct(list(l_suppkey))) AS suppliers FROM lineitem GROUP BY l_orderkey""")
def merge_trace(t):
    """Indices of a group: joined in order, and as a sorted set."""
    return t("lineitem").groupBy("l_orderkey").agg(F.array_join(R.ordered_list(F.struct("l_linenumber", "l_partkey"), Q("l_partkey").cast("string")), ",").alias("parts"), F.array_sort(F.collect_set("l_suppkey")).alias("suppliers"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY first) AS ref
FROM (SELECT l_orderkey, l_linenumber, l_partkey, min(l_linenumber * 1000000 + l_partkey) OVER (PARTITION BY l_orderkey, l_partkey) AS first FROM lineitem) AS x""")
def renumber_refs(t):
    """References numbered by first appearance within their report."""
    first = t("lineitem").withColumn("first", F.min(Q("l_linenumber") * F.lit(1000000).cast("long") + Q("l_partkey")).over(W.partitionBy("l_orderkey", "l_partkey")))
    return first.select("l_orderkey", "l_linenumber", "l_partkey", F.dense_rank().over(W.partitionBy("l_orderkey").orderBy("first")).cast("long").alias("ref"))


@query("""
WITH o AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS prev FROM lineitem)
SELECT l_orderkey, CAST(sum(CASE WHEN prev IS DISTINCT FROM l_returnflag THEN 1 ELSE 0 END) AS BIGINT) AS runs, count(*) AS n FROM o GROUP BY l_orderkey""")
def adjacent_dedup(t):
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    o = t("lineitem").withColumn("new", (~Q("l_returnflag").eqNullSafe(F.lag("l_returnflag").over(w))).cast("long"))
    return o.groupBy("l_orderkey").agg(F.sum("new").alias("runs"), F.count("*").alias("n"))


@query("""
WITH o AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY e2) AS island FROM (SELECT o.*, row_number() OVER (PARTITION BY o.user_id ORDER BY e.ts, o.event_id) AS e2 FROM o JOIN events e USING (event_id)) AS x)
SELECT user_id, CAST(island AS BIGINT) AS island, event_type, count(*) AS n_rows FROM i GROUP BY ALL""")
def run_length_merge(t):
    return R.islands(t("events"), ["user_id"], ["ts", "event_id"], "event_type")


@query("""
SELECT conv_id, turn, lag(role) OVER w AS before, lead(role) OVER w AS after, row_number() OVER w - 1 AS idx, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(text) AS BIGINT) AS offset_before
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text)""")
def lag_context(t):
    """Neighbouring sections, running index, and the offset that rewriting the ones before has made."""
    w = W.partitionBy("conv_id").orderBy("turn", "text")
    offset = F.sum(F.length("text")).over(w.rowsBetween(W.unboundedPreceding, 0)) - F.length("text")
    return t("conversations").select("conv_id", "turn", F.lag("role").over(w).alias("before"), F.lead("role").over(w).alias("after"), (F.row_number().over(w) - 1).cast("long").alias("idx"), offset.cast("long").alias("offset_before"))


@query("SELECT source, batch, count(*) AS n, min(doc_id) AS first FROM (SELECT source, doc_id, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 40.0) AS INTEGER) AS batch FROM documents) AS x GROUP BY ALL")
def batches_of_rows(t):
    return R.batch_ids(t("documents").select("source", "doc_id"), ["source"], ["doc_id"], 40).groupBy("source", "batch").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query("""
SELECT r_name, n_name, count(DISTINCT n_nationkey) AS nations, count(c_custkey) AS customers, CAST(grouping(r_name) * 2 + grouping(n_name) AS BIGINT) AS gid
FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ROLLUP (r_name, n_name)""")
def hierarchy_rollup(t):
    per = t("customer").groupBy("c_nationkey").agg(F.count("*").alias("c"))
    n = t("region").join(t("nation"), Q("n_regionkey") == Q("r_regionkey")).join(per, Q("c_nationkey") == Q("n_nationkey"), "left")
    return n.rollup("r_name", "n_name").agg(F.countDistinct("n_nationkey").alias("nations"), F.coalesce(F.sum("c"), F.lit(0)).alias("customers"), F.grouping_id().cast("long").alias("gid"))


@query("SELECT p_partkey, p_brand, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part WHERE p_retailprice >= 1000 QUALIFY rank <= 5")
def topk_per_group(t):
    """The five best of each group over a threshold."""
    return V.ranked(t("part").where("p_retailprice >= 1000").select("p_partkey", "p_brand", "p_retailprice"), ["p_brand"], [F.desc("p_retailprice"), "p_partkey"], 5).withColumn("rank", Q("rank").cast("long"))


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def topk_global(t):
    """The report of the ten best of all."""
    return t("part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(10)


@query("""
WITH s AS (SELECT query_id, label AS kb, vec_id, list_cosine_similarity(q, CAST(embedding AS DOUBLE[])) AS score FROM embeddings, (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 50 = 0) AS x)
SELECT query_id, CAST(kb AS BIGINT) AS kb, vec_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id, kb ORDER BY score DESC, vec_id) AS BIGINT) AS rank FROM s WHERE score >= 0.0 QUALIFY rank <= 5""")
def vector_topk_per_kb(t):
    e = t("embeddings")
    got = V.vector_topk(e.where("vec_id % 50 = 0").select(Q("vec_id").alias("query_id"), "embedding"), e.select("vec_id", "embedding", Q("label").alias("kb")), 5, 0.0)
    return got.withColumn("score", F.round("score", 6)).withColumn("rank", Q("rank").cast("long"))


@query("""
SELECT doc_id, item_id, CAST(strpos(d.text, b.text) - 1 AS BIGINT) AS position FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE b.text <> ''""")
def source_match_exact(t):
    return V.contained(t("documents"), t("benchmark"))


@query("""
WITH m AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS ref FROM documents d JOIN benchmark b ON contains(d.text, b.text))
SELECT item_id, count(*) AS sources, string_agg('[' || CAST(ref AS VARCHAR) || '](doc ' || CAST(doc_id AS VARCHAR) || ')', ' ' ORDER BY ref) AS list FROM m GROUP BY item_id""")
def evidence_references(t):
    """Which documents support each passage, numbered by first appearance: the reference list."""
    m = V.contained(t("documents"), t("benchmark")).withColumn("ref", F.row_number().over(W.partitionBy("item_id").orderBy("doc_id")))
    shown = F.concat(F.lit("["), Q("ref").cast("string"), F.lit("](doc "), Q("doc_id").cast("string"), F.lit(")"))
    return m.groupBy("item_id").agg(F.count("*").alias("sources"), F.array_join(R.ordered_list("ref", shown), " ").alias("list"))


@query("""
SELECT doc_id, len(w) AS n, len(list_intersect(w, ['the', 'of', 'and', 'de', 'la'])) AS common FROM (SELECT doc_id, list_distinct(string_split(lower(text), ' ')) AS w FROM documents) AS x""")
def token_sets(t):
    w = t("documents").select("doc_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n"), F.size(F.array_intersect("w", F.array(*map(F.lit, ["the", "of", "and", "de", "la"])))).cast("long").alias("common"))


@query("""
SELECT c_custkey, c_name, CASE WHEN o_custkey IS NOT NULL THEN 'ordered' ELSE c_mktsegment END AS c_mktsegment FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) AS o ON o_custkey = c_custkey""")
def upsert_rows(t):
    own = t("customer").select("c_custkey", "c_name", "c_mktsegment")
    new = own.join(t("orders").select(Q("o_custkey").alias("c_custkey")).distinct(), "c_custkey", "left_semi").withColumn("c_mktsegment", F.lit("ordered"))
    return R.upsert(own, new, ["c_custkey"], ["c_name", "c_mktsegment"])


@query("SELECT s_suppkey, s_name, CASE WHEN s_acctbal < 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def patch_rows(t):
    own = t("supplier").select("s_suppkey", "s_name", "s_acctbal")
    return R.patch(own, own.where("s_acctbal < 0").select("s_suppkey", F.lit(None).cast("string").alias("s_name"), F.lit(0.0).alias("s_acctbal")), ["s_suppkey"], ["s_name", "s_acctbal"])


@query("SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey + 1000, r_name FROM region")
def insert_absent(t):
    base = t("nation").select(Q("n_nationkey").alias("k"), Q("n_name").alias("name"))
    return R.insert_absent(base, base.union(t("region").select(Q("r_regionkey") + 1000, "r_name")), ["k"])


@query("SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_rows(t):
    return t("documents").select("doc_id", "text").join(t("labels").where("toxic = 1").select("doc_id"), "doc_id", "left_anti")


@query("""
SELECT o_orderkey, CAST(len(items) AS BIGINT) AS n, items[1].l_partkey AS first, list_max(list_transform(items, lambda x: x.l_linenumber)) AS last FROM
(SELECT l_orderkey AS o_orderkey, list({'l_linenumber': l_linenumber, 'l_partkey': l_partkey} ORDER BY l_linenumber, l_partkey) AS items FROM lineitem GROUP BY l_orderkey) AS x""")
def nest_children(t):
    n = t("lineitem").groupBy(Q("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("items"))
    return n.select("o_orderkey", F.size("items").cast("long").alias("n"), F.get("items", F.lit(0))["l_partkey"].alias("first"), F.array_max(F.transform("items", lambda x: x["l_linenumber"])).alias("last"))


@query("SELECT o_orderkey, o_orderpriority, l_linenumber, l_partkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey")
def flatten_nested(t):
    n = t("lineitem").groupBy(Q("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct("l_linenumber", "l_partkey")).alias("items"))
    return t("orders").select("o_orderkey", "o_orderpriority").join(n, "o_orderkey", "left").select("o_orderkey", "o_orderpriority", F.explode_outer("items").alias("i")).select("o_orderkey", "o_orderpriority", "i.*")


@query("""
SELECT o_orderkey, min(l_extendedprice) AS low, max(l_extendedprice) AS high, max(l_extendedprice) - min(l_extendedprice) AS width, count(DISTINCT l_extendedprice) >= 3 AS varied
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def value_range(t):
    n = R.parts_of(t("lineitem"))
    lines, orders = t("lineitem").select("l_orderkey", "l_extendedprice").repartition(n, "l_orderkey"), t("orders").select("o_orderkey").repartition(n, "o_orderkey")
    g = lines.join(orders, Q("l_orderkey") == Q("o_orderkey"), "left_semi").groupBy(Q("l_orderkey").alias("o_orderkey"))
    return g.agg(F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"), (F.max("l_extendedprice") - F.min("l_extendedprice")).alias("width"), (F.countDistinct("l_extendedprice") >= 3).alias("varied"))
