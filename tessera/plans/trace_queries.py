"""Tracing, evidence, scored replies, outlines from arguments, ordering of report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import charts as C
from tessera.operators import replies as R
from tessera.operators import trace as T
from tessera.plans.base import query

Q = F.col


def marked_reports(t):
    """A report for each order: its items as sentences with citation markers."""
    part = F.format_string("Part %d came. [citation:%d] ", "l_partkey", Q("l_linenumber"))
    at = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    return t("lineitem").groupBy(Q("l_orderkey").alias("doc_id")).agg(F.array_join(T.ordered_list(at, part), "").alias("text"))


PIECES = """
WITH i AS (SELECT l_orderkey AS doc_id, l_linenumber AS x, l_partkey AS p, l_suppkey AS s, 'Part ' || l_partkey || ' came. ' AS a, '[citation:' || l_linenumber || ']' AS m, row_number() OVER w - 1 AS n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)),
q AS (SELECT *, sum(length(a) + length(m) + 1) OVER (PARTITION BY doc_id ORDER BY n) - 1 AS fin FROM i)"""


@query("SELECT l_orderkey AS doc_id, l_suppkey % 7 AS \"index\", arg_min(l_partkey, l_linenumber * 10000000 + l_partkey) AS title, string_agg(CAST(l_partkey AS VARCHAR), '' ORDER BY l_linenumber, l_partkey) AS content FROM lineitem WHERE l_suppkey % 7 <> 0 GROUP BY 1, 2")
def citation_mapping(t):
    c = t("lineitem").select(Q("l_orderkey").alias("doc_id"), F.struct("l_linenumber", "l_partkey").alias("pos"), (Q("l_suppkey") % 7).alias("index"), Q("l_partkey").alias("title"), F.lit("u").alias("url"), Q("l_partkey").cast("string").alias("content"))
    return T.citation_mapping(c).select("doc_id", "index", "title", "content")


@query(PIECES + " SELECT doc_id, CAST(n AS BIGINT) AS n, CAST(x AS BIGINT) AS \"index\", CAST(fin - length(m) AS BIGINT) AS start, CAST(fin AS BIGINT) AS \"end\" FROM q")
def citation_markers(t):
    return T.markers(marked_reports(t)).select("doc_id", Q("n").cast("long").alias("n"), Q("index").cast("long").alias("index"), Q("start").cast("long").alias("start"), Q("end").cast("long").alias("end"))


@query(PIECES + " SELECT doc_id, CAST(n AS BIGINT) AS n, CAST(fin - length(m) - coalesce(sum(length(m) - 3) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS new_start FROM q")
def moved_markers(t):
    spans = T.markers(marked_reports(t)).withColumn("replacement", F.lit("[x]"))
    return T.moved(spans).select("doc_id", Q("n").cast("long").alias("n"), Q("new_start").cast("long").alias("new_start"))


@query(PIECES + ", k AS (SELECT doc_id, x, list(p ORDER BY n)[1] AS title FROM q GROUP BY ALL) SELECT doc_id, CAST(n AS BIGINT) AS n, k.title, CASE WHEN n = 0 THEN rtrim(a) ELSE rtrim(a) END AS chunk FROM q JOIN k USING (doc_id, x)")
def origin_citations(t):
    """Markers with their source and the sentence they stand for (one of its own, as . ends none, after the last marker)."""
    at = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    c = t("lineitem").select(Q("l_orderkey").alias("doc_id"), at.alias("pos"), Q("l_linenumber").alias("index"), Q("l_partkey").alias("title"), F.lit("u").alias("url"), F.lit("c").alias("content"))
    out = T.origin_citations(marked_reports(t), c)
    last = F.regexp_extract("chunk", "(Part \\d+ came\\.)$", 1)
    return out.select("doc_id", Q("n").cast("long").alias("n"), "title", last.alias("chunk"))


@query("""
WITH x AS (SELECT o_orderkey AS doc_id, unnest([0, 2, 40, 1]) AS idx, unnest([0, 1, 2, 3]) AS pos FROM orders),
s AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS idx, l_partkey, CASE WHEN l_returnflag = 'R' THEN '' ELSE 't' || l_partkey END AS title FROM lineitem)
SELECT doc_id, pos, title FROM x JOIN s USING (doc_id, idx) WHERE title <> ''""")
def traced_sources(t):
    w = T.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    title = F.when(Q("l_returnflag") == "R", "").otherwise(F.concat(F.lit("t"), "l_partkey"))
    s = t("lineitem").select(Q("l_orderkey").alias("doc_id"), F.lit("web").alias("source"), (F.row_number().over(w) - 1).alias("idx"), title.alias("title"), F.lit("u").alias("url"), F.lit("c").alias("content"))
    x = t("orders").select(Q("o_orderkey").alias("doc_id"), F.lit("s").alias("sentence"), F.lit("web").alias("source"), F.array(*map(F.lit, (0, 2, 40, 1))).alias("indices"))
    return T.traced_rows(x, s).select("doc_id", "pos", "title")


@query("""
WITH r AS (SELECT o_orderkey AS doc_id, o_orderstatus || '/' || o_orderpriority AS text FROM orders),
b AS (SELECT o_orderkey AS doc_id, 0 AS kind, 0 AS pos, o_orderpriority AS chunk FROM orders UNION ALL SELECT o_orderkey, 1, 0, 'F' FROM orders UNION ALL SELECT o_orderkey, 1, 1, o_orderpriority FROM orders)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY instr(text, chunk), kind, pos) AS BIGINT) AS rank, CAST(instr(text, chunk) - 1 AS BIGINT) AS position, kind, pos FROM b JOIN r USING (doc_id) WHERE instr(text, chunk) > 0""")
def merged_citations(t):
    o = t("orders")
    reports = o.select(Q("o_orderkey").alias("doc_id"), F.concat("o_orderstatus", F.lit("/"), "o_orderpriority").alias("text"))
    rows = lambda pos, chunk: o.select(Q("o_orderkey").alias("doc_id"), F.lit(pos).alias("pos"), chunk.alias("chunk"), F.lit("u").alias("url"))
    out = T.merged_citations(rows(0, Q("o_orderpriority")), rows(0, F.lit("F")).unionByName(rows(1, Q("o_orderpriority"))), reports)
    return out.select("doc_id", Q("rank").cast("long").alias("rank"), Q("position").cast("long").alias("position"), "kind", "pos")


@query("""
WITH l AS (SELECT s_suppkey, s_name, s_nationkey FROM supplier)
SELECT s_nationkey AS doc_id, string_agg(s_name || CASE WHEN s_suppkey % 2 = 0 THEN '[a][b]' ELSE '' END || '。', '' ORDER BY s_suppkey) AS text FROM l GROUP BY s_nationkey""")
def insert_references(t):
    s = t("supplier")
    reports = s.groupBy(Q("s_nationkey").alias("doc_id")).agg(F.array_join(T.ordered_list("s_suppkey", F.concat("s_name", F.lit("。"))), "").alias("text"))
    even = s.where("s_suppkey % 2 = 0")
    rows = lambda pos, link: even.select(Q("s_nationkey").alias("doc_id"), F.lit(pos).alias("pos"), F.concat("s_name", F.lit("。")).alias("sentence"), F.lit(link).alias("link"))
    return T.with_references(reports, rows(2, "[b]").unionByName(rows(1, "[a]")))


@query("SELECT o_custkey AS doc_id, string_agg('[citation:' || n || ' begin]' || o_orderstatus || '[citation:' || n || ' end]', chr(10) ORDER BY n) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) GROUP BY o_custkey")
def evidence_lines(t):
    n = F.row_number().over(T.Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = t("orders").withColumn("n", n)
    return rows.groupBy(Q("o_custkey").alias("doc_id")).agg(F.array_join(T.ordered_list("n", T.evidence(Q("n"), Q("o_orderstatus"))), "\n").alias("lines"))


@query("""
WITH m AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos, role, text FROM conversations)
SELECT conv_id AS doc_id, md5(CASE WHEN count(*) = 1 THEN max(text) ELSE coalesce(string_agg('User: ' || coalesce(text, 'None') || chr(10), '' ORDER BY pos) FILTER (role = 'user'), '') END) AS record FROM m GROUP BY conv_id""")
def research_record(t):
    pos = F.row_number().over(T.Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = t("conversations").select(Q("conv_id").alias("doc_id"), pos.alias("pos"), "role", Q("text").alias("content"))
    return T.research_record(rows).select("doc_id", F.md5(Q("record").cast("binary")).alias("record"))


@query("SELECT n_regionkey AS doc_id, 'R' || n_regionkey || chr(10) || chr(10) || string_agg(n_name, chr(10) || chr(10) ORDER BY n_nationkey) || chr(10) || chr(10) || 'end' AS report FROM nation GROUP BY n_regionkey")
def assembled_report(t):
    n = t("nation")
    title = n.select(Q("n_regionkey").alias("doc_id"), F.lit("title").alias("kind"), F.lit(0).alias("section"), F.concat(F.lit("R"), "n_regionkey").alias("text")).distinct()
    rest = title.withColumn("kind", F.lit("conclusion")).withColumn("text", F.lit("end")).unionByName(title.withColumn("kind", F.lit("abstract")).withColumn("text", F.lit(" ")))
    return T.assembled(rest.unionByName(n.select(Q("n_regionkey").alias("doc_id"), F.lit("section").alias("kind"), Q("n_nationkey").alias("section"), Q("n_name").alias("text"))).unionByName(title))


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 10")
def converged_top_documents(t):
    rows = t("orders").select("o_custkey", "o_orderkey", Q("o_totalprice").alias("score"), Q("o_orderkey").alias("pos"))
    return T.top_documents(rows, ["o_custkey"]).select("o_custkey", "o_orderkey", Q("rank").cast("long").alias("rank"))


@query("""
WITH r AS (SELECT c_custkey, list(o_orderkey % 11 ORDER BY o_orderkey % 11) FILTER (o_orderkey IS NOT NULL) AS l FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)
SELECT c_custkey AS section, CASE WHEN l IS NULL THEN [3] ELSE list_concat([3], list_sort(list_filter(list_distinct(l), lambda x: x <> 3))) END AS done, l IS NULL AS over FROM r""")
def completed_steps(t):
    state = t("customer").select(Q("c_custkey").alias("section"), F.array(F.lit(3).cast("long")).alias("done"), F.create_map(F.lit(3).cast("long"), F.lit("old")).alias("background"))
    results = t("orders").select(Q("o_custkey").alias("section"), (Q("o_orderkey") % 11).alias("step"), F.lit("new").alias("background"))
    return T.completed_steps(state, results).select("section", "done", "over")


@query("""
SELECT o_orderkey, CAST(o_custkey % 5 AS INTEGER) AS content, 'Unknown' AS doc_time, CASE WHEN o_orderstatus = 'F' THEN '该篇文章的信息来源权威性和可信度得分：' || (o_custkey % 9 + 1) ELSE '该篇文章的信息来源权威性和可信度得分：未提供权威性得分' END AS source_authority, o_custkey % 5 < 4 AS in_range FROM orders""")
def scored_documents(t):
    score = F.when(Q("o_orderstatus") == "F", F.format_string('{"authority": %d}', Q("o_custkey") % 9 + 1)).otherwise('"none"')
    reply = F.concat(F.lit('{"items": [{"content": '), (Q("o_custkey") % 5).cast("string"), F.lit(', "score": '), score, F.lit("}]}"))
    item = t("orders").select("o_orderkey", F.inline(R.scored_items(reply, F.lit(4))))
    notes = {c: x for c, x in zip([v[0] for v in R.SCORES.values()], R.score_notes(F.struct("scores", "doc_time")), strict=False)}
    return item.select("o_orderkey", "content", "doc_time", notes["source_authority"], "in_range")


@query("""
WITH r AS (SELECT n_regionkey, n_name, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation)
SELECT n_regionkey, CAST(i AS VARCHAR) AS id, n_name AS title, CASE WHEN i > 1 THEN [CAST(i - 1 AS VARCHAR)] ELSE [] END AS parent_ids, CASE WHEN i > 1 THEN ['after'] ELSE [] END AS relationships FROM r""")
def outline_from_arguments(t):
    """Sections named by keys, each after the one before it, and one unknown parent; written as JSON and read."""
    before = F.lag("n_nationkey").over(T.Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    rows = t("nation").withColumn("b", before)
    section = F.struct(F.concat(F.lit("k"), "n_nationkey").alias("id"), Q("n_name").alias("title"), F.lit("d").alias("description"), F.array_compact(F.array(F.concat(F.lit("k"), "b"), F.lit("none"))).alias("parent_ids"), F.array(F.lit("after")).alias("relationships"))
    args = F.to_json(F.struct(F.lit("T").alias("title"), F.to_json(T.ordered_list("n_nationkey", section)).alias("sections")))
    o = rows.groupBy("n_regionkey").agg(args.alias("args"))
    return o.select("n_regionkey", F.inline(R.outline_of(Q("args"))["sections"])).select("n_regionkey", "id", "title", "parent_ids", "relationships")


@query("""
WITH d AS (SELECT o_custkey % 97 AS thread, o_orderkey % 4 AS section, CAST(o_totalprice AS BIGINT) AS price, o_orderkey FROM orders)
SELECT o_orderkey, thread, CAST(row_number() OVER (PARTITION BY thread ORDER BY CASE WHEN section = 0 THEN -1 ELSE 1 END, price DESC, o_orderkey) AS BIGINT) AS place FROM d WHERE thread IN (3, 5, 8)""")
def report_table_order(t):
    """The order of a report table: section 0 first in a thread, then by value, of chosen threads."""
    d = t("orders").select((Q("o_custkey") % 97).alias("thread"), (Q("o_orderkey") % 4).alias("section"), F.rint("o_totalprice").cast("long").alias("price"), "o_orderkey").where(Q("thread").isin(3, 5, 8))
    w = T.Window.partitionBy("thread").orderBy(F.when(Q("section") == 0, -1).otherwise(1), F.desc("price"), "o_orderkey")
    return d.select("o_orderkey", "thread", F.row_number().over(w).cast("long").alias("place"))


@query("""
WITH v AS (SELECT o_custkey, min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders GROUP BY o_custkey), p AS (SELECT *, CASE WHEN b > a THEN b - a ELSE greatest(b, 1.0) * 0.1 END AS span FROM v),
z AS (SELECT *, a <= span * 2.5 AS zero, span * CASE WHEN span / greatest(b, 1e-9) < 0.25 THEN 0.08 ELSE 0.12 END AS pad FROM p), e AS (SELECT *, CASE WHEN zero THEN 0.0 ELSE a - pad END AS lo, b + pad * 0.5 AS hi FROM z),
s AS (SELECT *, list_filter(list_transform([1.0, 1.1, 1.2, 1.25, 1.5, 1.6, 1.8, 2.0, 2.2, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0]::DOUBLE[], lambda m: m * pow(10.0, floor(log10((hi - lo) / 6.0)))), lambda m: m >= (hi - lo) / 6.0)[1] AS step FROM e)
SELECT o_custkey, round(greatest(least(floor(lo / step) * step, a), 0.0), 4) AS low, round(greatest(ceil(hi / step) * step, b), 4) AS high FROM s""")
def axis_ranges(t):
    v = t("orders").groupBy("o_custkey").agg(F.collect_list("o_totalprice").alias("v"))
    r = v.select("o_custkey", C.y_range(Q("v"), F.lit("bar")).alias("r"))
    return r.select("o_custkey", F.round("r.low", 4).alias("low"), F.round("r.high", 4).alias("high"))


@query("""
SELECT n_regionkey, 'pie' || string_agg(chr(10) || '    "' || n_name || ' (' || n_nationkey + 1 || '%)" : ' || n_nationkey + 1, '' ORDER BY n_nationkey DESC) || CASE WHEN sum(n_nationkey + 1) < 100 THEN chr(10) || '    "other (' || 100 - sum(n_nationkey + 1) || '%)" : ' || 100 - sum(n_nationkey + 1) ELSE '' END AS chart
FROM nation GROUP BY n_regionkey HAVING sum(n_nationkey + 1) <= 100""")
def pie_charts(t):
    g = t("nation").groupBy("n_regionkey").agg(T.ordered_list("n_nationkey", "n_name").alias("a"), T.ordered_list("n_nationkey", (Q("n_nationkey") + 1).cast("double")).alias("v"))
    return g.select("n_regionkey", C.mermaid_pie(F.lit("%"), Q("a"), Q("v")).alias("chart")).where("chart is not null")
