"""Reference lists and paragraphs of reports, nested outlines, and model pipelines with scripted replies."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tessera.operators import flows, outline, references, tools
from tessera.operators.records import ordered_list, parts_of
from tessera.plans.base import query

Q = F.col


def item_number():
    from pyspark.sql import Window

    return F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))


@query("""
WITH i AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, 's' || l_suppkey AS content FROM lineitem),
k AS (SELECT *, (n - 1) // 3 AS block, (n - 1) % 3 + 1 AS r, min(n) OVER (PARTITION BY doc_id, content) AS first FROM i)
SELECT doc_id, CAST(2 * block + 1 AS VARCHAR) || '-' || r AS key, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY first) AS BIGINT) AS ref, content FROM k""")
def reference_lines(t):
    """Lists of three lines, a blank line apart, brought to one numbering."""
    r = (Q("n") - 1) % 3 + 1
    line = F.concat(F.when((r == 1) & (Q("n") > 1), "\n").otherwise(""), F.format_string("[%d] s%d", r, "l_suppkey"))
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").repartition(parts_of(t("lineitem")), "l_orderkey")
    raw = lines.withColumn("n", item_number()).groupBy(Q("l_orderkey").alias("doc_id")).agg(F.array_join(ordered_list("n", line), "\n").alias("text"))
    return references.renumbered_lists(raw).select("doc_id", "key", Q("ref").cast("long").alias("ref"), "content")


@query("""
WITH i AS (SELECT l_orderkey AS doc_id, l_linenumber AS para, l_partkey, l_suppkey, l_returnflag = 'R' AS gone FROM lineitem),
p AS (SELECT doc_id, para, string_agg('w ' || CASE WHEN gone THEN '' ELSE '[source_tracer_result][t' || l_partkey || '](u' || l_suppkey || ')' END, '' ORDER BY l_partkey, l_suppkey) || '.' AS text FROM i GROUP BY ALL)
SELECT doc_id, string_agg(text, chr(10) ORDER BY para) AS text FROM p GROUP BY doc_id""")
def rebuilt_paragraphs(t):
    i = t("lineitem").withColumn("n", item_number())
    text = F.concat(F.array_join(ordered_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"), F.lit("w [source_tracer_result][old](<x>)")), ""), F.lit("."))
    paragraphs = i.groupBy(Q("l_orderkey").alias("doc_id"), Q("l_linenumber").alias("para")).agg(text.alias("text"))
    rows = i.select(Q("l_orderkey").alias("doc_id"), (Q("n") - 1).alias("idx"), (Q("l_returnflag") != "R").alias("valid"), F.lit(False).alias("is_image"), F.concat(F.lit("t"), "l_partkey").alias("title"), F.concat(F.lit("u"), "l_suppkey").alias("url"))
    return references.rebuilt(paragraphs, rows)


@query("""
SELECT n_regionkey AS outline_id, 'n' || n_nationkey AS section_id, CASE WHEN s_suppkey IS NOT NULL THEN 's' || s_suppkey END AS plan_id FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey""")
def outline_contents(t):
    """region, nation and supplier as a nested outline, and its table of contents."""
    empty = F.array().cast("array<struct<id:string,title:string,description:string,retrieval_queries:array<struct<query:string,doc_infos:array<struct<title:string,url:string>>>>>>")
    plan = F.struct(F.concat(F.lit("s"), "s_suppkey").alias("id"), Q("s_name").alias("title"), empty.alias("steps"))
    plans = t("supplier").groupBy(Q("s_nationkey").alias("n_nationkey")).agg(ordered_list("s_suppkey", plan).alias("plans"))
    none = F.array().cast("array<string>")
    section = F.struct(F.concat(F.lit("n"), "n_nationkey").alias("id"), Q("n_name").alias("title"), F.lit("").alias("description"), F.lit(True).alias("is_core_section"), none.alias("parent_ids"), none.alias("relationships"), "plans")
    nested = t("nation").join(plans, "n_nationkey", "left").groupBy(Q("n_regionkey").alias("outline_id")).agg(ordered_list("n_nationkey", section).alias("sections"))
    full = nested.select("outline_id", F.lit("en").alias("language"), F.lit("T").alias("title"), F.lit("").alias("thought"), "sections")
    return outline.flattened(full)["contents"].select("outline_id", "section_id", "plan_id")


@query("SELECT conv_id, turn, 'Role ' || coalesce(role, '') || ' says ' || coalesce(md5(text), '') || '.' AS prompt FROM conversations")
def filled_prompts(t):
    return t("conversations").select("conv_id", "turn", tools.prompt("Role {{ role }} says {{ digest }}.", role=Q("role"), digest=F.md5(Q("text").cast("binary"))).alias("prompt"))


def judge(prompts: list[str]) -> list[str]:
    """A scripted verifier: the fact is its score and whether its mark is in the content."""
    facts = [json.loads(p)["fact"].split("|") for p in prompts]
    return [json.dumps({"source": "unknown", "marked_citation_content": [mark], "score": int(score) / 100}) for score, mark in facts]


@query("""
SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 5 = 0 THEN greatest((o_custkey % 40 + 60) / 100, 0.85) ELSE (o_custkey % 40 + 60) / 100 END AS score,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_custkey % 3 = 0 THEN 'marked content not found' WHEN (o_custkey % 40 + 60) / 100 < 0.85 THEN 'score lower than threshold' END AS invalid_reason, 'd' AS source,
  CASE WHEN o_custkey % 3 <> 0 AND (o_orderkey % 5 = 0 OR (o_custkey % 40 + 60) / 100 >= 0.85) THEN '<mark>' || o_orderpriority || '</mark> x' ELSE o_orderpriority || ' x' END AS content FROM orders""")
def verified_citations(t):
    fact = F.concat((Q("o_custkey") % 40 + 60).cast("string"), F.lit("|"), F.when(Q("o_custkey") % 3 == 0, "@@@@@@@@").otherwise(Q("o_orderpriority")))
    rows = t("orders").select(Q("o_orderkey").alias("doc_id"), F.lit("d").alias("domain"), F.concat("o_orderpriority", F.lit(" x")).alias("content"), fact.alias("fact"), (Q("o_orderkey") % 5 == 0).alias("is_chart"))
    return flows.verified(rows, judge).select("doc_id", "score", "invalid_reason", "source", "content")


def matcher(prompts: list[str]) -> list[str]:
    """A scripted matcher: a sentence matches the sources whose title it is."""
    asked = [json.loads(p) for p in prompts]
    return [json.dumps({"source_traced_results": [{"sentence": s, "matched_source_indices": [x["idx"] for x in a["sources"] if x["title"] == s]} for s in a["sentences"]]}) for a in asked]


@query("""
WITH s AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS idx, o_orderstatus AS title FROM orders)
SELECT doc_id, title AS sentence, list(CAST(idx AS INTEGER) ORDER BY idx) AS indices FROM s WHERE title IN ('F', 'O') GROUP BY doc_id, title""")
def matched_sources(t):
    from pyspark.sql import Window

    idx = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    sources = t("orders").select(Q("o_custkey").alias("doc_id"), F.lit("web").alias("source"), idx.alias("idx"), Q("o_orderstatus").alias("title"), F.lit("c").alias("content"))
    asked = t("customer").select(Q("c_custkey").alias("doc_id"), F.explode(F.array(F.lit("F"), F.lit("O"))).alias("sentence"))
    return flows.match_sources(asked, sources, matcher, batch=4).select("doc_id", "sentence", "indices")
