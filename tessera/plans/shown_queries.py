"""Masked and sealed keys, redacted parameters, problems of fields, outlines without plans, urls near each other."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import urls as U
from tessera.operators import shown
from tessera.operators.records import ordered_list
from tessera.plans.base import query

Q = F.col


@query("""
SELECT s_suppkey, CASE WHEN length(k) <= 4 THEN repeat('*', length(k)) ELSE repeat('*', length(k) - 4) || right(k, 4) END AS shown, true AS same, s_suppkey % 3 > 0 AS read
FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN left(s_name, 3) ELSE s_name END AS k FROM supplier) AS x""")
def sealed_keys(t):
    """Keys masked, sealed and read back; every third with another master, which reads nothing."""
    key = F.when(Q("s_suppkey") % 7 == 0, F.left("s_name", F.lit(3))).otherwise(Q("s_name"))
    master, other = (F.unhex(F.md5(F.concat(F.lit(x), Q("s_nationkey").cast("string")).cast("binary"))) for x in ("a", "b"))
    own = t("supplier").select("s_suppkey", key.alias("k"), master.alias("master"), F.when(Q("s_suppkey") % 3 == 0, other).otherwise(master).alias("given"))
    stored = own.withColumn("text", shown.sealed(Q("k"), Q("master")))
    back = shown.unsealed(Q("text"), Q("given"))
    return stored.select("s_suppkey", shown.masked(Q("k")).alias("shown"), (shown.unsealed(Q("text"), Q("master")) == Q("k")).alias("same"), back.isNotNull().alias("read"))


@query("""
SELECT doc_id, 'doc=' || doc_id || ', lang=' || coalesce(lang, '') || ', text=' || left(coalesce(text, ''), 100) AS params FROM documents""")
def logged_params(t):
    names = {"text": Q("text"), "doc": Q("doc_id").cast("string"), "lang": Q("lang"), "api_key": F.lit("k"), "Url": Q("source"), "accessToken": F.lit("x")}
    params = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), v)])
    return t("documents").select("doc_id", shown.logged(params).alias("params"))


@query("""
SELECT o_orderkey, concat_ws('; ', CASE WHEN c IS NULL OR trim(c) = '' THEN 'clerk is empty' WHEN length(c) > 6 THEN 'clerk is longer than 6' END, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'o_orderstatus is none of F, O' END,
  CASE WHEN o_orderpriority NOT LIKE '_-%' THEN 'o_orderpriority has a wrong form' END, CASE WHEN o_orderkey % 10 = 0 THEN 'one of web, local must be given' END) AS problems
FROM (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN 'ann' ELSE 'a longer name' END AS c FROM orders) AS x""")
def field_problems(t):
    clerk = F.when(Q("o_orderkey") % 4 == 1, "  ").when(Q("o_orderkey") % 4 == 2, "ann").when(Q("o_orderkey") % 4 == 3, "a longer name")
    rows = t("orders").withColumn("clerk", clerk).withColumn("web", F.when(Q("o_orderkey") % 2 == 1, "w")).withColumn("local", F.when(Q("o_orderkey") % 5 > 0, "l").otherwise(" "))
    rules = [shown.Rule("clerk", required=True, longest=6), shown.Rule("o_orderstatus", allowed=("F", "O")), shown.Rule("o_orderpriority", pattern="^.-")]
    return rows.select("o_orderkey", F.array_join(shown.problems(rules, ("web", "local")), "; ").alias("problems"))


@query("""
SELECT n_regionkey AS outline_id, CAST(to_json(list({'id': n_nationkey, 'title': n_name} ORDER BY n_nationkey)) AS VARCHAR) AS sections FROM nation GROUP BY 1""")
def outlines_without_plans(t):
    plans = t("supplier").groupBy(Q("s_nationkey").alias("n_nationkey")).agg(ordered_list("s_suppkey", "s_name").alias("plans"))
    section = F.struct(Q("n_nationkey").alias("id"), Q("n_name").alias("title"), "plans")
    nested = t("nation").join(plans, "n_nationkey", "left").groupBy(Q("n_regionkey").alias("outline_id")).agg(ordered_list("n_nationkey", section).alias("sections"))
    return nested.select("outline_id", F.to_json(shown.without_field(Q("sections"), "plans")).alias("sections"))


@query(None)
def near_urls(t):
    """Whether each url is similar to the one before it on its host, and to itself with one and with many letters changed."""
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    own = t("pages").select("page_id", "url", F.lag("url").over(Window.partitionBy(host).orderBy("page_id")).alias("before"))
    last, tail = F.overlay("url", F.lit("~"), F.length("url")), F.concat("url", F.lit("/much/further/down/the/tree"))
    return own.select("page_id", *[U.similar_pages(Q("url"), x).alias(n) for n, x in (("before", Q("before")), ("last", last), ("tail", tail))])
