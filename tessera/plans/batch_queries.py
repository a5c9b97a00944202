"""Batches of calls joined back, retrieval units, chains of nodes, means joined back to rows."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import batches
from tessera.plans.base import query
from tessera.sources import logs

Q = F.col


def scorer(prompts: list[str]) -> list[str]:
    """A scripted scorer: an item's last digit; for some batches a result too few, for some no JSON."""
    out = []
    for items in (json.loads(p)["items"] for p in prompts):
        first, results = int(items[0]), [str(int(x) % 10) for x in items]
        out.append("sorry" if first % 7 == 0 else json.dumps({"results": results[:-1] if first % 5 == 0 else results}))
    return out


@query("""
WITH i AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders),
b AS (SELECT *, first_value(o_orderkey) OVER w AS f, count(*) OVER (PARTITION BY o_custkey, pos // 4) AS n FROM i WINDOW w AS (PARTITION BY o_custkey, pos // 4 ORDER BY pos))
SELECT o_custkey, CAST(pos AS INTEGER) AS pos, CASE WHEN f % 7 <> 0 AND f % 5 <> 0 THEN CAST(o_orderkey % 10 AS VARCHAR) END AS result,
  CASE WHEN f % 7 = 0 THEN 'reply can''t be parsed' WHEN f % 5 = 0 THEN (n - 1) || ' results for ' || n || ' rows' END AS error FROM b""")
def batch_results(t):
    """Orders of each customer scored four at a call; the lists are joined back by place."""
    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    rows = t("orders").select("o_custkey", pos.alias("pos"), Q("o_orderkey").cast("string").alias("item"))
    return batches.answered(rows, ["o_custkey"], 4, scorer).select("o_custkey", "pos", "result", "error")


@query("""
WITH h AS (SELECT l_orderkey AS q, CASE WHEN l_suppkey % 3 = 0 THEN 'local' ELSE 'web' END AS source, l_linenumber AS rank, 't' || l_partkey % 30 AS title, CASE WHEN l_partkey % 9 > 0 THEN 'u' || l_partkey % 30 ELSE '' END AS url FROM lineitem),
r AS (SELECT *, CASE source WHEN 'web' THEN 1 ELSE 2 END AS o, row_number() OVER (PARTITION BY q, source ORDER BY rank, title, url) AS n FROM h WHERE url <> ''),
d AS (SELECT *, row_number() OVER (PARTITION BY q, title, url ORDER BY o, n) AS k FROM r WHERE n <= 2),
s AS (SELECT q, string_agg(source || ' ' || title, '|' ORDER BY o, n) AS documents FROM d WHERE k = 1 GROUP BY q)
SELECT o_orderkey AS query_id, coalesce(documents, '') AS documents, concat_ws('|', CASE WHEN o_orderkey % 10 = 0 THEN 'local: timeout' END, CASE WHEN o_orderkey % 15 = 0 THEN 'web: refused' END, CASE WHEN documents IS NULL THEN 'no documents' END) AS errors
FROM orders LEFT JOIN s ON q = o_orderkey""")
def retrieval_units(t):
    """Each order as a query over two sources, its lines as hits."""
    key, source = Q("l_orderkey").alias("query_id"), F.when(Q("l_suppkey") % 3 == 0, "local").otherwise("web").alias("source")
    number = (Q("l_partkey") % 30).cast("string")
    hits = t("lineitem").select(key, source, Q("l_linenumber").alias("rank"), F.concat(F.lit("t"), number).alias("title"), F.when(Q("l_partkey") % 9 > 0, F.concat(F.lit("u"), number)).otherwise("").alias("url"), F.lit("c").alias("content"))
    asked = t("orders").select(Q("o_orderkey").alias("query_id"), Q("o_orderpriority").alias("query"))
    failed = asked.select("query_id", F.explode(F.array_compact(F.array(F.when(Q("query_id") % 10 == 0, F.struct(F.lit("local").alias("source"), F.lit("timeout").alias("message"))), F.when(Q("query_id") % 15 == 0, F.struct(F.lit("web").alias("source"), F.lit("refused").alias("message")))))).alias("e"))
    found = batches.retrieved(asked, hits, failed.select("query_id", "e.source", "e.message"), ["web", "local"], 2)
    return found.select("query_id", F.array_join(F.transform("documents", lambda d: F.concat_ws(" ", d["source"], d["title"])), "|").alias("documents"), F.array_join("errors", "|").alias("errors"))


@query("""
WITH e AS (SELECT *, event_type || '-' || event_id AS cur, lag(event_type || '-' || event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS pre FROM events)
SELECT user_id AS thread_id, coalesce(pre, '') AS pre_node, cur AS cur_node, 'input' AS type, 'in ' || event_id AS content FROM e WHERE event_id % 3 > 0
UNION ALL SELECT user_id, coalesce(pre, ''), cur, 'output', event_type FROM e""")
def node_chains(t):
    """Events as runs of nodes; a third has no input."""
    runs = t("events").select(Q("user_id").alias("thread_id"), Q("event_id").alias("seq"), Q("event_type").alias("node"), F.when(Q("event_id") % 3 > 0, F.concat(F.lit("in "), "event_id")).alias("input"), Q("event_type").alias("output"))
    return batches.node_chain(runs).drop("seq")


@query("""
WITH s AS (SELECT user_id, event_type, count(*) AS n, CAST(sum(CAST(round(value * 1000) AS BIGINT)) AS BIGINT) AS ms FROM events GROUP BY ALL)
SELECT event_id, user_id AS thread_id, CASE WHEN event_type IN ('view', 'click') THEN 'EditorTeamNode' ELSE 'None' END AS parent, event_type AS node, ((ms + 5 * n) // (10 * n)) / 100.0 AS mean, n AS calls,
  row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 4 = 0 THEN -1 ELSE 1 END, CASE WHEN event_type IN ('view', 'click') THEN 'EditorTeamNode' ELSE 'None' END, ((ms + 5 * n) // (10 * n)) / 100.0 DESC, round(value, 3) DESC, event_id) AS place
FROM events JOIN s USING (user_id, event_type)""")
def node_means(t):
    """Runs of nodes with the mean and number of those of their thread and node, in the order of the report's table."""
    parent = F.when(Q("event_type").isin("view", "click"), "EditorTeamNode").otherwise("None")
    runs = t("events").select("event_id", Q("user_id").alias("thread_id"), Q("event_type").alias("node"), parent.alias("parent"), (Q("event_id") % 4).cast("int").alias("section_idx"), F.round("value", 3).alias("duration"))
    joined = logs.with_summary(runs)
    place = F.row_number().over(Window.partitionBy("thread_id").orderBy(*logs.report_order(joined)[1:], "event_id"))
    return joined.select("event_id", "thread_id", "parent", "node", "mean", "calls", place.cast("long").alias("place"))
