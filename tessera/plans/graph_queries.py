"""Dependency graphs, outlines and event streams."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import graph as G
from tessera.operators import outline as O
from tessera.operators import retrieve as V
from tessera.plans.base import query
from tessera.streaming import events as E

Q = F.col


def tree(t):
    """region -> nation -> supplier as nodes and edges of strings."""
    n = t("nation").select(F.concat(F.lit("r"), Q("n_regionkey")).alias("src"), F.concat(F.lit("n"), Q("n_nationkey")).alias("dst"))
    s = t("supplier").select(F.concat(F.lit("n"), Q("s_nationkey")).alias("src"), F.concat(F.lit("s"), Q("s_suppkey")).alias("dst"))
    edges = n.union(s)
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), edges


TREE = """edges AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier),
nodes AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges)"""


@query(f"""WITH RECURSIVE {TREE},
l AS (SELECT id, 0 AS level FROM nodes WHERE id NOT IN (SELECT dst FROM edges) UNION ALL SELECT dst, level + 1 FROM l JOIN edges ON src = id)
SELECT id, max(level) AS level FROM l GROUP BY id""")
def topo_levels(t):
    nodes, edges = tree(t)
    return G.levels(nodes, edges)


@query(f"""WITH RECURSIVE {TREE},
b AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
c AS (SELECT id, id AS other FROM nodes UNION SELECT c.id, b.dst FROM c JOIN b ON c.other = b.src)
SELECT id, min(other) AS component FROM c GROUP BY id""")
def weak_components(t):
    nodes, edges = tree(t)
    return G.components(nodes, edges)


@query(f"""WITH RECURSIVE {TREE},
x AS (SELECT 's' || s_suppkey AS id FROM supplier WHERE s_acctbal > 5000 UNION SELECT src FROM x JOIN edges ON dst = id WHERE id NOT IN (SELECT 'n' || n_nationkey FROM nation WHERE n_regionkey = 1))
SELECT id FROM x""")
def reachable_prune(t):
    _, edges = tree(t)
    goals = t("supplier").where("s_acctbal > 5000").select(F.concat(F.lit("s"), Q("s_suppkey")).alias("id"))
    stops = t("nation").where("n_regionkey = 1").select(F.concat(F.lit("n"), Q("n_nationkey")).alias("id"))
    return G.reaches(edges, goals, stops)


@query("SELECT l_orderkey AS edge_id, l_suppkey AS src, l_returnflag AS relation, l_linenumber AS dst FROM lineitem WHERE l_suppkey <> l_linenumber")
def hyper_edges(t):
    h = t("lineitem").select(Q("l_orderkey").alias("edge_id"), F.array("l_suppkey").alias("heads"), Q("l_returnflag").alias("relation"), Q("l_linenumber").alias("tail"))
    return G.edges_of(h)


@query("SELECT DISTINCT 'n' || n_nationkey AS id FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
def leaf_nodes(t):
    """Conclusions that lead nowhere."""
    _, edges = tree(t)
    return t("nation").select(F.concat(F.lit("n"), Q("n_nationkey")).alias("id")).distinct().join(edges.select(Q("src").alias("id")), "id", "left_anti")


def sections(t):
    """An outline for each order: its lines are sections, each depending on the numbers of its part and supplier modulo 7."""
    s = F.struct(Q("l_linenumber").cast("string").alias("id"), F.array((Q("l_partkey") % 7 + 1).cast("string"), (Q("l_suppkey") % 7 + 1).cast("string")).alias("parent_ids"), F.array(F.lit("follows")).alias("relationships"))
    return t("lineitem").groupBy(Q("l_orderkey").alias("outline_id")).agg(F.array_sort(F.collect_list(s)).alias("sections"))


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber AS id, l_partkey % 7 + 1 AS a, l_suppkey % 7 + 1 AS b FROM lineitem),
o AS (SELECT l_orderkey, list(DISTINCT id) AS ids FROM p GROUP BY l_orderkey),
k AS (SELECT l_orderkey, id, list_distinct(list_filter([a, b], lambda x: list_contains(ids, x) AND x < id)) AS c, a, b FROM p JOIN o USING (l_orderkey))
SELECT l_orderkey AS outline_id, CAST(sum(len(c)) AS BIGINT) AS kept, count(*) AS sections FROM k GROUP BY l_orderkey""")
def repair_dependencies(t):
    fixed = sections(t).withColumn("sections", O.repaired(Q("sections")))
    return fixed.select("outline_id", F.aggregate("sections", F.lit(0).cast("long"), lambda a, s: a + F.size(s["parent_ids"])).alias("kept"), F.size("sections").cast("long").alias("sections"))


@query("""
WITH p AS (SELECT l_orderkey AS outline_id, l_linenumber AS id, unnest([l_partkey % 7 + 1, l_suppkey % 7 + 1]) AS parent FROM lineitem),
o AS (SELECT l_orderkey AS outline_id, list(DISTINCT l_linenumber) AS ids FROM lineitem GROUP BY 1)
SELECT outline_id, CAST(id AS VARCHAR) AS id, CAST(parent AS VARCHAR) AS parent, CASE WHEN parent = id THEN 'self' WHEN NOT list_contains(ids, parent) THEN 'unknown' ELSE 'later' END AS error
FROM p JOIN o USING (outline_id) WHERE parent = id OR NOT list_contains(ids, parent) OR parent > id""")
def dependency_errors(t):
    return O.dependency_errors(sections(t))


@query("SELECT l_orderkey AS outline_id, CAST(l_linenumber AS VARCHAR) AS id, CAST(l_partkey % 7 + 1 AS VARCHAR) || '(follows)' AS shown FROM lineitem")
def parent_relations(t):
    return sections(t).select("outline_id", F.explode("sections").alias("s")).select("outline_id", "s.id", O.relations_shown(Q("s")).alias("shown"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_events(t):
    return E.tumbling(t("events"), "1 hour")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_events(t):
    return E.sessions(t("events"), "30 minutes")


@query("""
SELECT event_id FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type IN ('purchase', 'view') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM events) AS x
WHERE last IS DISTINCT FROM 'purchase' OR event_type = 'view'""")
def event_suppression(t):
    return E.suppressed(t("events"), "purchase", "view").select("event_id")


@query("SELECT conv_id, turn, phase, CASE WHEN phase = 'MESSAGE' THEN text ELSE '' END AS content FROM conversations, (VALUES ('START'), ('MESSAGE'), ('DONE')) AS v(phase)")
def message_framing(t):
    return E.framed(t("conversations")).select("conv_id", "turn", "phase", "content")


@query("SELECT conv_id, CAST(least(sum(length(text)), 1000000) AS BIGINT) AS chars, count(*) AS parts FROM conversations GROUP BY conv_id")
def chunk_accumulation(t):
    return E.accumulated(t("conversations")).select("conv_id", F.length("content").cast("long").alias("chars"), "parts")


def said_sentences(t):
    """Sentences of documents, and every fifth of them as somebody would give it from memory: without its commas and second word."""
    every = t("documents").select("doc_id", F.posexplode(X.sentences(Q("text"))).alias("at", "text")).where("length(text) > 0")
    every = every.select(Q("doc_id").alias("grp"), F.format_string("%012d-%06d", "doc_id", "at").alias("id"), "text")
    recalled = F.regexp_replace(F.translate("text", ",", ""), "^(\\S+) \\S+", "$1")
    return every.where(F.crc32(Q("id").cast("binary")) % 5 == 0).withColumn("text", recalled), every


@query(None)
def fuzzy_best_match(t):
    """The sentence of its document that each sentence given from memory is most like."""
    return V.best_fuzzy(*said_sentences(t), 80.0)


@query(None)
def fuzzy_choices(t):
    """For every second url the three of its host's others that are most like it."""
    own = t("pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("grp"), Q("page_id").alias("id"), Q("url").alias("text"))
    return V.best_fuzzy(own.where("id % 2 = 0"), own.where("id % 2 = 1"), 75.0, limit=3)
