"""Logs, citations, headings, charts and model calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import charts as C
from tessera.operators import citations as Z
from tessera.operators import headers as H
from tessera.operators import model as M
from tessera.plans.base import query
from tessera.sources import logs, sse

Q = F.col


@query("""
SELECT event_id % 97 AS thread, CASE WHEN event_type = 'click' THEN 'SummaryNode' ELSE 'ReporterNode' END AS node, CASE WHEN event_type = 'click' THEN 'SummaryNode' ELSE 'None' END AS parent, count(*) AS calls,
  CAST(sum(CAST(round(value * 1000) AS BIGINT)) AS BIGINT) AS millis, CAST(min(event_id % 5) AS INTEGER) AS low_section, max(epoch_us(ts) // 1000) AS last
FROM events WHERE round(value, 3) > 0 GROUP BY ALL""")
def metrics_log(t):
    """Log lines written from the events and parsed back into runs."""
    node = F.when(Q("event_type") == "click", "SummaryNode").otherwise("ReporterNode")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" - [TIME_STATS] thread_id: "), F.lower(F.hex(Q("event_id") % 97)), F.lit(" ---- ["), node, F.lit("["), (Q("event_id") % 5).cast("string"), F.lit("].run] executed time: "), Q("value").cast("decimal(18,3)").cast("string"), F.lit(" s"))
    runs = logs.node_runs(t("events").select(line.alias("value")))
    return runs.groupBy(F.conv("thread_id", 16, 10).cast("long").alias("thread"), "node", "parent").agg(F.count("*").alias("calls"), F.sum(F.round(Q("duration") * 1000).cast("long")).alias("millis"), F.min("section_idx").alias("low_section"), F.max(F.unix_millis("ts")).alias("last"))


@query("SELECT conv_id AS stream, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS BIGINT) AS message, role AS event, CAST(turn AS VARCHAR) AS id, CAST(length(text) AS BIGINT) AS chars FROM conversations")
def sse_messages(t):
    """Turns written as event, id and data lines, and read back."""
    c = t("conversations").withColumn("n", F.row_number().over(F_window("conv_id")))
    data = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.concat(F.lit("data: "), x))
    lines = F.concat(F.array(F.concat(F.lit("event: "), "role"), F.concat(F.lit("id: "), Q("turn").cast("string"))), data, F.array(F.lit("")))
    rows = c.select(Q("conv_id").alias("stream"), "n", F.posexplode(lines).alias("i", "line")).select("stream", F.struct("n", "i").alias("pos"), "line")
    return sse.messages(rows).select("stream", Q("message").cast("long").alias("message"), "event", "id", F.length("data").cast("long").alias("chars"))


def F_window(key: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy("turn", "text")


@query("""
WITH r AS (SELECT l_orderkey AS report, l_linenumber AS pos, 'http://s' || l_suppkey AS url, 't' || l_partkey AS title FROM lineitem),
f AS (SELECT *, min(pos) OVER (PARTITION BY report, url) AS first FROM r), n AS (SELECT *, dense_rank() OVER (PARTITION BY report ORDER BY first, url) AS ref FROM f),
o AS (SELECT report, ref, min_by(title, pos * 10000000 + CAST(substr(title, 2) AS BIGINT)) AS title, min(url) AS url FROM n GROUP BY report, ref)
SELECT report, string_agg('[' || ref || ']. [' || title || '](' || url || ')', chr(10) ORDER BY ref) AS "references" FROM o GROUP BY report""")
def reference_lists(t):
    r = t("lineitem").select(Q("l_orderkey").alias("report"), F.struct("l_linenumber", "l_partkey").alias("pos"), F.concat(F.lit("http://s"), "l_suppkey").alias("url"), F.concat(F.lit("t"), "l_partkey").alias("title"), "l_linenumber")
    return Z.reference_list(Z.numbered(r, "report", "url", "l_linenumber"), "report")


@query("SELECT l_orderkey AS report, l_linenumber AS pos, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS id, 'local' AS \"from\" FROM lineitem WHERE l_returnflag <> 'R' AND l_linestatus = 'O'")
def frontend_citations(t):
    c = t("lineitem").select(Q("l_orderkey").alias("report"), F.struct("l_linenumber", "l_partkey").alias("pos"), F.concat(F.lit("s"), "l_suppkey").alias("url"), (Q("l_linestatus") == "O").alias("valid"), (Q("l_returnflag") == "R").alias("is_image"))
    return Z.frontend_rows(c).select("report", Q("pos.l_linenumber").alias("pos"), Q("pos.l_partkey").alias("l_partkey"), Q("id").cast("long").alias("id"), "from")


@query("""
WITH o AS (SELECT o_custkey, list(o_totalprice ORDER BY o_orderkey) AS v FROM orders GROUP BY o_custkey)
SELECT o_custkey, len(list_distinct(v)) >= 3 AS ok, list_max(v) AS high FROM o""")
def chart_values(t):
    o = t("orders").groupBy("o_custkey").agg(F.collect_list("o_totalprice").alias("v"))
    return o.select("o_custkey", C.valid_values(F.lit("bar"), Q("v")).alias("ok"), F.array_max("v").alias("high"))


@query("""
WITH p AS (SELECT p_partkey, p_retailprice AS x, pow(10.0, floor(log10(p_retailprice))) AS e FROM part)
SELECT p_partkey, round(list_min(list_filter(list_transform([1.0, 1.1, 1.2, 1.25, 1.5, 1.6, 1.8, 2.0, 2.2, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0], lambda s: s * e), lambda s: s >= x)), 6) AS top FROM p""")
def nice_axis(t):
    return t("part").select("p_partkey", F.round(C.nice_ceil(Q("p_retailprice")), 6).alias("top"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS row FROM documents),
h AS (SELECT doc_id, row, CAST((row - 1) % 3 + 1 AS INTEGER) AS level, s FROM l),
i AS (SELECT *, count(*) FILTER (level < 2) OVER w AS i2, count(*) FILTER (level < 3) OVER w AS i3, count(*) FILTER (level = 1) OVER w AS c1 FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY row)),
c AS (SELECT *, count(*) FILTER (level = 2) OVER (PARTITION BY doc_id, i2 ORDER BY row) AS c2, count(*) FILTER (level = 3) OVER (PARTITION BY doc_id, i3 ORDER BY row) AS c3 FROM i)
SELECT doc_id, CAST(row - 1 AS INTEGER) AS line, level, c1 || CASE WHEN level > 1 THEN '.' || c2 ELSE '' END || CASE WHEN level > 2 THEN '.' || c3 ELSE '' END AS number, ltrim(s, ' 	
') AS title FROM c""")
def heading_numbers(t):
    """Headings made of the whole lines of each document, numbered by level."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.when(i % 3 == 0, "# ").when(i % 3 == 1, "## ").otherwise("### "), x))
    return H.renumbered(t("documents").select("doc_id", F.array_join(lines, "\n").alias("text")))


@query("SELECT conv_id, turn, role = 'user' AS valid FROM conversations")
def model_score_stub(t):
    """Replies of the stand-in parsed by the schema of a call; prose is no valid reply."""
    prompt = F.when(Q("role") == "user", F.to_json(F.struct(F.lit(True).alias("valid"), F.lit("").alias("error_msg")))).otherwise("not json")
    return M.model_map(t("conversations").select("conv_id", "turn", prompt.alias("prompt")), "prompt", "chart_compliance").select("conv_id", "turn", "valid")
