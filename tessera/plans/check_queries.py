"""Checks, lookups in stored tables, calls in metrics logs and replies of search engines."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import urls as U
from tessera.operators import checks as C
from tessera.plans.base import query
from tessera.sources import engines, logs

Q = F.col

#: The outline of an order: its title and a part for each line of it, some with faults.
OUTLINE = """SELECT l_orderkey AS doc_id, l_orderkey % 5 AS section, string_agg(CASE WHEN l_linenumber = 1 AND l_orderkey % 7 <> 0 THEN (l_orderkey % 5) || '. order' || chr(10) ELSE '' END
  || CASE WHEN l_partkey % 41 = 0 THEN '12 stray' WHEN l_partkey % 43 = 0 THEN (l_orderkey % 5) || '.1.2 deep' ELSE (l_orderkey % 5) || '.' || l_linenumber || ' part' END, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey) AS text FROM lineitem GROUP BY l_orderkey"""


@query(f"""
WITH o AS ({OUTLINE}), l AS (SELECT doc_id, section, unnest(string_split(text, chr(10))) AS s FROM o),
k AS (SELECT *, regexp_matches(s, '^' || section || '\\. order') AS title, regexp_matches(s, '^' || section || '\\.\\d') AS part FROM l)
SELECT doc_id, count(*) FILTER (title) = 1 AND coalesce(min(TRY_CAST(regexp_extract(s, '^\\d+\\.(\\d+)', 1) AS INTEGER)) FILTER (part) = 1, false)
  AND count(*) FILTER (regexp_matches(s, '\\d+\\.\\d+\\.\\d+') OR (NOT title AND NOT part)) = 0 AS valid FROM k GROUP BY doc_id""")
def valid_outlines(t):
    n = (Q("l_orderkey") % 5).cast("string")
    title = F.when((Q("l_linenumber") == 1) & (Q("l_orderkey") % 7 != 0), F.concat(n, F.lit(". order\n"))).otherwise("")
    part = F.when(Q("l_partkey") % 41 == 0, "12 stray").when(Q("l_partkey") % 43 == 0, F.concat(n, F.lit(".1.2 deep"))).otherwise(F.concat(n, F.lit("."), Q("l_linenumber").cast("string"), F.lit(" part")))
    rows = t("lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", F.concat(title, part).alias("s")).alias("x")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("x"))
    outline = rows.select(Q("l_orderkey").alias("doc_id"), (Q("l_orderkey") % 5).alias("section"), F.array_join(F.transform("x", lambda x: x["s"]), "\n").alias("text"))
    return outline.select("doc_id", C.section_outline_valid(Q("text"), Q("section")).alias("valid"))


@query("""
SELECT doc_id, coalesce(length(text) > 0 AND doc_id % 3 > 0, false) AS need_check, CASE WHEN length(text) > 0 AND doc_id % 3 > 0 THEN md5(text || chr(10) || '## end ' || doc_id) END AS digest FROM documents""")
def citation_gate(t):
    """Reports whose last heading is followed by a tail; those without sources aren't checked."""
    report = F.when(F.length("text") > 0, F.concat("text", F.lit("\n## end "), Q("doc_id").cast("string"), F.lit("\ntail\n")))
    gate = t("documents").select("doc_id", C.citation_check(report, Q("doc_id") % 3).alias("c"))
    return gate.select("doc_id", "c.need_check", F.md5(Q("c.article").cast("binary")).alias("digest"))


@query("SELECT doc_id, md5(text || ' and .') AS digest FROM documents")
def unnumbered_links(t):
    linked = F.concat(Q("text"), F.lit(" and [["), Q("doc_id").cast("string"), F.lit("]](https://example.org/a)."))
    return t("documents").select("doc_id", F.md5(C.without_numbered_links(linked).cast("binary")).alias("digest"))


@query("SELECT c_custkey, regexp_matches(c_name, '^[\\x{4e00}-\\x{9fa5}a-zA-Z0-9_.-]+$') AS name_valid, regexp_matches(c_mktsegment || '!', '^[\\x{4e00}-\\x{9fa5}a-zA-Z0-9_.-]+$') AS mark_valid FROM customer")
def template_names(t):
    return t("customer").select("c_custkey", C.template_name_valid(Q("c_name")).alias("name_valid"), C.template_name_valid(F.concat("c_mktsegment", F.lit("!"))).alias("mark_valid"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey = 7 AND s_suppkey = (SELECT min(s_suppkey) FROM supplier WHERE s_nationkey = 7)")
def stored_lookup(t):
    of_space = C.lookup(t("supplier"), s_nationkey=7)
    return of_space.agg(F.min_by(F.struct("s_suppkey", "s_name"), "s_suppkey").alias("r")).select("r.*").where("s_suppkey is not null")


@query("SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders")
def newest_first(t):
    """The rows of each space, the newest first."""
    w = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey"))
    return t("orders").select("o_orderkey", "o_custkey", w.cast("long").alias("place"))


@query("SELECT DISTINCT c.c_custkey FROM customer c JOIN customer s ON s.c_nationkey = c.c_nationkey AND s.c_mktsegment = c.c_mktsegment AND s.c_custkey <> c.c_custkey")
def clashing_names(t):
    return C.name_clashes(t("customer"), t("customer"), "c_nationkey", "c_mktsegment", "c_custkey").select("c_custkey")


@query("SELECT DISTINCT o_custkey + 3 AS c_custkey FROM orders WHERE o_custkey + 3 NOT IN (SELECT c_custkey FROM customer)")
def unknown_keys(t):
    return C.not_found(t("orders").select((Q("o_custkey") + 3).alias("c_custkey")).distinct(), t("customer"), ["c_custkey"])


MODEL_LINE = "2025-01-01 00:00:00,000 - [TIME_STATS] thread_id: "


@query("""
WITH e AS (SELECT user_id, event_type, count(*) AS n, CAST(sum(CAST(round(value * 1000) AS BIGINT)) AS BIGINT) AS ms, CAST(sum(event_id % 1000) AS BIGINT) AS i,
  count(*) FILTER (event_id % 3 > 0) AS k, CAST(sum(event_id % 77) FILTER (event_id % 3 > 0) AS BIGINT) AS o FROM events GROUP BY ALL)
SELECT user_id AS thread, event_type AS method_name, n AS calls, ((ms + 5 * n) // (10 * n)) / 100.0 AS mean,
  ((20 * i + n) // (2 * n)) / 10.0 AS mean_input_tokens, CASE WHEN k > 0 THEN ((20 * o + k) // (2 * k)) / 10.0 END AS mean_output_tokens FROM e""")
def model_call_means(t):
    """Log lines of model calls written from the events and parsed back; a third lacks the tokens of the reply."""
    out = F.when(Q("event_id") % 3 > 0, (Q("event_id") % 77).cast("string")).otherwise("None")
    stats = F.concat(F.lit("{'method_name': '"), "event_type", F.lit("', 'duration': "), Q("value").cast("string"), F.lit(", 'input_tokens': "), (Q("event_id") % 1000).cast("string"), F.lit(", 'output_tokens': "), out, F.lit("}"))
    line = F.concat(F.lit(MODEL_LINE), F.lower(F.hex("user_id")), F.lit(" ------ [LLM CALL STATISTICS]: "), stats)
    means = logs.model_summary(logs.model_calls(t("events").select(line.alias("value"))))
    return means.select(F.conv("thread_id", 16, 10).cast("long").alias("thread"), "method_name", "calls", "mean", "mean_input_tokens", "mean_output_tokens")


@query("SELECT count(*) AS calls, CASE WHEN count(*) > 0 THEN (CAST(2 * sum(CAST(round(value * 1000) AS BIGINT)) + count(*) AS BIGINT) // (2 * count(*))) / 1000.0 END AS mean FROM events WHERE user_id IN (1, 2, 3)")
def search_call_total(t):
    stats = F.concat(F.lit("{'function_name': 'search', 'duration': "), Q("value").cast("string"), F.lit(", 'res_count': 2, 'res_len_list': [1, 2]}"))
    line = F.concat(F.lit(MODEL_LINE), F.lower(F.hex("user_id")), F.lit(" ------ [SEARCH TOOL STATISTICS]: "), stats)
    return logs.search_total(logs.of_threads(logs.search_calls(t("events").select(line.alias("value"))), ["1", "2", "3"]))


@query("""
SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 0 ELSE 2 END AS res_count, CASE WHEN page_id % 4 = 0 THEN 0 ELSE coalesce(length(substr(html, 1, 1000000)), 0) END AS first_length, CASE WHEN page_id % 4 > 0 THEN coalesce(substr(url, 1, 8192), '') END AS first_url FROM pages""")
def search_replies(t):
    """Recorded replies: three hits of which two are asked for, and an error in every fourth."""
    hit = F.struct("url", Q("html").alias("content"))
    reply = F.when(Q("page_id") % 4 == 0, F.lit('{"error": "busy"}')).otherwise(F.to_json(F.struct(F.array(hit, hit, hit).alias("web_pages"))))
    found = t("pages").select("page_id", engines.hits(reply, "pages", 2).alias("h"))
    sizes = found.select("page_id", "h", engines.hit_sizes(Q("h")).alias("s"))
    return sizes.select("page_id", "s.res_count", F.coalesce(F.get("s.res_len_list", F.lit(0)), F.lit(0)).cast("long").alias("first_length"), F.get("h", F.lit(0))["url"].alias("first_url"))


@query("SELECT page_id, true AS slash, false AS other FROM pages WHERE length(url) BETWEEN 20 AND 8000 AND url NOT LIKE '%?%' AND url NOT LIKE '%#%'")
def similar_urls(t):
    """A url of 20 characters or more is similar to itself with a slash, and not to one of another host and path."""
    p = t("pages").where("length(url) between 20 and 8000 and not contains(url, '?') and not contains(url, '#')")
    return p.select("page_id", U.similar_pages(Q("url"), F.concat("url", F.lit("/"))).alias("slash"), U.similar_pages(Q("url"), F.lit("ftp://0.0/")).alias("other"))
