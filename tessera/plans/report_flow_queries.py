"""Whole reports and templates by scripted models."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import report_flows
from tessera.plans.base import query

Q = F.col


def summary(prompts: list[str]) -> list[str]:
    """The number of a section's report, or nothing for every fourth."""
    asked = [json.loads(p) for p in prompts]
    return ["" if (int(p["report_id"]) + p["section"]) % 4 == 0 else f"s{p['section']}" for p in asked]


def lead(prompts: list[str]) -> list[str]:
    asked = [json.loads(p) for p in prompts]
    return [f"From {p['title_prev'] or 'nothing'} ({p['summary_prev']}) to {p['title_next']} ({p['summary_next']})." for p in asked]


def opening(prompts: list[str]) -> list[str]:
    asked = [json.loads(p) for p in prompts]
    return ["" if int(p["report_id"]) % 5 == 0 else f"Abstract of {len(p['sections'])}" for p in asked]


@query("""
WITH l AS (SELECT o_custkey AS r, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_orderkey AS o, CASE WHEN o_orderkey % 6 > 0 THEN o_orderpriority END AS t FROM orders),
s AS (SELECT *, CASE WHEN t IS NULL OR (r + n) % 4 = 0 THEN '' ELSE 's' || n END AS summary, sum(CASE WHEN t IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY n) AS k FROM l),
p AS (SELECT *, coalesce(lag('T' || n) OVER w, 'nothing') AS pt, coalesce(lag(summary) OVER w, '') AS ps FROM s WINDOW w AS (PARTITION BY r ORDER BY n)),
x AS (SELECT *, ps = '' AND summary = '' AS bare, '# ' || k || '. ' || t || CASE WHEN ps = '' AND summary = '' THEN '' ELSE chr(10) || 'From ' || pt || ' (' || ps || ') to T' || n || ' (' || summary || ').' END || chr(10) || '## ' || k || '.1 ' || o AS text FROM p WHERE t IS NOT NULL),
g AS (SELECT r, count(*) AS n, count(*) FILTER (bare) AS b, string_agg(text, chr(10) || chr(10) ORDER BY x.n) AS body FROM x GROUP BY r)
SELECT CAST(c_custkey AS VARCHAR) AS report_id, concat_ws(chr(10) || chr(10), '# ' || c_name, CASE WHEN c_custkey % 5 > 0 AND g.n > 0 THEN 'Abstract of ' || g.n END, body, CASE WHEN c_custkey % 5 > 0 AND g.n > 0 THEN 'Abstract of ' || g.n END) AS report,
  concat_ws(', ', CASE WHEN c_custkey % 5 = 0 OR g.n IS NULL THEN 'abstract' END, CASE WHEN b > 0 THEN b || ' transitions' END, CASE WHEN c_custkey % 5 = 0 OR g.n IS NULL THEN 'recommendations' END) AS missing
FROM customer LEFT JOIN g ON r = c_custkey""")
def whole_reports(t):
    """A report for each customer, its orders as sections of two headings; every sixth wasn't written, some parts get no reply."""
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    text = F.when(Q("o_orderkey") % 6 > 0, F.concat(F.lit("# 9. "), "o_orderpriority", F.lit("\n## "), F.lit("7.7 "), Q("o_orderkey").cast("string")))
    text = F.regexp_replace(text, "^# 9\\. ([0-9])", "# 9. $1")
    sections = t("orders").select(Q("o_custkey").cast("string").alias("report_id"), n.alias("section"), F.concat(F.lit("T"), n).alias("title"), text.alias("text"))
    titles = t("customer").select(Q("c_custkey").cast("string").alias("report_id"), Q("c_name").alias("title"))
    made = report_flows.whole_reports(sections, titles, {"section_summary": summary, "transition": lead, "abstract": opening, "recommendations": opening})
    return made.select("report_id", "report", F.array_join("missing", ", ").alias("missing"))


def structure(prompts: list[str]) -> list[str]:
    """An outline; some first attempts tell of an error, some documents never get one."""
    out = []
    for p in map(json.loads, prompts):
        k = int(p["of"]["doc_id"])
        out.append("Error: busy" if k % 7 == 0 or k % 3 == 0 and p["attempt"] < 2 else f"# Title\n## Part {k}\ntext\n#### deep\n### Sub")
    return out


def semantics(prompts: list[str]) -> list[str]:
    asked = [json.loads(p)["of"] for p in prompts]
    return ["  " if int(p["doc_id"]) % 11 == 0 else p["outline"] + f"\nof {len(p['text'])}" for p in asked]


@query("""
SELECT doc_id, CASE WHEN coalesce(trim(text), '') <> '' AND doc_id % 7 > 0 AND doc_id % 11 > 0 THEN '# Part ' || doc_id || chr(10) || '## Sub' || chr(10) || 'of ' || length(text) END AS template,
  CASE WHEN coalesce(trim(text), '') = '' THEN 'no text' WHEN doc_id % 7 = 0 THEN 'no outline' WHEN doc_id % 11 = 0 THEN 'no description' END AS error FROM documents""")
def extracted_templates(t):
    return report_flows.template_of(t("documents"), {"structure": structure, "semantics": semantics})
