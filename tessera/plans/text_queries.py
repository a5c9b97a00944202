"""Projections, validation, and text and url functions over the tables of documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import urls as U
from tessera.plans.base import query

Q = F.col


@query("SELECT page_id, 'page' AS type, substr(url, 1, 8192) AS url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, length(substr(html, 1, 1000000)) AS content_chars FROM pages")
def project_pages(t):
    return t("pages").select("page_id", F.lit("page").alias("type"), F.substring("url", 1, 8192).alias("url"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.length(F.substring("html", 1, 1000000)).cast("long").alias("content_chars"))


@query("SELECT doc_id, 'localdataset://result//' || source || '//' || CAST(doc_id AS VARCHAR) AS url, coalesce(CAST(quality AS DOUBLE), 0.0) AS score FROM documents LEFT JOIN labels USING (doc_id)")
def project_local_hits(t):
    d = t("documents").join(t("labels"), "doc_id", "left")
    return d.select("doc_id", F.concat(F.lit("localdataset://result//"), "source", F.lit("//"), Q("doc_id").cast("string")).alias("url"), F.coalesce(Q("quality").cast("double"), F.lit(0.0)).alias("score"))


@query("SELECT doc_id, source AS title, lang AS url, length(text) AS content_chars FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
def filter_required(t):
    return t("documents").where("source is not null and lang is not null and text is not null").select("doc_id", Q("source").alias("title"), Q("lang").alias("url"), F.length("text").cast("long").alias("content_chars"))


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS short FROM documents")
def truncate_docs(t):
    return t("documents").select("doc_id", X.truncate(Q("text"), 100).alias("short"))


@query("""
WITH s AS (SELECT doc_id, list_transform(string_split(regexp_replace(text, '([。!！?？;；\n])', '\\1' || chr(30), 'g'), chr(30)), lambda x: regexp_replace(x, '^[\\s\\x{3000}\\x{85}\\x{a0}]+|[\\s\\x{3000}\\x{85}\\x{a0}]+$', '', 'g')) AS p FROM documents),
k AS (SELECT doc_id, CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS p FROM s)
SELECT doc_id, CAST(len(p) AS BIGINT) AS n_sentences, CAST(coalesce(list_sum(list_transform(p, lambda x: length(x))), 0) AS BIGINT) AS chars, p[1] AS first FROM k""")
def sentences(t):
    p = t("documents").select("doc_id", X.sentences(Q("text")).alias("p"))
    return p.select("doc_id", F.size("p").cast("long").alias("n_sentences"), F.aggregate("p", F.lit(0), lambda a, x: a + F.length(x)).cast("long").alias("chars"), F.get("p", F.lit(0)).alias("first"))


@query("""
SELECT doc_id, CAST(i AS INTEGER) AS chunk, CAST(length(substr(text, i * 3000 + 1, 3000)) AS BIGINT) AS chars, md5(substr(text, i * 3000 + 1, 3000)) AS digest
FROM documents, unnest(range(0, CAST(ceil(length(text) / 3000.0) AS BIGINT))) AS r(i)""")
def chunk_docs(t):
    c = t("documents").select("doc_id", F.inline(X.chunks(Q("text"))))
    return c.select("doc_id", "chunk", F.length("piece").cast("long").alias("chars"), F.md5(Q("piece").cast("binary")).alias("digest"))


@query("SELECT conv_id, turn, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM conversations")
def html_escape(t):
    return t("conversations").select("conv_id", "turn", X.escape_html(Q("text")).alias("escaped"))


@query("""
WITH m AS (SELECT doc_id, text || ' [citation:3] 。' AS s FROM documents)
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(s, '[\\s，。！？；：、,.;:!?]+$', ''), '\\[\\s*citation:\\s*(\\d+)\\s*\\]', '', 'g'), '[\\s，。！？；：、,.;:!?]+$', '')) AS digest FROM m""")
def strip_trailing_marks(t):
    return t("documents").select("doc_id", F.md5(X.without_trailing_marks(F.concat("text", F.lit(" [citation:3] 。"))).cast("binary")).alias("digest"))


@query("""
SELECT item_id, regexp_replace(CAST(item_id AS VARCHAR) || '-5 ' || text, '^(?:\\d+(?:[.\\-\\s]\\d+)*|第?[一二三四五六七八九十\\d]+[、章])\\s*', '') AS title FROM benchmark""")
def strip_numbers(t):
    return t("benchmark").select("item_id", X.strip_leading_number(F.concat(Q("item_id").cast("string"), F.lit("-5 "), "text")).alias("title"))


@query("SELECT item_id, '## ' || text || chr(10) || '- **x ' || CAST(item_id AS VARCHAR) || '**' || chr(10) || 'plain' AS md FROM benchmark")
def clean_headers(t):
    md = F.concat(F.lit("## 3. "), "text", F.lit("\n#### （2）x "), Q("item_id").cast("string"), F.lit("\nplain"))
    return t("benchmark").select("item_id", X.clean_headers(md).alias("md"))


@query("""
WITH f AS (SELECT page_id, regexp_replace(regexp_replace(url, '^(https?)://([^/?#]*)', '\\1://\\2-www', ''), '^https?://([^/]+)-([a-z]+)/(.+)', 'https://\\1/\\2/\\3') AS u FROM pages),
p AS (SELECT page_id, regexp_extract(u, '^([a-z]+)://', 1) AS s, regexp_extract(u, '^[a-z]+://([^/?#]*)', 1) AS h, regexp_extract(u, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS pa, regexp_extract(u, '^[^?#]*(\\?[^#]+)', 1) AS q, regexp_extract(u, '(#.+)$', 1) AS f FROM f)
SELECT page_id, s || '://' || regexp_replace(regexp_replace(h, '\\.(com|net|org|edu|gov)-([a-z]+)$', '.\\1'), '-([a-z]+)$', '') || CASE WHEN starts_with(pa, '/') THEN regexp_replace(pa, '/+', '/', 'g') ELSE '/' || regexp_replace(pa, '/+', '/', 'g') END || q || f AS url FROM p""")
def url_normalize(t):
    """Urls with a host suffix that models tend to add, repaired."""
    broken = F.regexp_replace("url", "^(https?)://([^/?#]*)", "$1://$2-www")
    return t("pages").select("page_id", U.normal_url(broken).alias("url"))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host FROM pages")
def url_host(t):
    return t("pages").select("page_id", U.host_of(Q("url")).alias("host"))


@query("SELECT page_id, CAST(length(url) + length(regexp_replace(url, '[^一-鿿]', '', 'g')) AS BIGINT) AS weight, regexp_matches(lower(url), 'key|url|token') AS sensitive FROM pages")
def label_weight(t):
    return t("pages").select("page_id", X.label_weight(Q("url")).cast("long").alias("weight"), X.is_sensitive_key(Q("url")).alias("sensitive"))


@query("""
SELECT doc_id, substr(text, 1, p + length(w) - 1) || '[source](u)' || substr(text, p + length(w)) AS marked
FROM (SELECT doc_id, text, split_part(text, ' ', 2) AS w, strpos(text, split_part(text, ' ', 2)) AS p FROM documents) AS x WHERE length(w) > 0
UNION ALL SELECT doc_id, text FROM documents WHERE length(split_part(text, ' ', 2)) = 0""")
def insert_source(t):
    return t("documents").select("doc_id", X.insert_after(Q("text"), F.split_part("text", F.lit(" "), F.lit(2)), F.lit("[source](u)")).alias("marked"))


@query("SELECT event_id, CAST(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) AS BIGINT) AS k FROM events")
def json_props(t):
    return t("events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT doc_id, base64(encode(source || '/' || lang)) AS enc, source || '/' || lang AS dec FROM documents")
def base64_round_trip(t):
    e = F.base64(F.concat_ws("/", "source", "lang").cast("binary"))
    return t("documents").select("doc_id", e.alias("enc"), F.decode(F.unbase64(e), "UTF-8").alias("dec"))


@query("SELECT event_id, epoch_us(ts) // 1000 AS ms, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown FROM events")
def epoch_millis(t):
    return t("events").select("event_id", F.unix_millis(Q("ts").cast("timestamp_ltz")).alias("ms"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("shown"))


@query("SELECT doc_id, greatest(3.0, least(3.0 / (1 + doc_id % 7), 60.0)) AS wait, CAST(greatest(floor((n_chars - 2) / 2.0) - 1, 1) AS BIGINT) AS steps FROM documents")
def wait_and_steps(t):
    return t("documents").select("doc_id", F.greatest(F.lit(3.0), F.least(F.lit(3.0) / (1 + Q("doc_id") % 7), F.lit(60.0))).alias("wait"), F.greatest(F.floor((Q("n_chars") - 2) / 2) - 1, F.lit(1)).cast("long").alias("steps"))


@query("""
SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 0)) AS lines,
  len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\\S+\\.$'))) AS one_word FROM documents""")
def line_counts(t):
    lines = F.split("text", "\n")
    return t("documents").select("doc_id", F.size(F.filter(lines, lambda x: F.length(x) > 0)).cast("long").alias("lines"), F.size(F.filter(lines, lambda x: x.rlike("^\\S+\\.$"))).cast("long").alias("one_word"))


@query("""
SELECT e.event_id, CASE WHEN event_type = 'click' THEN greatest(value / 100.0, 0.85) ELSE value / 100.0 END AS score,
  NOT (event_type <> 'click' AND value / 100.0 < 0.85) AS valid,
  CASE WHEN event_type <> 'click' AND value / 100.0 < 0.85 THEN 'score lower than threshold' END AS invalid_reason FROM events e""")
def citation_validity(t):
    """Charts (clicks here) are kept at 0.85 at least; others under it are invalid, with the reason."""
    chart, s = Q("event_type") == "click", Q("value") / 100.0
    low = ~chart & (s < 0.85)
    return t("events").select("event_id", F.when(chart, F.greatest(s, F.lit(0.85))).otherwise(s).alias("score"), (~low).alias("valid"), F.when(low, "score lower than threshold").alias("invalid_reason"))


@query("""
SELECT event_id, value AS number FROM events WHERE value >= 9.0""")
def visual_candidates(t):
    """Rows whose text has a number of 9 or more after a colon, of either width."""
    shown = t("events").select("event_id", F.concat(F.when(Q("event_id") % 2 == 0, "score：").otherwise("score:"), Q("value").cast("string")).alias("label"))
    return shown.select("event_id", F.element_at(F.split("label", "[：:]", 2), -1).try_cast("double").alias("number")).where("number >= 9.0")


@query("SELECT o_orderkey, regexp_matches(CAST(o_orderkey AS VARCHAR) || '.' || o_orderpriority, '^\\d+(\\.\\d+)*$') AS bad, regexp_matches(CAST(o_orderkey AS VARCHAR), '^\\d+(\\.\\d+)*$') AS good FROM orders")
def section_id_format(t):
    form = "^\\d+(\\.\\d+)*$"
    return t("orders").select("o_orderkey", F.concat_ws(".", Q("o_orderkey").cast("string"), "o_orderpriority").rlike(form).alias("bad"), Q("o_orderkey").cast("string").rlike(form).alias("good"))
