"""Headings recovered from bookmarks; sections with offsets; line states."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import bookmarks as B
from tessera.operators import headers as H
from tessera.plans.base import query

Q = F.col


def page_lines(t):
    """The lines of each document in pages of 40."""
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("j", "text"))
    return lines.select("doc_id", F.floor(Q("j") / 40).alias("page"), Q("j").alias("line"), "text")


def page_marks(t, changed: bool):
    """Bookmarks made of lines: whole ones, two at once, some that no line completes; with changed, a letter of whole ones differs."""
    lines = t("documents").select("doc_id", F.split("text", "\n").alias("lines"))
    lines = lines.select("doc_id", "lines", F.posexplode("lines").alias("j", "s"))
    s, after = F.trim("s"), F.when((Q("j") % 40 < 39) & (Q("j") + 1 < F.size("lines")), F.trim(F.get("lines", Q("j") + 1))).otherwise("")
    title = F.overlay(s, F.lit("#"), F.lit(5)) if changed else s
    made = F.when(Q("j") % 5 == 1, title).when(Q("j") % 5 == 3, F.concat(s, after)).when(Q("j") % 11 == 7, F.concat(s, F.lit("x")))
    own = lines.select("doc_id", F.floor(Q("j") / 40).alias("page"), Q("j").alias("ord"), (Q("j") % 3).alias("level"), made.alias("title"), s.alias("own"))
    return own.where("title is not null and length(own) > 0").drop("own")


@query("""
WITH RECURSIVE ls AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, j // 40 AS page, j, trim(lines[j + 1]) AS s, CASE WHEN j % 40 < 39 AND j + 1 < len(lines) THEN trim(lines[j + 2]) ELSE '' END AS after FROM ls, unnest(range(len(lines))) AS r(j)),
m AS (SELECT doc_id, page, list({'level': j % 3 + 1, 'title': trim(title)} ORDER BY j) AS titles FROM (
  SELECT *, CASE WHEN j % 5 = 1 THEN s WHEN j % 5 = 3 THEN s || after WHEN j % 11 = 7 THEN s || 'x' END AS title FROM l WHERE s <> '') AS x WHERE title IS NOT NULL GROUP BY ALL),
p AS MATERIALIZED (SELECT l.doc_id, l.page, list(s ORDER BY j) AS lines, any_value(titles) AS titles FROM l LEFT JOIN m ON l.doc_id = m.doc_id AND l.page = m.page GROUP BY ALL),
w AS (
  SELECT doc_id, page, 0 AS r, 1 AS k, '' AS raw, CAST([] AS VARCHAR[]) AS held, CAST([] AS VARCHAR[]) AS out FROM p
  UNION ALL
  SELECT doc_id, page, r + 1, CASE WHEN act IN ('head', 'drop') THEN k + 1 ELSE k END, CASE act WHEN 'first' THEN s WHEN 'more' THEN raw || s WHEN 'past' THEN raw ELSE '' END,
    CASE act WHEN 'first' THEN [s] WHEN 'more' THEN list_append(held, s) ELSE CAST([] AS VARCHAR[]) END,
    CASE act WHEN 'head' THEN list_append(out, repeat('#', least(titles[k].level, 6)::INT) || ' ' || titles[k].title) WHEN 'first' THEN out WHEN 'more' THEN out WHEN 'drop' THEN list_append(list_concat(out, held), s) ELSE list_append(out, s) END
  FROM (
    SELECT w.*, p.lines[w.r + 1] AS s, p.titles, CASE WHEN p.titles[w.k] IS NULL THEN 'past' WHEN lower(p.lines[w.r + 1]) = lower(p.titles[w.k].title) AND p.titles[w.k].title <> '' THEN 'head'
      WHEN raw = '' AND starts_with(lower(p.titles[w.k].title), lower(p.lines[w.r + 1])) AND length(p.lines[w.r + 1]) > 8 THEN 'first'
      WHEN raw <> '' AND lower(raw || p.lines[w.r + 1]) = lower(p.titles[w.k].title) THEN 'head' WHEN raw <> '' AND starts_with(lower(p.titles[w.k].title), lower(raw || p.lines[w.r + 1])) THEN 'more'
      WHEN raw <> '' THEN 'drop' ELSE 'line' END AS act
    FROM w JOIN p ON w.doc_id = p.doc_id AND w.page = p.page AND w.r < len(p.lines)) AS x),
e AS (SELECT w.doc_id, w.page, CASE WHEN raw <> '' THEN list_append(out, repeat('#', least(p.titles[k].level, 6)::INT) || ' ' || p.titles[k].title) ELSE out END AS out
  FROM w JOIN p ON w.doc_id = p.doc_id AND w.page = p.page AND w.r = len(p.lines))
SELECT doc_id, page, CAST(i AS INT) AS place, out[i + 1] AS text FROM e, unnest(range(len(out))) AS r(i)""")
def recovered_headings(t):
    return B.headings_recovered(page_lines(t), page_marks(t, False), fuzzy=False)


@query(None)
def alike_headings(t):
    """The same where whole titles differ from their lines by a letter."""
    return B.headings_recovered(page_lines(t), page_marks(t, True))


def report_lines(t):
    """The lines of documents as a report: some begin or end code or formulas, some are headings of levels 1 to 3 with an old number, some quotes."""
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("row", "s"))
    k = F.length("s") % 13
    old = F.concat(F.repeat(F.lit("#"), (1 + Q("row") % 3).cast("int")), F.lit(" "), Q("row").cast("string"), F.lit(". "), F.regexp_replace("s", "^[0-9. ]+", ""))
    line = F.when(k == 0, "```").when(k == 1, "$$").when(k.between(2, 5), old).when(k == 6, F.concat(F.lit("> # "), "s")).otherwise(F.concat(F.lit("-"), "s"))
    return lines.select("doc_id", "row", line.alias("line"))


REPORT = """
l AS (SELECT doc_id, i - 1 AS row, string_split(text, chr(10))[i] AS s FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS r(i) WHERE text IS NOT NULL),
k AS (SELECT *, length(s) % 13 AS k, regexp_replace(s, '^[0-9. ]+', '') AS t FROM l),
f AS (SELECT *, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) OVER w % 2 = 1 OR sum(CASE WHEN k = 1 THEN 1 ELSE 0 END) OVER w % 2 = 1 AS inside, row % 3 + 1 AS level FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY row)),
h AS (SELECT * FROM f WHERE NOT inside AND k BETWEEN 2 AND 5)"""


@query(f"""
WITH RECURSIVE {REPORT},
n AS (SELECT doc_id, row, level, row_number() OVER (PARTITION BY doc_id ORDER BY row) AS n FROM h),
w AS (
  SELECT DISTINCT doc_id, CAST(-1 AS BIGINT) AS row, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS level, CAST(NULL AS BIGINT) AS c1, CAST(NULL AS BIGINT) AS c2, CAST(NULL AS BIGINT) AS c3 FROM n
  UNION ALL
  SELECT n.doc_id, n.row, n.n, n.level, CASE WHEN n.level = 1 THEN coalesce(c1, 0) + 1 ELSE coalesce(c1, 1) END,
    CASE WHEN n.level = 1 THEN CASE WHEN c2 IS NOT NULL THEN 0 END WHEN n.level = 2 THEN coalesce(c2, 0) + 1 ELSE coalesce(c2, 1) END,
    CASE WHEN n.level < 3 THEN CASE WHEN c3 IS NOT NULL THEN 0 END ELSE coalesce(c3, 0) + 1 END
  FROM w JOIN n ON n.doc_id = w.doc_id AND n.n = w.n + 1)
SELECT f.doc_id, CAST(f.row AS INTEGER) AS row, CASE WHEN w.row IS NOT NULL THEN repeat('#', w.level::INT) || ' ' || CASE w.level WHEN 1 THEN c1 || '.' WHEN 2 THEN c1 || '.' || c2 ELSE c1 || '.' || c2 || '.' || c3 END || ' ' || t
  WHEN k = 0 THEN '```' WHEN k = 1 THEN '$$' WHEN k BETWEEN 2 AND 5 THEN repeat('#', f.level::INT) || ' ' || f.row || '. ' || t WHEN k = 6 THEN '> # ' || s ELSE '-' || s END AS line
FROM f LEFT JOIN w ON f.doc_id = w.doc_id AND f.row = w.row""")
def numbered_reports(t):
    """Headings numbered anew on whole texts; blocks of eight lines, so that many texts lie in several."""
    return H.numbered_lines(report_lines(t), block=8)


@query("""
WITH l AS (SELECT doc_id, i, string_split(text, chr(10))[i] AS s FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS r(i) WHERE text IS NOT NULL),
m AS (SELECT doc_id, i, length(s) % 5 = 0 AND trim(s, ' ' || chr(9) || chr(13)) <> '' AS head, CASE WHEN length(s) % 5 = 0 THEN '# x' || s ELSE s END AS s FROM l),
p AS (SELECT doc_id, i, head OR s LIKE '# x%' AS head, s, sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS fin FROM m),
g AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g, max(fin) OVER (PARTITION BY doc_id) AS total FROM p)
SELECT doc_id, CAST(g - 1 AS INTEGER) AS section, CAST(min(fin) AS BIGINT) AS start, CAST(max(fin) + CASE WHEN max(fin) < any_value(total) THEN 1 ELSE 0 END AS BIGINT) AS "end",
  md5(coalesce(string_agg(s, chr(10) ORDER BY i) FILTER (NOT head), '')) AS lines, true AS same FROM g WHERE g > 0 GROUP BY doc_id, g""")
def report_sections(t):
    """Sections of documents some lines of which are headings: offsets, and that they give the content back from the whole text."""
    made = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.when(F.length(x) % 5 == 0, F.concat(F.lit("# x"), x)).otherwise(x)), "\n")
    docs = t("documents").where("text is not null").select("doc_id", made.alias("text"))
    cut = H.sections_of(docs).join(docs, "doc_id").withColumn("same", F.substr("text", (Q("start") + 1).cast("int"), (Q("end") - Q("start")).cast("int")) == Q("content"))
    lines = F.regexp_replace(F.regexp_replace("content", "^\n", ""), "\n$", "")
    last = F.when(Q("end") < F.length("text"), lines).otherwise(F.regexp_replace("content", "^\n", ""))
    return cut.select("doc_id", "section", "start", "end", F.md5(last.cast("binary")).alias("lines"), "same")
