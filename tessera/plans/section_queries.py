"""Lines and sections of reports, insertion of charts, inference graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import nodes as N
from tessera.operators import sections as S
from tessera.plans.base import query

Q = F.col

LINES = "SELECT doc_id, i AS row, string_split(text, chr(10))[i] AS s FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS r(i)"
PREFIXES = ["", "> ", "- ", "| ", "```", "    ", ""]
ORDER_LINES = "SELECT o_orderkey AS doc_id, unnest(['# ' || o_orderpriority, o_orderstatus, '- item', 'end']) AS line, unnest([1, 2, 3, 4]) AS row FROM orders"


def order_reports(t):
    text = F.concat_ws("\n", F.concat(F.lit("# "), "o_orderpriority"), "o_orderstatus", F.lit("- item"), F.lit("end"))
    return t("orders").select(Q("o_orderkey").alias("doc_id"), text.alias("text"))


def item_plans(t):
    item = F.struct((Q("l_suppkey") % 6).cast("int").alias("after_row"), (Q("l_partkey") % 9).cast("int").alias("index"))
    rows = t("lineitem").select(Q("l_orderkey").alias("doc_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("at"), item.alias("i"))
    return rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "i"))), lambda x: x["i"]).alias("insertions"))


@query(f"""
WITH l AS (SELECT doc_id, row, {PREFIXES}[(row - 1) % 7 + 1] || s AS line FROM ({LINES})),
f AS (SELECT *, regexp_matches(line, '^\\s*(```|~~~)') AS fence FROM l),
g AS (SELECT *, sum(CAST(fence AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY row) % 2 = 1 AS inside FROM f)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (fence OR inside OR regexp_matches(line, '^(    |\\t)') OR regexp_matches(line, '^\\s*(>|\\||\\d+[.)]\\s+|[-*+]\\s+)')) AS BIGINT) AS n_forbidden FROM g GROUP BY doc_id""")
def forbidden_rows(t):
    mark = F.array(*map(F.lit, PREFIXES))
    made = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.get(mark, i % 7), x))
    rows = S.with_forbidden(S.lines_of(t("documents").select("doc_id", F.array_join(made, "\n").alias("text"))))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_rows"), F.count_if("forbidden").alias("n_forbidden"))


@query("""
WITH i AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos, l_suppkey % 6 AS r, l_partkey % 9 AS x FROM lineitem),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id, x ORDER BY pos) AS seen FROM i),
e AS (SELECT *, CASE WHEN r < 1 OR r > 4 OR doc_id NOT IN (SELECT o_orderkey FROM orders) THEN 'row out of range' WHEN r = 3 THEN 'forbidden row' WHEN x > 5 THEN 'unknown chart' WHEN seen > 1 THEN 'repeated chart' END AS error FROM s)
SELECT doc_id, min_by(error, pos) FILTER (error IS NOT NULL) AS error FROM e GROUP BY doc_id""")
def insert_plan_errors(t):
    charts = t("orders").select(Q("o_orderkey").alias("doc_id"), F.explode(F.array(*map(F.lit, range(6)))).alias("index"))
    return S.plan_errors(item_plans(t), order_reports(t), charts)


@query(f"""
WITH p AS (SELECT doc_id, row, CAST(-1 AS BIGINT) AS pos, line FROM ({ORDER_LINES}) UNION ALL SELECT l_orderkey, 1 + l_suppkey % 4, l_linenumber * 10000000 + l_partkey, '<' || l_partkey || '>' FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))
SELECT doc_id, string_agg(line, chr(10) ORDER BY row, pos, line) AS text FROM p GROUP BY doc_id""")
def insert_charts(t):
    block = F.concat(F.lit("<"), Q("l_partkey").cast("string"), F.lit(">"))
    rank = F.row_number().over(S.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    return S.with_charts(order_reports(t), t("lineitem").select(Q("l_orderkey").alias("doc_id"), (1 + Q("l_suppkey") % 4).alias("after_row"), rank.alias("pos"), block.alias("block")))


@query(f"""
WITH h AS (SELECT doc_id, row, repeat('#', CAST(1 + (row + doc_id) % 4 AS INTEGER)) || ' ' || s || '.' AS s FROM ({LINES})),
c AS (SELECT *, count(*) FILTER (s LIKE '# %') OVER (PARTITION BY doc_id) AS n FROM h)
SELECT doc_id, coalesce(string_agg(CASE WHEN n <= 1 THEN substr(s, 2) ELSE s END, chr(10) ORDER BY row) FILTER (CASE WHEN n <= 1 THEN s LIKE '## %' OR s LIKE '### %' ELSE s NOT LIKE '###%' END), '') AS headings FROM c GROUP BY doc_id""")
def template_promotion(t):
    made = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.repeat(F.lit("#"), (1 + (i + 1 + Q("doc_id")) % 4).cast("int")), F.lit(" "), x, F.lit(".")))
    return t("documents").where("text is not null").select("doc_id", S.promoted(F.array_join(made, "\n")).alias("headings"))


@query(f"""
WITH h AS (SELECT doc_id, row, CASE WHEN row = 1 THEN '# top' WHEN row % 3 = 0 THEN repeat('#', CAST(CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END + row % 4 AS INTEGER)) || ' ' || s || '.' ELSE 'x' || s || '.' END AS s FROM ({LINES})),
v AS (SELECT *, CASE WHEN s LIKE '#%' THEN length(regexp_extract(s, '^#+')) END AS level, count(*) FILTER (s LIKE '# %') OVER (PARTITION BY doc_id) = 1 AS one FROM h),
u AS (SELECT *, coalesce(last_value(level IGNORE NULLS) OVER w, 0) AS under, count(*) FILTER (level = 2) OVER w > 0 AS begun FROM v WINDOW w AS (PARTITION BY doc_id ORDER BY row))
SELECT doc_id, coalesce(string_agg(CASE WHEN one AND level IN (2, 3) THEN substr(s, 2) ELSE s END, chr(10) ORDER BY row) FILTER (CASE WHEN one THEN begun AND under < 4 ELSE under < 3 END), '') AS text FROM u GROUP BY doc_id""")
def shallow_headings(t):
    level = (F.when(Q("doc_id") % 2 == 0, 2).otherwise(1)).cast("int")
    made = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.when(i == 0, F.lit("# top")).when((i + 1) % 3 == 0, F.concat(F.repeat(F.lit("#"), (level + (i + 1) % 4).cast("int")), F.lit(" "), x, F.lit("."))).otherwise(F.concat(F.lit("x"), x, F.lit("."))),
    )
    return S.shallow(t("documents").where("text is not null").select("doc_id", F.array_join(made, "\n").alias("text")))


@query("""
WITH c AS (SELECT conv_id, turn, text, 'T: ' || replace(text, '#', '') AS t FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, md5(rtrim(t, chr(32) || chr(9) || chr(10) || chr(13))) AS body, CASE WHEN turn % 2 = 0 THEN '## Reference Articles' || chr(10) || '[1]' ELSE '' END AS removed FROM c WHERE turn % 2 = 0
UNION ALL SELECT conv_id, turn, md5(t), '' FROM c WHERE turn % 2 <> 0""")
def strip_references(t):
    made = F.concat(F.lit("T: "), F.replace("text", F.lit("#"), F.lit("")), F.when(Q("turn") % 2 == 0, "\n## Reference Articles\n[1] \n").otherwise(""))
    out = t("conversations").where("text is not null").select("conv_id", "turn", S.without_references(made).alias("r"))
    return out.select("conv_id", "turn", F.md5(Q("r.body").cast("binary")).alias("body"), "r.removed")


def conclusion_reports(t):
    """Reports of one H1 section for each supplier of a nation, and its suppliers' names as conclusions."""
    part = F.format_string("# S%d\nIt says %s.\n", "s_suppkey", "s_name")
    rows = t("supplier").groupBy(Q("s_nationkey").alias("doc_id")).agg(F.array_join(S.ordered_list("s_suppkey", part), "").alias("text"))
    return rows, t("supplier").select(Q("s_nationkey").alias("doc_id"), Q("s_name").alias("sentence"))


PARTS = """
WITH s AS (SELECT s_nationkey AS doc_id, s_suppkey, s_name, '# S' || s_suppkey || chr(10) || 'It says ' || s_name || '.' || chr(10) AS part, row_number() OVER w AS section, count(*) OVER (PARTITION BY s_nationkey) AS n,
  sum(length('# S' || s_suppkey || s_name) + 11) OVER w - length(s_name) - 2 AS pos FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)),
f AS (SELECT *, section > 2 AND section < n AS hit FROM s)"""


@query(PARTS + " SELECT doc_id, s_name AS sentence, CASE WHEN hit THEN section END AS section, CASE WHEN hit THEN CAST(pos AS BIGINT) END AS start, CASE WHEN hit THEN CAST(pos + length(s_name) AS BIGINT) END AS \"end\" FROM f")
def locate_conclusions(t):
    reports, sentences = conclusion_reports(t)
    return S.located(sentences, reports)


@query(PARTS + " SELECT doc_id, string_agg(CASE WHEN hit THEN '# S' || s_suppkey || chr(10) || 'It says [' || s_name || '](#inference:' || section || ').' || chr(10) ELSE part END, '' ORDER BY s_suppkey) AS text FROM f GROUP BY doc_id")
def mark_conclusions(t):
    reports, sentences = conclusion_reports(t)
    return S.marked(reports, S.located(sentences, reports).where("section is not null").withColumn("id", Q("section")))


@query("""
WITH o AS (SELECT o_custkey AS doc_id, o_orderkey % 3 AS section, list(o_orderkey ORDER BY o_orderkey) AS r FROM orders GROUP BY ALL), a AS (SELECT o_custkey AS doc_id, list(o_orderkey ORDER BY o_orderkey % 3, o_orderkey) AS r FROM orders GROUP BY ALL)
SELECT c_custkey AS doc_id, c_nationkey % 5 AS section, list_transform(coalesce(o.r, a.r, []), lambda x: CAST(x AS VARCHAR)) AS records FROM customer c LEFT JOIN o ON o.doc_id = c_custkey AND o.section = c_nationkey % 5 LEFT JOIN a ON a.doc_id = c_custkey""")
def section_records(t):
    c = t("customer").select(Q("c_custkey").alias("doc_id"), (Q("c_nationkey") % 5).alias("section"))
    return S.records_of_section(c, t("orders").select(Q("o_custkey").alias("doc_id"), (Q("o_orderkey") % 3).alias("section"), Q("o_orderkey").alias("pos"), Q("o_orderkey").cast("string").alias("title")))


@query("SELECT n1.n_nationkey AS src, n2.n_nationkey AS dst FROM nation n1 JOIN nation n2 ON n2.n_nationkey = (n1.n_nationkey * 7) % 25 WHERE n1.n_regionkey <> n2.n_regionkey")
def bridge_edges(t):
    proposed = t("nation").select(Q("n_nationkey").alias("src"), (Q("n_nationkey") * 7 % 25).alias("dst"))
    return N.bridges(proposed, t("nation").select(Q("n_nationkey").alias("id"), Q("n_regionkey").alias("component")))


HYPER = "SELECT l_orderkey AS edge_id, list(l_suppkey ORDER BY l_linenumber, l_suppkey) AS heads, max(l_partkey) AS tail FROM lineitem GROUP BY l_orderkey"


def hyper(t):
    heads = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: x["l_suppkey"])
    return t("lineitem").groupBy(Q("l_orderkey").alias("edge_id")).agg(heads.alias("heads"), F.lit("r").alias("relation"), F.max("l_partkey").alias("tail"))


@query(f"WITH h AS ({HYPER}), gone AS (SELECT * FROM h WHERE tail % 3 = 0) SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT tail FROM gone) AND p_partkey NOT IN (SELECT unnest(heads) FROM gone)")
def drop_subgraphs(t):
    parts = t("part").select(Q("p_partkey").alias("id"))
    return N.without_nodes(hyper(t), parts, parts.where("id % 3 = 0"))[1]


@query(f"""
WITH h AS ({HYPER}), x AS (SELECT edge_id, unnest(heads) AS h, tail, len(heads) > 1 AS many FROM h)
SELECT CAST(h AS VARCHAR) AS src, CASE WHEN many THEN 'e' || edge_id ELSE CAST(tail AS VARCHAR) END AS dst, CASE WHEN NOT many THEN 'r' END AS label FROM x
UNION ALL SELECT 'e' || edge_id, CAST(tail AS VARCHAR), 'r' FROM h WHERE len(heads) > 1""")
def draw_edges(t):
    return N.rendered(hyper(t))


@query(None)
def number_nodes(t):
    """Turns of each conversation, whole, as a chain of inferences over its records, with the last sentence of its last turn as conclusion.

    What a user says is said again at the turn after the next with a word more, so that statements are merged.
    """
    from tessera.operators.records import ordered_list

    own = t("conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    again = own.where("turn % 2 = 0").select("conv_id", (Q("turn") + 2).alias("turn"), F.concat(F.lit("so "), "text").alias("head"))
    ref = F.struct((Q("turn") % 3).cast("int").alias("ref"), F.lit(None).cast("string").alias("text"))
    said = F.struct(F.lit(None).cast("int").alias("ref"), F.coalesce("head", "text").alias("text"))
    step = F.struct(F.array(ref, said).alias("heads"), F.lit("supports").alias("relation"), Q("text").alias("tail"))
    last = F.element_at(X.sentences(F.max_by("text", "turn")), -1)
    rows = own.join(again, ["conv_id", "turn"], "left").groupBy(Q("conv_id").alias("inference_id")).agg(last.alias("conclusion"), ordered_list("turn", step).alias("edges"))
    record = F.array(*[F.struct(F.lit(f"t{i}").alias("title"), F.lit(f"http://u{i % 2}").alias("url")) for i in range(3)])
    return N.numbered(rows.withColumn("records", record))


@query(None)
def tag_fragments(t):
    """Two pieces of each turn, the second with a changed character, marked in it."""
    pieces = F.array(F.substring("text", 1, 12), F.concat(F.substring("text", 20, 15), F.lit("~")))
    return t("conversations").select("conv_id", "turn", N.tagged(Q("text"), pieces).alias("text"))
