"""URL filters: explicit rules, then a path-template tree. DataFrame functions only.

Urls that no rule fits are judged by their template. Per host, path segments are read from the root; digits in a segment
are one sign. Under a parent, segments that vary (many values, few urls each) become a wildcard, and branches whose
labelled share of blocked urls doesn't differ from their siblings' (|z| < 2) are merged; a branch that doesn't fork is
one node. Labels are the rules' own verdicts. A node's purity is its labelled share of blocked urls, smoothed by that of
what is above it: (blocked + alpha * purity above) / (labelled + alpha), from all urls to the last label of the host, the
host, and down its tree. So a template without labels has its ancestors' purity. It is rejected from `reject` on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, UPPER, cut

#: (verdict, host, path) of the production rules.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def parsed(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null or without ://."""
    at = F.instr(url, "://")
    rest = F.substr(url, at + 3, F.length(url))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    have = url.isNotNull() & (at > 0)
    return F.when(have, F.translate(raw, UPPER, LOWER)).otherwise(""), F.when(have, path).otherwise("")


def ruled(host: Column, path: Column, rules=RULES) -> Column:
    """struct<verdict, rule> of the longest rule (host and path) that fits, or null; of two alike, the last."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def smoothed(blocked: Column, labelled: Column, above: Column, alpha: float) -> Column:
    return (blocked + alpha * above) / (labelled + alpha)


def templates(shapes: DataFrame, alpha: float, distinct: int = 8, each: float = 4.0, z: float = 2.0) -> DataFrame:
    """(host, segs, template, purity) of shapes (host, segs, n, labelled, blocked), level by level as far as paths fork."""
    add = lambda *by: shapes.groupBy(*by).agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
    sums = shapes.agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")).first()
    prior = F.lit((sums.blocked or 0) / sums.labelled if sums.labelled else 0.0)
    suffix = F.substring_index("host", ".", -1).alias("suffix")
    hosts = add("host").select("host", suffix, "l", "b").join(add(suffix).select("suffix", smoothed(F.col("b"), F.col("l"), prior, alpha).alias("p")), "suffix")
    hosts = hosts.select("host", smoothed(F.col("b"), F.col("l"), F.col("p"), alpha).alias("purity"))
    out = cut(shapes.join(hosts, "host").withColumn("template", F.lit("")).withColumn("deep", F.size("segs") > 0), "shapes")
    done, d = None, 0
    while True:
        ended = out.where(~F.col("deep")).select("host", "segs", "template", "purity")
        done = ended if done is None else done.unionByName(ended)
        left = out.where("deep")
        if left.isEmpty():
            return done
        seg = F.get("segs", F.lit(d))
        child = cut(left.groupBy("host", "template", seg.alias("seg")).agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")], F.count("*").alias("shapes")), "branches")
        parent = child.groupBy("host", "template").agg(
            F.count("*").alias("kids"), F.sum("n").alias("pn"), F.sum("labelled").alias("pl"), F.sum("blocked").alias("pb"), F.count_if(F.col("labelled") > 0).alias("lk"), F.sum("shapes").alias("all")
        )
        rate = F.try_divide("pb", "pl")
        error = F.sqrt(F.try_divide(F.greatest(rate * (1 - rate), F.lit(1e-9)), "labelled"))
        similar = (F.col("labelled") > 0) & (F.col("lk") > 1) & (F.abs(F.try_divide("blocked", "labelled") - rate) < z * error + 1e-9)
        varies = (F.col("kids") > distinct) & (F.col("pn") / F.col("kids") < each)
        token = F.when(varies | F.coalesce(similar, F.lit(False)), "*").otherwise(F.col("seg"))
        known = child.join(parent, ["host", "template"]).select("host", "template", "seg", F.concat("template", F.lit("/"), token).alias("down"), "labelled", "blocked", (F.col("all") == 1).alias("alone"))
        nodes = known.groupBy("host", "down").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
        known = known.select("host", "template", "seg", "down", "alone").join(nodes, ["host", "down"])
        rest = F.concat("template", F.lit("/"), F.array_join(F.slice("segs", d + 1, 1 << 30), "/"))
        named = left.withColumn("seg", seg).join(known, ["host", "template", "seg"])
        out = named.select("host", "segs", "n", "labelled", "blocked", smoothed(F.col("b"), F.col("l"), F.col("purity"), alpha).alias("purity"), F.when(F.col("alone"), rest).otherwise(F.col("down")).alias("template"), (~F.col("alone") & (F.size("segs") > d + 1)).alias("deep"))
        out, d = cut(out, "shapes"), d + 1


def judge_urls(pages: DataFrame, rules=RULES, alpha: float = 2.0, reject: float = 0.8) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of each row; template and purity are null where a rule decides.

    Null urls and those without :// have an empty host and path and are a template of their own. Without any label the
    purity is 0. Paths may be of any depth. Repeated rows stay. An empty table gives no rows. Other columns are ignored.
    """
    host, path = parsed(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("r", ruled(F.col("host"), F.col("path"), rules))
    segs = F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), lambda s: F.regexp_replace(s, "[0-9]+", "#"))
    rows = rows.select("page_id", "host", "path", "r", segs.alias("segs"))
    verdict = F.col("r.verdict")
    shapes = rows.groupBy("host", "segs").agg(F.count("*").alias("n"), F.count(verdict).alias("labelled"), F.count_if(verdict == "block").alias("blocked"))
    out = rows.join(templates(cut(shapes, "shapes"), alpha), ["host", "segs"])
    free = F.col("r").isNull()
    purity = F.round("purity", 9)
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(verdict, F.when(purity >= reject, "block").otherwise("allow")).alias("verdict"), F.when(free, F.col("template")).alias("template"), F.when(free, purity).alias("purity"))


SQL = """
WITH RECURSIVE cutup AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(instr(url, '://'), 0) AS mark FROM pages),
raw AS (
  SELECT page_id, regexp_extract(substr(url, mark + 3), '^[^/?#]*') AS h, substr(url, mark + 3) AS rest, mark > 0 AS have FROM cutup),
parsed AS (
  SELECT page_id, CASE WHEN have THEN translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN have THEN regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') ELSE '' END AS path FROM raw),
ruled AS (
  SELECT *, CASE
      WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
      WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
      WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule,
    list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: regexp_replace(s, '[0-9]+', '#', 'g')) AS segs
  FROM parsed),
verdicts AS (SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS given FROM ruled),
shapes AS (SELECT host, segs, count(*) AS n, count(given) AS l, count(*) FILTER (given = 'block') AS b FROM verdicts GROUP BY host, segs),
suffixes AS (SELECT *, regexp_extract(host, '[^.]*$') AS suffix, coalesce(sum(b) OVER () / nullif(sum(l) OVER (), 0), 0.0) AS prior FROM shapes),
bysuffix AS (SELECT *, (sum(b) OVER (PARTITION BY suffix) + 2.0::DOUBLE * prior) / (sum(l) OVER (PARTITION BY suffix) + 2.0::DOUBLE) AS ps FROM suffixes),
tree AS (
  SELECT host, segs, n, l, b, '' AS template, (sum(b) OVER (PARTITION BY host) + 2.0::DOUBLE * ps) / (sum(l) OVER (PARTITION BY host) + 2.0::DOUBLE) AS purity, 0 AS d, len(segs) > 0 AS deep
  FROM bysuffix
  UNION ALL
  SELECT host, segs, n, l, b, CASE WHEN alone THEN template || '/' || array_to_string(list_slice(segs, d + 1, len(segs)), '/') ELSE down END,
    (sum(b) OVER (PARTITION BY host, down) + 2.0::DOUBLE * purity) / (sum(l) OVER (PARTITION BY host, down) + 2.0::DOUBLE), d + 1, NOT alone AND len(segs) > d + 1
  FROM (
    SELECT *, template || '/' || CASE WHEN (kids > 8 AND pn / kids < 4.0) OR (cl > 0 AND lk > 1 AND abs(cb / cl - pb / pl) < 2.0 * sqrt(greatest((pb / pl) * (1 - pb / pl), 1e-9) / cl) + 1e-9) THEN '*' ELSE seg END AS down
    FROM (
      SELECT *, sum(CASE WHEN place = 1 THEN 1 ELSE 0 END) OVER up AS kids, sum(CASE WHEN place = 1 AND cl > 0 THEN 1 ELSE 0 END) OVER up AS lk,
        sum(n) OVER up AS pn, sum(l) OVER up AS pl, sum(b) OVER up AS pb, count(*) OVER up = 1 AS alone
      FROM (
        SELECT *, segs[d + 1] AS seg, row_number() OVER (PARTITION BY host, template, segs[d + 1]) AS place,
          sum(l) OVER (PARTITION BY host, template, segs[d + 1]) AS cl, sum(b) OVER (PARTITION BY host, template, segs[d + 1]) AS cb
        FROM tree WHERE deep) AS x
      WINDOW up AS (PARTITION BY host, template)) AS y) AS z)
SELECT page_id, v.host, path, rule, coalesce(given, CASE WHEN round(purity, 9) >= 0.8 THEN 'block' ELSE 'allow' END) AS verdict,
  CASE WHEN rule IS NULL THEN template END AS template, CASE WHEN rule IS NULL THEN round(purity, 9) END AS purity
FROM verdicts AS v JOIN (SELECT host, segs, template, purity FROM tree WHERE NOT deep) AS t ON v.host = t.host AND v.segs = t.segs
"""
