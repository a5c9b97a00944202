"""Citations of reports: inline links, greedy collapse of neighbours, numbering, validity, reference lists."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.records import ordered_list

#: Fixed value: the inline form of a traced citation, [source_tracer_result](!)?[title](url).
INLINE = r"\[source_tracer_result\](!)?\[([^\]]*)\]\(<?([^)>]*)>?\)"


def inline_links(text: Column) -> Column:
    """array<struct<image,title,url>> of the citations of a paragraph, in order."""
    marks = [F.regexp_extract_all(text, F.lit(INLINE), F.lit(g)) for g in (1, 2, 3)]
    return F.transform(F.arrays_zip(marks[0].alias("a"), marks[1].alias("b"), marks[2].alias("c")), lambda x: F.struct((x["a"] == "!").alias("image"), x["b"].alias("title"), x["c"].alias("url")))


def numbered(refs: DataFrame, report: str, key: str, pos: str) -> DataFrame:
    """refs with `ref`, the place of the key's first appearance in its report, from 1."""
    first = F.min(pos).over(Window.partitionBy(report, key))
    return refs.withColumn("_f", first).withColumn("ref", F.dense_rank().over(Window.partitionBy(report).orderBy("_f", key))).drop("_f")


def reference_list(refs: DataFrame, report: str) -> DataFrame:
    """[n] [title](url) lines of each report; refs: report, ref, title, url, pos; the first title counts."""
    one = refs.groupBy(report, "ref").agg(F.min_by("title", "pos").alias("title"), F.min_by("url", "pos").alias("url"))
    line = F.format_string("[%d]. [%s](%s)", "ref", "title", "url")
    return one.groupBy(report).agg(F.array_join(ordered_list("ref", line), "\n").alias("references"))


def frontend_rows(citations: DataFrame) -> DataFrame:
    """Valid citations that aren't images, numbered from 0 in each report, with where they come from."""
    kept = citations.where(F.col("valid") & ~F.coalesce("is_image", F.lit(False)))
    return kept.withColumn("id", F.row_number().over(Window.partitionBy("report").orderBy("pos")) - 1).withColumn("from", F.when(F.col("url").startswith("http"), "web").otherwise("local"))


def collapse(rows: list[dict], text: str) -> list[bool]:
    """Which citations of a paragraph stay: neighbours of one url, two characters apart at most or with nothing but
    citations and spaces between, leave the one of the higher score, the earlier of equals. Another gap starts anew."""
    keep, anchor = [True] * len(rows), {}
    for i, r in enumerate(rows):
        j = anchor.get(r["url"])
        if j is not None:
            between = text[rows[j]["end"] : r["start"]]
            near = len(between) <= 2 or not re.sub(INLINE, "", between).strip()
            if near:
                if r["score"] > rows[j]["score"]:
                    keep[j] = False
                else:
                    keep[i] = False
                    # the kept one's reach goes on behind the dropped one
                    rows[j] = rows[j] | {"end": r["end"]}
                    continue
        anchor[r["url"]] = i
    return keep


def collapsed(citations: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """citations (para, start, end, url, score) with `kept`; order matters, so each paragraph is one small group."""

    def run(key, frame):
        rows = frame.sort_values("start")
        kept = collapse(rows[["url", "start", "end", "score"]].to_dict("records"), rows["text"].iloc[0] or "")
        return rows.drop(columns="text").assign(kept=kept)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in citations.schema) + ", kept boolean"
    return citations.join(paragraphs.select("para", "text"), "para").select(*citations.columns, "text").groupBy("para").applyInPandas(run, schema)
