"""Reference lists of many sections brought to one numbering, and paragraphs rebuilt with their valid citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.citations import INLINE, numbered, reference_list
from tessera.operators.records import ordered_list


def renumbered_lists(raw: DataFrame) -> DataFrame:
    """doc_id, key, ref and content of each line `[n] content`: key is paragraph-n, ref the first appearance's place, from 1.

    A blank line begins a paragraph, and so does one of [1]; other lines are skipped.
    """
    lines = raw.select("doc_id", F.posexplode(F.split("text", "\n")).alias("row", "line")).withColumn("line", F.trim(F.regexp_replace("line", "[\\s]+", " ")))
    w = Window.partitionBy("doc_id").orderBy("row")
    begins = (F.col("line") == "") | F.col("line").startswith("[1]")
    n = F.regexp_extract("line", "^\\[(\\d+)\\]", 1)
    rows = lines.withColumn("para", F.sum(begins.cast("int")).over(w)).withColumn("n", n).where("n <> ''")
    rows = rows.select("doc_id", "row", F.concat_ws("-", F.col("para").cast("string"), F.col("n").cast("int").cast("string")).alias("key"), F.trim(F.regexp_replace("line", "^\\[\\d+\\]\\s*", "")).alias("content"))
    return numbered(rows, "doc_id", "content", "row").select("doc_id", "row", "key", "ref", "content")


def merged_list(refs: DataFrame) -> DataFrame:
    """doc_id and references, `[n] content` lines a blank line apart."""
    one = refs.groupBy("doc_id", "ref").agg(F.first("content").alias("content"))
    return one.groupBy("doc_id").agg(F.array_join(ordered_list("ref", F.format_string("[%d] %s", "ref", "content")), "\n\n").alias("references"))


def rebuilt(paragraphs: DataFrame, citations: DataFrame) -> DataFrame:
    """doc_id and text of all paragraphs, with the inline citations that are valid as their rows say, the others removed.

    paragraphs: doc_id, para, text; citations: doc_id, idx (from 0, in the order of the markers), valid, is_image, title, url.
    Markers beyond the rows are removed.
    """
    pieces = F.split("text", INLINE, -1)
    parts = paragraphs.select("doc_id", "para", F.posexplode(pieces).alias("i", "piece"), F.size(pieces).alias("n"))
    w = Window.partitionBy("doc_id").orderBy("para", "i")
    marked = parts.withColumn("is_marker", F.col("i") < F.col("n") - 1).withColumn("idx", F.sum((F.col("i") < F.col("n") - 1).cast("int")).over(w) - 1)
    link = F.concat(F.when(F.coalesce("is_image", F.lit(False)), "!").otherwise(""), F.format_string("[source_tracer_result][%s](%s)", "title", "url"))
    rows = citations.where("valid").select("doc_id", F.col("idx").cast("long").alias("idx"), link.alias("link"))
    full = marked.join(rows, ["doc_id", "idx"], "left").withColumn("part", F.concat("piece", F.when(F.col("is_marker"), F.coalesce("link", F.lit(""))).otherwise("")))
    text = full.groupBy("doc_id", "para").agg(F.array_join(ordered_list("i", "part"), "").alias("text"))
    return text.groupBy("doc_id").agg(F.array_join(ordered_list("para", "text"), "\n").alias("text"))


def with_reference_section(paragraphs: DataFrame, citations: DataFrame) -> DataFrame:
    """rebuilt, and under it the list of its valid sources, each url once, numbered as they appear."""
    kept = citations.where("valid").withColumnRenamed("doc_id", "report").withColumnRenamed("idx", "pos")
    lists = reference_list(numbered(kept, "report", "url", "pos"), "report").withColumnRenamed("report", "doc_id")
    body = rebuilt(paragraphs, citations).join(lists, "doc_id", "left")
    return body.select("doc_id", F.concat_ws("\n\n", "text", "references").alias("text"))
