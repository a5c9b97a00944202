"""Server-sent events kept as text lines, and files of documents."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def messages(lines: DataFrame) -> DataFrame:
    """stream, message, event, id and data of the lines (stream, pos, line); a blank line ends a message, data lines are joined."""
    w = Window.partitionBy("stream").orderBy("pos")
    own = lines.withColumn("message", F.coalesce(F.sum((F.col("line") == "").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("line <> ''")
    field = own.select("stream", "message", "pos", F.regexp_extract("line", "^(event|data|id):", 1).alias("field"), F.regexp_replace("line", "^(event|data|id): ?", "").alias("value"))
    pick = lambda name: F.max_by(F.when(F.col("field") == name, F.col("value")), F.when(F.col("field") == name, F.col("pos")))
    data = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == "data", F.struct("pos", "value")))), lambda x: x["value"]), "\n")
    return field.groupBy("stream", "message").agg(pick("event").alias("event"), pick("id").alias("id"), data.alias("data"))


def text_of(kind: str, raw: bytes) -> str:
    """Markdown of a file: DOCX by its paragraph styles and tables, anything else as UTF-8 text."""
    if kind == "docx":
        import re
        from xml.etree import ElementTree

        ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
        body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml")).find(f"{ns}body")
        out = []

        def words(x) -> str:
            return "".join(t.text or "" for t in x.iter(f"{ns}t"))

        for x in body:
            if x.tag == f"{ns}p":
                style = x.find(f"{ns}pPr/{ns}pStyle")
                name = style.get(f"{ns}val") if style is not None else ""
                level = re.fullmatch(r"Heading ?(\d)", name)
                out.append(("#" * int(level[1]) + " " if level else "- " if name.startswith("List") else "") + words(x))
            elif x.tag == f"{ns}tbl":
                rows = [[words(c) for c in r.iter(f"{ns}tc")] for r in x.iter(f"{ns}tr")]
                out += [f"| {' | '.join(r)} |" for r in rows[:1]] + ["|" + " --- |" * len(rows[0])] * bool(rows) + [f"| {' | '.join(r)} |" for r in rows[1:]]
        return "\n".join(out)
    return raw.decode("utf-8", errors="replace")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path and text of files; text is null where a file can't be read as its suffix says."""
    files = spark.read.format("binaryFile").load(path).select("path", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("kind"), "content")

    def run(batches):
        for b in batches:
            texts = []
            for kind, raw in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                try:
                    texts.append(text_of(kind, raw))
                except (KeyError, ValueError, OSError, AttributeError, SyntaxError, zipfile.BadZipFile):
                    texts.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["path", "text"])

    return files.mapInArrow(run, "path string, text string")
