"""Hierarchical numbering of Markdown headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def renumbered(docs: DataFrame) -> DataFrame:
    """doc_id, line, level and number (1, 1.2, ...) of each heading outside code fences, by running counts alone.

    A level's count starts anew after each shallower heading: islands of the running number of those.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "s"))
    w = Window.partitionBy("doc_id").orderBy("line")
    fenced = F.sum(F.col("s").rlike("^\\s*```").cast("int")).over(w) % 2
    heads = lines.withColumn("fenced", fenced).where("fenced = 0").select("doc_id", "line", "s", F.length(F.regexp_extract("s", "^(#{1,6}) ", 1)).alias("level")).where("level > 0")
    out = heads
    for k in range(1, 7):
        out = out.withColumn(f"_i{k}", F.sum((F.col("level") < k).cast("int")).over(w))
    for k in range(1, 7):
        own = Window.partitionBy("doc_id", f"_i{k}").orderBy("line")
        out = out.withColumn(f"_c{k}", F.sum((F.col("level") == k).cast("int")).over(own))
    top = F.min("level").over(Window.partitionBy("doc_id"))
    out = out.withColumn("_top", top)
    parts = F.array(*[F.when((F.lit(k) >= F.col("_top")) & (F.lit(k) <= F.col("level")), F.col(f"_c{k}").cast("string")) for k in range(1, 7)])
    return out.select("doc_id", "line", "level", F.array_join(F.filter(parts, lambda x: x.isNotNull()), ".").alias("number"), F.regexp_replace("s", "^#+\\s*", "").alias("title"))


def splits(docs: DataFrame) -> DataFrame:
    """doc_id, section, start (code points from 0) and text of the parts of a text that begin at lines `# `."""
    marked = F.split(F.regexp_replace("text", "(?m)^(# )", "\u001e$1"), "\u001e", -1)
    parts = docs.select("doc_id", F.posexplode(marked).alias("section", "text"))
    w = Window.partitionBy("doc_id").orderBy("section")
    start = F.sum(F.length("text")).over(w) - F.length("text")
    return parts.select("doc_id", "section", start.cast("long").alias("start"), "text")


#: Lines that open or close a block of code or of formulas, a heading with the number it has, and lines that are quotes or indented code.
FENCE, FORMULAS, NUMBERED, APART = "^ *```.*$", "^ *\\$\\$ *$", "^ *(#{1,3})(?!#) +([0-9.]*) *", "^(    |\\t)|^\\s*>"
BLOCK = 4096


def with_blocks(lines: DataFrame, block: int = BLOCK) -> DataFrame:
    """lines (doc_id, row, line) with `inside`: whether a line is within or at the edge of code or formulas.

    What a stretch of lines does to the two states is whether it turns each of them over; these compose by exclusive or. So each block
    of lines is counted by itself, the blocks of a text are folded in their order, and lines are counted again within their block: no task
    needs more of a text than a block of lines and one row for each of its blocks.
    """
    marked = lines.withColumn("_b", F.floor(F.col("row") / block)).withColumn("_f", F.col("line").rlike(FENCE).cast("int"))
    marked = marked.withColumn("_m", (F.col("line").rlike(FORMULAS) & (F.col("_f") == 0)).cast("int"))
    w = Window.partitionBy("doc_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    turns = marked.groupBy("doc_id", "_b").agg((F.sum("_f") % 2).alias("f"), (F.sum("_m") % 2).alias("m"))
    before = turns.select(F.col("doc_id").alias("_d"), F.col("_b").alias("_k"), *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_{c}0") for c in ("f", "m")])
    own = Window.partitionBy("doc_id", "_b").orderBy("row")
    joined = marked.join(before, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_b") == F.col("_k")))
    code, formulas = (F.sum(f"_{c}").over(own) + F.col(f"_{c}0") for c in ("f", "m"))
    return joined.withColumn("inside", (code % 2 == 1) | (formulas % 2 == 1) | (F.col("_f") + F.col("_m") > 0)).select(*lines.columns, "inside")


def numbered_lines(lines: DataFrame, block: int = BLOCK) -> DataFrame:
    """lines (doc_id, row, line) with the headings of levels 1 to 3 numbered anew; a number of the first level ends with a dot.

    Lines of code, formulas and quotes and indented lines stay. A level is counted from the last heading above it; where a text first skips a level
    that level counts as 1, where it skips one later as 0. Only headings are put in order; null lines are empty.
    """
    given = lines.withColumn("line", F.coalesce("line", F.lit("")))
    told = with_blocks(given, block)
    heads = told.where(~F.col("inside") & ~F.col("line").rlike(APART) & F.col("line").rlike(NUMBERED))
    heads = heads.select("doc_id", "row", F.length(F.regexp_extract("line", NUMBERED, 1)).alias("level"))
    w = Window.partitionBy("doc_id").orderBy("row")
    out = heads
    for k in (1, 2, 3):
        out = out.withColumn(f"_i{k}", F.sum((F.col("level") < k).cast("int")).over(w))
        out = out.withColumn(f"_s{k}", F.first(F.when(F.col("level") >= k, F.struct("level", f"_i{k}")), ignorenulls=True).over(w))
    for k in (1, 2, 3):
        counted = F.sum((F.col("level") == k).cast("int")).over(Window.partitionBy("doc_id", f"_i{k}").orderBy("row"))
        implied = (F.col(f"_s{k}.level") > k) & (F.col(f"_s{k}._i{k}") == F.col(f"_i{k}"))
        out = out.withColumn(f"_c{k}", counted + F.coalesce(implied, F.lit(False)).cast("int"))
    number = F.array_join(F.slice(F.array(*[F.col(f"_c{k}").cast("string") for k in (1, 2, 3)]), F.lit(1), F.col("level")), ".")
    new = F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), number, F.when(F.col("level") == 1, ".").otherwise(""), F.lit(" "))
    numbers = out.select(F.col("doc_id").alias("_d"), F.col("row").alias("_r"), new.alias("_new"))
    joined = given.join(numbers, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("row") == F.col("_r")), "left")
    line = F.when(F.col("_new").isNotNull(), F.concat("_new", F.regexp_replace("line", NUMBERED, ""))).otherwise(F.col("line"))
    return joined.withColumn("line", line).select(*lines.columns)


#: A heading of the first level, as sections begin, and the heading of a list of references.
H1, REFERENCES = "(?mdU)^#\\s+(.+)$", "(?i)#+\\s*[0-9.]*\\s*(参考文章|References)\\s*"


def sections_of(docs: DataFrame) -> DataFrame:
    """doc_id, section (from 0), title, start, end and content of what stands under each heading of the first level.

    start and end are code points in the whole text, end exclusive: `content` is that part of it. They are running lengths of what lies between
    headings and of the headings, so nothing is searched for again. A text without such a heading, or null, has no section; what is before the first is in none.
    """
    between, heads = F.split("text", H1, -1), F.regexp_extract_all("text", F.lit(H1), 0)
    parts = docs.select("doc_id", between.alias("_parts"), heads.alias("_heads"))
    lengths = F.transform("_heads", lambda h, i: F.length(F.get("_parts", i)) + F.length(h))
    one = parts.select("doc_id", "_parts", "_heads", lengths.alias("_n"), F.posexplode("_heads").alias("section", "_h"))
    start = F.aggregate(F.slice("_n", F.lit(1), F.col("section") + 1), F.lit(0).cast("long"), lambda a, x: a + x)
    content = F.get("_parts", F.col("section") + 1)
    title = F.regexp_replace(F.regexp_replace("_h", "(?U)^#\\s+", ""), "(?U)\\s+$", "")
    return one.select("doc_id", "section", title.alias("title"), start.alias("start"), (start + F.length(content)).alias("end"), content.alias("content"))


def body_and_references(text: Column) -> Column:
    """struct<body, references>: a text before and after its first heading of references, up to the next one; all of it and nothing where there is none."""
    parts = F.split(text, REFERENCES, -1)
    bare = lambda c: F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")
    return F.struct(bare(F.get(parts, F.lit(0))).alias("body"), F.coalesce(bare(F.get(parts, F.lit(1))), F.when(text.isNotNull(), F.lit(""))).alias("references"))
