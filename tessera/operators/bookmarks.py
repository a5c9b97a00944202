"""Headings recovered from bookmarks: the titles of a page's bookmarks found again among its lines, in order."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.fuzzy import ratio_reaches
from tessera.operators.records import ordered_list

#: How alike, and of how like lengths, a line and a title are; what a first piece of a title has more characters than.
ALIKE, LENGTHS, PIECE = 90.0, 0.9, 8


def by_page(bookmarks: DataFrame) -> DataFrame:
    """doc_id, page and titles (level from 1, title without outer blanks; in the order of `ord`) of bookmarks (doc_id, page, ord, level from 0, title)."""
    own = F.struct((F.col("level") + 1).cast("int").alias("level"), F.trim("title").alias("title"))
    return bookmarks.groupBy("doc_id", "page").agg(ordered_list("ord", own).alias("titles"))


def alike(line: str, title: str) -> bool:
    """Whether a line and a title are of like lengths and, but for case, of a ratio of ALIKE or more."""
    short, long = sorted((len(line), len(title)))
    return short > 0 and short / long > LENGTHS and ratio_reaches(line.lower(), title.lower(), ALIKE)


def aligned(lines: list[str], titles: list[dict], fuzzy: bool) -> list[str]:
    """The walk over a page's lines. A line is compared with the next title only, so a page costs as many likenesses as it has lines at most."""
    k, raw, held, out = 0, "", [], []  # the next title, what is stitched of it, the lines stitched so far, lines put out

    def heading() -> str:
        level = titles[k]["level"]
        return "#" * (6 if level is None else min(level, 6)) + " " + titles[k]["title"]

    for s in lines:
        title = titles[k]["title"] if k < len(titles) else None
        if title is None:
            out.append(s)
            continue
        low, want, new = s.lower(), title.lower(), (raw + s).lower()
        if low == want != "" or (fuzzy and alike(s, title)) or (raw and new == want):
            out.append(heading())
            k, raw, held = k + 1, "", []
        elif (not raw and want.startswith(low) and len(s) > PIECE) or (raw and want.startswith(new)):
            raw, held = raw + s, [*held, s]
        elif raw:
            out += [*held, s]
            k, raw, held = k + 1, "", []
        else:
            out.append(s)
    return [*out, heading()] if raw else out


def with_headings(lines: str, titles: str, fuzzy: bool) -> F.Column:
    """aligned as a column, worked out once: taken for deterministic, it would be again for the filter that explode brings along."""

    def run(left, right):
        return pa.array([aligned(s.as_py(), t.as_py(), fuzzy) for s, t in zip(left, right, strict=True)], pa.list_(pa.string()))

    run.__annotations__ = {"left": pa.Array, "right": pa.Array, "return": pa.Array}  # arrow_udf reads them, and not as strings
    return F.arrow_udf(run, "array<string>").asNondeterministic()(lines, titles)


def headings_recovered(lines: DataFrame, bookmarks: DataFrame, fuzzy: bool = True) -> DataFrame:
    """doc_id, page, place (from 0) and text: the lines of pages (doc_id, page, line, text) with the titles of bookmarks as headings.

    On each page the titles are looked for in their order. A line like the next title (but for case; with fuzzy, of a ratio of 90 among
    like lengths) becomes its heading. A line of more than 8 characters that begins the next title is a first piece; the lines after it
    are added as long as they continue the title. When they complete it they become the heading; when they don't, the pieces stay lines and
    that title is given up. A page that ends within a title gets its heading. Lines are trimmed, null ones are empty; a page without
    bookmarks keeps its lines, bookmarks of a page without lines are nowhere. A page is one row: its lines and titles meet in one task.
    """
    text = F.trim(F.coalesce("text", F.lit("")))
    pages = lines.groupBy("doc_id", "page").agg(ordered_list("line", text).alias("lines"))
    marks = by_page(bookmarks).withColumnsRenamed({"doc_id": "_d", "page": "_p"})
    both = pages.join(marks, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("page").eqNullSafe(F.col("_p")), "left").drop("_d", "_p")
    both = both.withColumn("titles", F.coalesce("titles", F.array().cast("array<struct<level:int,title:string>>")))
    return both.select("doc_id", "page", with_headings("lines", "titles", fuzzy).alias("out")).select("doc_id", "page", F.posexplode("out").alias("place", "text"))
