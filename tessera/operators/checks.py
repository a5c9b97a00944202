"""Checks of texts and stored rows: section outlines, names, reports to be verified, changes that would clash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.charts import let

#: A citation of the form [[n]](url), and a name of a template.
NUMBERED_LINK = r"\[\[([^\]]+)\]\]\([^)]+\)"
TEMPLATE_NAME = r"^[\u4e00-\u9fa5a-zA-Z0-9_\-\.]+$"
LINE_ENDS = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x85\\u2028\\u2029]"


def section_outline_valid(text: Column, section: Column) -> Column:
    """Whether an outline has one title `n ...` or `n. ...`, parts from n.1 on, no third level and no other numbered line.

    Blank lines don't count; null text, null section and a text without parts are invalid.
    """
    n = section.cast("string")
    # a line is told once, by fixed expressions behind the number: one that holds it would be compiled for each line
    lines = F.transform(F.split(F.regexp_replace(text, LINE_ENDS, "\n"), "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")))
    numbered = lambda x, rest: x.startswith(n) & F.substr(x, F.length(n) + 1).rlike(rest)
    told = lambda x: F.struct(x.alias("x"), x.rlike("^\\d").alias("digit"), numbered(x, "^(\\.(?!\\d)\\s*|\\s+)(?!\\d)").alias("title"), numbered(x, "^\\.\\d").alias("part"))

    def valid(lines: Column) -> Column:
        parts = F.filter(lines, lambda x: ~x["title"] & x["part"])
        first = F.array_min(F.transform(parts, lambda x: F.regexp_extract(x["x"], "^\\d+\\.(\\d+)", 1).cast("decimal(38,0)")))
        stray = F.exists(lines, lambda x: x["digit"] & ~x["title"] & ~x["part"])
        return ~stray & (F.size(F.filter(lines, lambda x: x["title"])) == 1) & (first == 1)

    third = text.rlike("\\d+\\.\\d+\\.\\d+")
    return F.coalesce(~third & let(F.transform(lines, told), valid), F.lit(False))


def to_last_heading(text: Column) -> Column:
    """text up to the end of its last heading; all of it where there is none."""
    cut = F.regexp_extract(text, "(?s)^(.*(?<![^\\n])#{1,6}\\s[^\\n]+)", 1)
    return F.when(cut == "", text).otherwise(cut)


def citation_check(report: Column, n_sources: Column) -> Column:
    """struct<need_check, article>: a report with text and sources is checked, up to its last heading."""
    needed = F.coalesce((F.length(report) > 0) & (n_sources > 0), F.lit(False))
    return F.struct(needed.alias("need_check"), F.when(needed, to_last_heading(report)).alias("article"))


def without_numbered_links(text: Column) -> Column:
    """text without citations of the form [[n]](url)."""
    return F.regexp_replace(text, NUMBERED_LINK, "")


def template_name_valid(name: Column) -> Column:
    return F.coalesce(name.rlike(TEMPLATE_NAME), F.lit(False))


def lookup(df: DataFrame, **key) -> DataFrame:
    """The rows whose columns equal all values of key; a null value finds nothing, as in SQL."""
    for name, value in key.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def name_clashes(changes: DataFrame, stored: DataFrame, space: str, name: str, key: str) -> DataFrame:
    """The changes whose name another row of the same space has already."""
    bounds = [F.min(key).alias("_lo"), F.max(key).alias("_hi")]
    taken = stored.groupBy(F.col(space).alias("_space"), F.col(name).alias("_name")).agg(*bounds)
    same = (F.col(space) == F.col("_space")) & (F.col(name) == F.col("_name"))
    return changes.join(taken, same & ((F.col(key) != F.col("_lo")) | (F.col(key) != F.col("_hi"))), "left_semi")


def not_found(asked: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """The asked keys that no stored row has: deleting or changing them is an error."""
    return asked.join(stored.select(*keys).distinct(), keys, "left_anti")
