"""String and Markdown functions as Column expressions; positions are code points from 0 unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sentence ends, trailing punctuation and the citation marker of reports.
SENTENCE_ENDS = "。!！?？;；\\n"
TRAILING = "[\\s，。！？；：、,.;:!?]+$"
CITATION = "\\[\\s*citation:\\s*(\\d+)\\s*\\]"
LEADING_NUMBER = "^(?:\\d+(?:[.\\-\\s]\\d+)*|第?[一二三四五六七八九十\\d]+[、章])\\s*"
HEADER_NUMBER = "^[(（]?[一二三四五六七八九十0-9]+[.、)）]?\\s*"
#: What is white space to Unicode.
SPACES = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it: expressions with lambdas are worked out again at each place."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def sentences(text: Column) -> Column:
    """Stripped sentences, ends kept; a blank tail is dropped."""
    parts = F.transform(F.split(F.regexp_replace(text, f"([{SENTENCE_ENDS}])", "$1\u001e"), "\u001e"), strip)
    return once(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0)))).otherwise(p))


def without_trailing_marks(text: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(text, TRAILING, ""), CITATION, "")
    return F.regexp_replace(bare, TRAILING, "")


def without_links(text: Column) -> Column:
    """Markdown images and links removed, unless nothing would be left."""
    bare = strip(F.regexp_replace(text, "!?\\[[^\\]]*\\]\\([^)]*\\)", ""))
    return F.when(F.length(bare) > 0, bare).otherwise(text)


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def insert_after(text: Column, piece: Column, extra: Column) -> Column:
    """text with extra after the first occurrence of piece; unchanged where there is none."""
    at = F.instr(text, piece)
    end = at + F.length(piece) - 1
    return F.when((at > 0) & (F.length(piece) > 0), F.concat(F.substr(text, F.lit(1), end), extra, F.substr(text, end + 1, F.length(text)))).otherwise(text)


def strip_leading_number(text: Column) -> Column:
    return F.regexp_replace(text, LEADING_NUMBER, "")


def clean_headers(md: Column) -> Column:
    """Numbers off H1-H3; deeper headings become bold list items."""

    def line(x: Column) -> Column:
        marks = F.regexp_extract(x, "^\\s*(#+)\\s", 1)
        body = F.regexp_replace(strip(F.regexp_replace(x, "^\\s*#+\\s*", "")), HEADER_NUMBER, "")
        level = F.length(marks)
        return F.when(level.between(1, 3), F.concat(marks, F.lit(" "), body)).when(level > 3, F.concat(F.lit("- **"), body, F.lit("**"))).otherwise(x)

    return F.array_join(F.transform(F.split(md, "\n"), line), "\n")


def heading_level(line: Column) -> Column:
    return F.length(F.regexp_extract(strip(line), "^#+", 0))


def truncate(text: Column, most: int, suffix: str = "...") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substr(text, F.lit(1), F.lit(most)), F.lit(suffix))).otherwise(text)


def chunks(text: Column, size: int = 3000) -> Column:
    """array<struct<chunk,piece>> of fixed-length pieces; empty text gives none."""
    n = F.ceil(F.length(text) / size).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(i.alias("chunk"), F.substr(text, i * size + 1, F.lit(size)).alias("piece")))


def citation_numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(CITATION), F.lit(1)), lambda x: x.cast("int"))


def replace_citations(text: Column, mapping: Column) -> Column:
    """Every marker replaced at once by that of mapping (map<string,int>); unmapped ones go."""
    parts = F.split(text, CITATION, -1)
    marks = F.regexp_extract_all(text, F.lit(CITATION), F.lit(1))
    shown = F.transform(marks, lambda m: F.coalesce(F.concat(F.lit("[citation:"), F.try_element_at(mapping, m).cast("string"), F.lit("]")), F.lit("")))
    pairs = F.zip_with(parts, shown, lambda p, m: F.concat(p, F.coalesce(m, F.lit(""))))
    return F.array_join(pairs, "")


def label_weight(text: Column) -> Column:
    """Width of a label: a Chinese character counts two."""
    return F.length(text) + F.length(F.regexp_replace(text, "[^一-鿿]", ""))


def is_sensitive_key(key: Column) -> Column:
    return F.lower(key).rlike("key|url|token")


def bytes_shown(n: Column) -> Column:
    kb, mb = 1024.0, 1048576.0
    return F.when(n < kb, F.concat(n.cast("string"), F.lit(" B"))).when(n < mb, F.format_string("%.1f KB", n / kb)).otherwise(F.format_string("%.1f MB", n / mb))
