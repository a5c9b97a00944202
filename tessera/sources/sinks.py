"""Sinks: metric tables as CSV, outlines as JSON, reports as HTML and DOCX, outlines as workbooks, tables over JDBC.

Reports are rendered a row at a time by pandas UDFs, on executors; one report or outline is one document of bounded
size. Files of formats that Spark doesn't write go out as a binary column, for any sink of the caller's.
"""

from __future__ import annotations

import html
import io
import re
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The marks of formulas that Markdown leaves alone.
DISPLAY, INLINE_MATH = r"\$\$(.+?)\$\$", r"(?<![\\$])\$(?!\s)([^$\n]+?)(?<!\s)\$(?!\d)"


def write_metrics(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as CSV with a header in a folder of its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{path.rstrip('/')}/{name}")


def write_outline(outlines: DataFrame, path: str) -> None:
    outlines.write.mode("overwrite").json(path)


def read_table(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8, **options) -> DataFrame:
    """A table of a relational store; with a numeric key and its bounds it is read in parallel."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return reader.load()


def write_table(df: DataFrame, url: str, table: str, mode: str = "append", **options) -> None:
    df.write.format("jdbc").option("url", url).option("dbtable", table).options(**options).mode(mode).save()


def inline_html(text: str) -> str:
    """A line's formulas, code, images, links and emphasis; everything else is escaped."""
    kept: list[str] = []

    def keep(shown: str) -> str:
        kept.append(shown)
        return f"\x00{len(kept) - 1}\x00"

    text = re.sub(r"`([^`]+)`", lambda m: keep(f"<code>{html.escape(m[1])}</code>"), text)
    text = re.sub(DISPLAY, lambda m: keep(f"\\[{html.escape(m[1])}\\]"), text)
    text = re.sub(INLINE_MATH, lambda m: keep(f"\\({html.escape(m[1])}\\)"), text)
    text = html.escape(text, quote=True)
    text = re.sub(r"!\[([^\]]*)\]\(([^)\s]+)\)", lambda m: keep(f'<img src="{m[2]}" alt="{m[1]}">') if safe(m[2]) else m[1], text)
    text = re.sub(r"\[([^\]]+)\]\(([^)\s]+)\)", lambda m: keep(f'<a href="{m[2]}">') + m[1] + "</a>" if safe(m[2]) else m[1], text)
    text = re.sub(r"\*\*(.+?)\*\*", r"<strong>\1</strong>", text)
    text = re.sub(r"(?<!\*)\*([^*]+)\*(?!\*)", r"<em>\1</em>", text)
    while "\x00" in text:
        text = re.sub("\x00(\\d+)\x00", lambda m: kept[int(m[1])], text)
    return text


def safe(url: str) -> bool:
    return not re.match(r"(?i)\s*(javascript|data|vbscript):", html.unescape(url))


def blocks(md: str) -> list[tuple]:
    """A Markdown text as (kind, ...) blocks: heading, code, table, item, quote, paragraph."""
    out, lines, i = [], md.split("\n"), 0
    while i < len(lines):
        line = lines[i]
        fence = re.match(r"\s*(```|~~~)\s*(\S*)", line)
        if fence:
            end = next((j for j in range(i + 1, len(lines)) if lines[j].strip().startswith(fence[1])), len(lines))
            out.append(("code", fence[2], "\n".join(lines[i + 1 : end])))
            i = end + 1
            continue
        if line.lstrip().startswith("|") and i + 1 < len(lines) and re.fullmatch(r"\s*\|[\s:|-]+\|?\s*", lines[i + 1]):
            end = next((j for j in range(i + 2, len(lines)) if not lines[j].lstrip().startswith("|")), len(lines))
            out.append(("table", [[c.strip() for c in x.strip().strip("|").split("|")] for x in [lines[i], *lines[i + 2 : end]]]))
            i = end
            continue
        if m := re.match(r"(#{1,6})\s+(.*)", line):
            out.append(("heading", len(m[1]), m[2].strip()))
        elif m := re.match(r"\s*(?:[-*+]|(\d+)[.)])\s+(.*)", line):
            out.append(("item", bool(m[1]), m[2]))
        elif m := re.match(r"\s*>\s?(.*)", line):
            out.append(("quote", m[1]))
        elif line.strip():
            if out and out[-1][0] == "paragraph" and i and lines[i - 1].strip():
                out[-1] = ("paragraph", out[-1][1] + "\n" + line)
            else:
                out.append(("paragraph", line))
        i += 1
    return out


def to_html(md: str | None, title: str = "") -> str | None:
    """A Markdown text as a page; mermaid blocks stay as such for the reader's script. Null stays null."""
    if md is None:
        return None
    body, open_list = [], None
    for kind, *x in blocks(md):
        wanted = ("ol" if x[0] else "ul") if kind == "item" else None
        if open_list != wanted:
            body += ([f"</{open_list}>"] if open_list else []) + ([f"<{wanted}>"] if wanted else [])
            open_list = wanted
        if kind == "heading":
            body.append(f"<h{x[0]}>{inline_html(x[1])}</h{x[0]}>")
        elif kind == "code":
            body.append(f'<pre class="mermaid">{html.escape(x[1])}</pre>' if x[0] == "mermaid" else f"<pre><code>{html.escape(x[1])}</code></pre>")
        elif kind == "table":
            row = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{inline_html(c)}</{tag}>" for c in cells) + "</tr>"
            body.append("<table>" + row(x[0][0], "th") + "".join(row(r, "td") for r in x[0][1:]) + "</table>")
        elif kind == "item":
            body.append(f"<li>{inline_html(x[1])}</li>")
        elif kind == "quote":
            body.append(f"<blockquote>{inline_html(x[0])}</blockquote>")
        else:
            body.append("<p>" + "<br>".join(map(inline_html, x[0].split("\n"))) + "</p>")
    if open_list:
        body.append(f"</{open_list}>")
    return f'<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body>\n' + "\n".join(body) + "\n</body></html>"


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def archive(parts: dict[str, str]) -> bytes:
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + content)
    return raw.getvalue()


def relations(**targets: tuple[str, str]) -> str:
    items = "".join(f'<Relationship Id="{k}" Type="{OFFICE}/{t}" Target="{f}"/>' for k, (t, f) in targets.items())
    return f'<Relationships xmlns="{PACKAGE}/relationships">{items}</Relationships>'


def content_types(kinds: dict[str, str]) -> str:
    items = "".join(f'<Override PartName="/{p}" ContentType="application/vnd.openxmlformats-officedocument.{k}+xml"/>' for p, k in kinds.items())
    return f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{items}</Types>'


def plain(text: str) -> str:
    """Text for XML: links as their title, no emphasis, no characters that XML lacks."""
    text = re.sub(r"\*\*(.+?)\*\*|`([^`]+)`", lambda m: m[1] or m[2], re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", text))
    return html.escape(re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", text), quote=False)


def to_docx(md: str | None) -> bytes | None:
    """A Markdown text as a word-processing file: headings, lists, quotes, code and tables by style. Null stays null."""
    if md is None:
        return None

    def para(text: str, style: str = "") -> str:
        runs = "<w:r><w:br/></w:r>".join(f'<w:r><w:t xml:space="preserve">{plain(x)}</w:t></w:r>' for x in text.split("\n"))
        return "<w:p>" + (f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else "") + runs + "</w:p>"

    body = []
    for kind, *x in blocks(md):
        if kind == "heading":
            body.append(para(x[1], f"Heading{x[0]}"))
        elif kind == "item":
            body.append(para(x[1], "ListNumber" if x[0] else "ListBullet"))
        elif kind == "table":
            body.append("<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{para(c)}</w:tc>" for c in r) + "</w:tr>" for r in x[0]) + "</w:tbl>")
        else:
            body.append(para(x[-1], {"code": "Code", "quote": "Quote"}.get(kind, "")))
    return archive({
        "[Content_Types].xml": content_types({"word/document.xml": "wordprocessingml.document.main"}),
        "_rels/.rels": relations(r1=("officeDocument", "word/document.xml")),
        "word/document.xml": f"<w:document {W}><w:body>{''.join(body)}</w:body></w:document>",
    })


def merged_runs(rows: list[list], columns: int) -> list[tuple[int, int, int]]:
    """(column, first row, last row) of runs of equal values in the first columns; a run ends where one to its left does."""
    out, breaks = [], {0}
    for c in range(min(columns, len(rows[0]) if rows else 0)):
        breaks = breaks | {i for i in range(1, len(rows)) if rows[i][c] != rows[i - 1][c]}
        starts = [*sorted(breaks), len(rows)]
        out += [(c, a, b - 1) for a, b in zip(starts, starts[1:], strict=False) if b - a > 1]
    return out


def letter(c: int) -> str:
    return (letter(c // 26 - 1) if c >= 26 else "") + chr(65 + c % 26)


def to_workbook(sheets: dict[str, tuple[list[str], list[list], int]]) -> bytes:
    """A workbook; each sheet has a header, rows and the number of leading columns whose runs are merged."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    parts, kinds, names = {}, {"xl/workbook.xml": "spreadsheetml.sheet.main"}, []
    for n, (name, (header, rows, merge)) in enumerate(sheets.items(), 1):
        cell = lambda r, c, v: f'<c r="{letter(c)}{r}"><v>{v}</v></c>' if isinstance(v, (int, float)) and not isinstance(v, bool) else f'<c r="{letter(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{plain("" if v is None else str(v))}</t></is></c>'
        data = "".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate([header, *rows], 1))
        runs = merged_runs(rows, merge)
        merges = f'<mergeCells count="{len(runs)}">' + "".join(f'<mergeCell ref="{letter(c)}{a + 2}:{letter(c)}{b + 2}"/>' for c, a, b in runs) + "</mergeCells>" if runs else ""
        parts[f"xl/worksheets/sheet{n}.xml"] = f"<worksheet {ns}><sheetData>{data}</sheetData>{merges}</worksheet>"
        kinds[f"xl/worksheets/sheet{n}.xml"] = "spreadsheetml.worksheet"
        names.append(f'<sheet name="{plain(name)[:31]}" sheetId="{n}" r:id="r{n}"/>')
    return archive({
        "[Content_Types].xml": content_types(kinds), "_rels/.rels": relations(r1=("officeDocument", "xl/workbook.xml")),
        "xl/workbook.xml": f'<workbook {ns} xmlns:r="{OFFICE}"><sheets>{"".join(names)}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": relations(**{f"r{n}": ("worksheet", f"worksheets/sheet{n}.xml") for n in range(1, len(names) + 1)}), **parts,
    })


def _each(f, text: Column, kind: str) -> Column:
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([f(v) for v in x], dtype=object)

    return F.pandas_udf(run, kind)(text)


def html_of(text: Column) -> Column:
    return _each(to_html, text, "string")


def docx_of(text: Column) -> Column:
    return _each(to_docx, text, "binary")


def encoded(text: Column) -> Column:
    """Base64 of a text; a text that doesn't come back the same gives null."""
    out = F.base64(F.encode(text, "UTF-8"))
    return F.when(F.decode(F.unbase64(out), "UTF-8") == text, out)


def decoded(text: Column) -> Column:
    """Text of Base64, or the text as it is where it is none."""
    return F.coalesce(F.try_to_binary(text, F.lit("base64")).cast("string"), text)
