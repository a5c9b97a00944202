"""Sinks: what is written reads back."""

import io
import zipfile

from pyspark.sql import functions as F

from tessera.sources import sinks as K
from tessera.sources.sse import read_files

MD = '# Title & co\n\npara **bold** [a](http://x?a=1&b=2) [bad](javascript:alert(1))\nnext $x<y$\n\n- one\n- `t<wo`\n1. n\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```mermaid\npie\n```\n> said\n'


def test_html(spark):
    page = K.to_html(MD, "T")
    for piece in ("<h1>Title &amp; co</h1>", "<strong>bold</strong>", '<a href="http://x?a=1&amp;b=2">a</a>', "<ul>\n<li>one</li>\n<li><code>t&lt;wo</code></li>\n</ul>\n<ol>\n<li>n</li>\n</ol>", "<tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr>", '<pre class="mermaid">pie</pre>', "<blockquote>said</blockquote>", "\\(x&lt;y\\)"):
        assert piece in page, piece
    assert "javascript" not in page and K.to_html(None) is None and "<script>" not in K.to_html("<script>x</script>")
    rows = spark.createDataFrame([(MD,), (None,), ("",)], "t string").select(K.html_of(F.col("t")).alias("h")).collect()
    assert rows[0].h.count("<p>") == 1 and rows[1].h is None and "<body>\n\n</body>" in rows[2].h


def test_docx_reads_back(spark, tmp_path):
    raw = spark.createDataFrame([(MD,)], "t string").select(K.docx_of(F.col("t")).alias("d")).first().d
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.docx").write_bytes(raw)
    text = read_files(spark, str(tmp_path / "d")).first().text
    assert text.startswith("# Title & co\n") and "- one\n- t<wo" in text and "| 1 | 2 |" in text


def test_workbook():
    rows = [["s1", "p1", 1], ["s1", "p1", 2], ["s2", "p1", None]]
    assert K.merged_runs(rows, 2) == [(0, 0, 1), (1, 0, 1)] and K.merged_runs([], 2) == [] and K.letter(27) == "AB"
    z = zipfile.ZipFile(io.BytesIO(K.to_workbook({"a&b": (["s", "p", "n"], rows, 2), "sum": (["n"], [], 0)})))
    sheet = z.read("xl/worksheets/sheet1.xml").decode()
    assert '<mergeCell ref="A2:A3"/>' in sheet and '<c r="C2"><v>1</v></c>' in sheet and "a&amp;b" in z.read("xl/workbook.xml").decode() and z.testzip() is None


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "n int, s string")
    K.write_metrics({"nodes": df}, str(tmp_path))
    K.write_outline(df, str(tmp_path / "o"))
    assert {r.s for r in spark.read.option("header", True).csv(str(tmp_path / "nodes")).collect()} == {"a,b", None}
    assert spark.read.json(str(tmp_path / "o")).count() == 2
    r = spark.createDataFrame([("é x",)], "t string").select(K.encoded(F.col("t")).alias("e")).select("e", K.decoded(F.col("e")).alias("d"), K.decoded(F.lit("not base64!")).alias("raw")).first()
    assert (r.d, r.raw) == ("é x", "not base64!")
