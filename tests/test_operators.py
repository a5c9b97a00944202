"""Golden cases and properties of the operators that the queries don't cover alone."""

import base64
import io
import zipfile
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tessera.functions import fuzzy
from tessera.functions import text as X
from tessera.functions import urls as U
from tessera.operators import charts, citations, graph, headers, model, outline, records, retrieve
from tessera.sources import logs, search, sse
from tessera.streaming import events as E

HOSTS = [("example.com-www", "example.com"), ("api.example.com-v1", "api.example.com-v1"), ("site.org-news", "site.org"), ("example.com", "example.com"), ("a.b-c", "a.b")]
PATHS = [("//path//to//resource", "/path/to/resource"), ("", "/"), ("path", "/path"), ("/a/b", "/a/b")]
URLS = [("https://example.com-api/v1/users", "https://example.com/api/v1/users"), ("example.com/path/to/resource", "https:///example.com/path/to/resource"), ("http://example.com//a//b?x=1#f", "http://example.com/a/b?x=1#f")]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("f,cases", [(U.normal_host, HOSTS), (U.normal_path, PATHS), (U.normal_url, URLS)])
def test_url_repair(spark, f, cases):
    rows = spark.createDataFrame(cases, "a string, b string").select(f(F.col("a")).alias("got"), "b").collect()
    assert all(r.got == r.b for r in rows), rows


def test_same_page(spark):
    same = lambda a, b: one(spark, U.same_page(F.lit(a), F.lit(b)))
    assert same("https://a.com/x?q=1", "https://a.com/x?q=2") and not same("https://a.com/x", "https://a.com/y")


@pytest.mark.parametrize(
    "f,given,want",
    [
        (X.strip_leading_number, "12-5 算法分析", "算法分析"), (X.strip_leading_number, "第三章 x", "x"), (X.without_trailing_marks, "完成。[citation:3] ，", "完成"), (X.without_links, "a [t](u) b", "a  b"), (X.without_links, "[t](u)", "[t](u)"),
        (X.escape_html, "<a & \"b\" 'c'>", "&lt;a &amp; &quot;b&quot; &#x27;c&#x27;&gt;"), (X.clean_headers, "#### 数据来源", "- **数据来源**"), (X.clean_headers, "## 一、概述\ntext", "## 概述\ntext"),
        (X.sentences, "甲。乙！丙", ["甲。", "乙！", "丙"]), (X.sentences, "a.b。", ["a.b。"]), (X.citation_numbers, "x [citation:3] y [ citation: 12 ]", [3, 12]), (X.heading_level, "### x", 3),
    ],
)
def test_text(spark, f, given, want):
    assert one(spark, f(F.lit(given))) == want


def test_citation_replacement_is_simultaneous(spark):
    mapping = F.create_map(F.lit("1"), F.lit(2), F.lit("2"), F.lit(5))
    assert one(spark, X.replace_citations(F.lit("a [citation:1] b [citation:2] c [citation:9]."), mapping)) == "a [citation:2] b [citation:5] c ."


def test_chunks_cover_the_text(spark):
    for text in ("", "x" * 2999, "x" * 3000, "é🙂" * 4000):
        got = one(spark, X.chunks(F.lit(text)))
        assert "".join(c.piece for c in got) == text and all(len(c.piece) <= 3000 for c in got)


def test_fuzzy(spark):
    assert fuzzy.ratio_of("", "") == 100 and fuzzy.ratio_of("abcd", "bcda") == 75 and fuzzy.partial_of("abc", "xxabcxx") == 100 and fuzzy.token_set_of("a b", "b a") == 100
    left = spark.createDataFrame([(1, 1, "alpha beta"), (2, 1, "gamma delta"), (3, 1, "zzz")], "id long, grp long, text string")
    right = spark.createDataFrame([(10, 1, "alpha beta"), (11, 1, "gamma deltas"), (12, 1, "gamma dell"), (13, 2, "zzz")], "id long, grp long, text string")
    got = {r.id: (r.match_id, round(r.score, 6)) for r in retrieve.best_fuzzy(left, right, 60.0).collect()}
    assert got == {1: (10, 100.0), 2: (11, round(100 * SequenceMatcher(None, "gamma delta", "gamma deltas").ratio(), 6))}


def test_records(spark):
    rows = spark.createDataFrame([(0, "t", "u", "a"), (1, "t", "u", "b"), (2, "t2", None, "c"), (3, "t3", "u3", "d")], "pos int, title string, url string, content string")
    assert {r.content for r in records.first_wins(rows, ["title", "url"], ["pos"]).collect()} == {"a", "d"}
    last = {r.title: (r.content, r.first_pos) for r in records.last_wins(rows, ["title", "url"], "pos", "content").collect()}
    assert last["t"] == ("b", 0)
    twice = records.first_wins(records.first_wins(rows, ["title"], ["pos"]), ["title"], ["pos"])
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, records.first_wins(rows, ["title"], ["pos"]).collect()))
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, n string, v int")
    changes = spark.createDataFrame([(2, None, 9), (3, "c", 3)], "k int, n string, v int")
    assert sorted(map(tuple, records.upsert(base, changes, ["k"], ["n", "v"]).collect())) == [(1, "a", 1), (2, None, 9), (3, "c", 3)]
    assert sorted(map(tuple, records.patch(base, changes, ["k"], ["n", "v"]).collect())) == [(1, "a", 1), (2, "b", 9)]
    assert sorted(map(tuple, records.insert_absent(base, changes, ["k"]).collect())) == [(1, "a", 1), (2, "b", 2), (3, "c", 3)]
    assert records.schema_changes(base.schema, changes.selectExpr("k", "cast(v as long) v", "n", "1 z").schema) == [("modify", "v", "bigint"), ("add", "z", "int")]


def test_vectors_in_blocks(spark, sf_small):
    e = spark.read.parquet(f"{sf_small}/embeddings.parquet")
    q, base = e.where("vec_id % 50 = 0").selectExpr("vec_id query_id", "embedding"), e.selectExpr("vec_id", "embedding", "label kb")
    a, b = retrieve.vector_topk(q, base, 3), retrieve.vector_topk(q, base, 3, block=2)
    assert sorted((r.query_id, r.kb, r.rank, r.vec_id) for r in a.collect()) == sorted((r.query_id, r.kb, r.rank, r.vec_id) for r in b.collect())
    assert retrieve.vector_topk(q.limit(0), base, 3).count() == 0


def test_contained_in_blocks(spark, sf_small):
    d, b = spark.read.parquet(f"{sf_small}/documents.parquet"), spark.read.parquet(f"{sf_small}/benchmark.parquet")
    assert sorted(map(tuple, retrieve.contained(d, b).collect())) == sorted(map(tuple, retrieve.contained(d, b, block_chars=2000).collect()))


def test_graph(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdefgh"], "id string")
    edges = spark.createDataFrame([tuple(x) for x in ("ab", "bc", "ac", "cd", "ef", "fe", "gg")], "src string, dst string")
    assert {r.id: r.level for r in graph.levels(nodes, edges).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3, "h": 0}
    assert {r.id: r.component for r in graph.components(nodes, edges).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e", "f": "e", "g": "g", "h": "h"}
    pick = lambda s: spark.createDataFrame([(x,) for x in s], "id string")
    assert {r.id for r in graph.reaches(edges, pick("d"), pick("b")).collect()} == set("dcab")
    assert {r.id for r in graph.reaches(edges, pick("c"), pick("b")).collect()} == set("cab")
    assert {r.id for r in graph.grounded(edges, nodes, pick("b")).collect()} == {"b", "c", "d", "e", "f", "g"}
    hyper = spark.createDataFrame([(1, [0, 1], "r", 1), (2, [1], "r", 1)], "edge_id int, heads array<int>, relation string, tail int")
    assert [tuple(r) for r in graph.edges_of(hyper).collect()] == [(1, 0, "r", 1)]


def test_outline(spark):
    s = "array<struct<id:string,parent_ids:array<string>,relationships:array<string>>>"
    df = spark.createDataFrame([(1, [("1", ["1", "3"], ["x"]), ("2", ["1", "1", "9"], ["a", "b"]), ("3", ["2", "1"], [])])], f"outline_id int, sections {s}")
    got = df.select(outline.repaired(F.col("sections")).alias("s")).first().s
    assert [(x.id, x.parent_ids, x.relationships) for x in got] == [("1", [], []), ("2", ["1"], ["a"]), ("3", ["2", "1"], ["related", "related"])]
    assert {(r.id, r.parent, r.error) for r in outline.dependency_errors(df).collect()} == {("1", "1", "self"), ("1", "3", "later"), ("2", "9", "unknown")}
    assert one(spark, outline.remapped(F.array(F.lit("abc"), F.lit("zz"), F.lit("abc")), F.create_map(F.lit("abc"), F.lit("1")))) == ["1"]
    steps = spark.createDataFrame([(1, []), (2, [3, 1])], "step_id int, parent_ids array<int>")
    results = spark.createDataFrame([(1, "a"), (3, "c")], "step_id int, result string")
    assert {r.step_id: r.background for r in outline.collected_background(steps, results).collect()} == {1: [], 2: ["c", "a"]}


def test_citation_collapse(spark):
    para = "x[source_tracer_result][a](u) [source_tracer_result][b](v) [source_tracer_result][a](u) words between [source_tracer_result][a](u)"
    spans = [(m.start(), m.end(), m[3]) for m in __import__("re").finditer(citations.INLINE, para)]
    rows = [(1, s, e, u, x) for (s, e, u), x in zip(spans, (0.9, 0.5, 0.9, 0.1), strict=True)]
    df = spark.createDataFrame(rows, "para int, start int, end int, url string, score double")
    got = citations.collapsed(df, spark.createDataFrame([(1, para)], "para int, text string"))
    assert [r.kept for r in got.orderBy("start").collect()] == [True, True, False, True]
    links = one(spark, citations.inline_links(F.lit("a [source_tracer_result]![t](<u>) [source_tracer_result][x](y)")))
    assert [(x.image, x.title, x.url) for x in links] == [(True, "t", "u"), (False, "x", "y")]


def test_headings(spark):
    md = "# A\n## B\n## C\n### D\n```\n# no\n```\n# E\n## F\ntext"
    df = spark.createDataFrame([(1, md)], "doc_id int, text string")
    assert [r.number for r in headers.renumbered(df).orderBy("line").collect()] == ["1", "1.1", "1.2", "1.2.1", "2", "2.1"]
    got = headers.splits(df).orderBy("section").collect()
    assert "".join(r.text for r in got) == md and all(md[r.start :].startswith(r.text) for r in got)


def test_charts(spark):
    kind = F.lit("bar")
    row = lambda *x: F.array(*map(F.lit, x))
    good = F.array(row("a", "1", "u"), row("b", "2", "u"), row("c", "3", "u"))
    assert one(spark, charts.valid_extraction(kind, F.lit("%"), good)) and not one(spark, charts.valid_extraction(kind, F.lit(" "), good))
    assert not one(spark, charts.valid_extraction(F.lit("dots"), F.lit("%"), good))
    assert not one(spark, charts.valid_values(kind, row(1.0, 1.0, 2.0))) and one(spark, charts.valid_values(F.lit("pie"), row(1.0, 1.0)))
    assert one(spark, charts.pie_rest(row(40.0, 35.0))) == 25.0 and one(spark, charts.pie_rest(row(80.0, 35.0))) is None


class Flaky:
    def __init__(self, good):
        self.good, self.calls = good, 0

    def __call__(self, prompts):
        self.calls += 1
        if self.calls == 1:
            raise RuntimeError("busy")
        return [self.good] * len(prompts)


def test_model_map(spark):
    df = spark.createDataFrame([(1, "p"), (2, None)], "id int, prompt string").coalesce(1)
    got = model.model_map(df, "prompt", "supervise", Flaky('```json\n{"is_sufficient": false, "knowledge_gap": "x", "next_queries": ["q"]}\n```')).orderBy("id").collect()
    assert got[0].valid and got[0].parsed.next_queries == ["q"] and got[1].valid and got[1].parsed.is_sufficient

    def broken(prompts):
        raise RuntimeError("down")

    assert [r.reply for r in model.model_map(df, "prompt", "evaluate", broken).collect()] == ['{"items": []}'] * 2
    assert not any(r.valid for r in model.model_map(df, "prompt", "verify").collect())
    assert [r.valid for r in model.model_map(df, "prompt", "abstract").orderBy("id").collect()] == [True, False]
    assert set(model.CALLS) >= {"entry", "outline", "template"} and len(model.CALLS) == 31


def test_search_source(spark):
    def engine(query, n):
        if query == "bad":
            raise ValueError("no")
        return [{"title": f"{query}{i}", "url": "u" * 9000, "content": "c", "score": i} for i in range(n)]

    search.register_engine("own", engine)
    got = search.search(spark, "own", ["a", "bad"], 3).collect()
    assert len([r for r in got if r.query == "a"]) == 3 and all(len(r.url) == 8192 for r in got if r.url)
    assert [r.error for r in got if r.query == "bad"] == ["ValueError('no')"]


def test_sse(spark):
    lines = ["event: m", "data: a", "data: b", "", "id: 2", "data: c", "", "data: d"]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "stream string, pos int, line string")
    assert [(r.event, r.id, r.data) for r in sse.messages(df).orderBy("message").collect()] == [("m", None, "a\nb"), (None, "2", "c"), (None, None, "d")]


def test_files_and_logs(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    table = "<w:tbl><w:tr><w:tc>" + p("a") + "</w:tc><w:tc>" + p("b") + "</w:tc></w:tr></w:tbl>"
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p('Title', 'Heading1')}{p('item', 'ListBullet')}{table}</w:body></w:document>")
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.docx").write_bytes(raw.getvalue())
    (tmp_path / "d/b.md").write_text("# é")
    (tmp_path / "d/c.docx").write_bytes(b"broken")
    got = {r.path[-6:]: r.text for r in sse.read_files(spark, str(tmp_path / "d")).collect()}
    assert got["a.docx"] == "# Title\n- item\n| a | b |\n| --- | --- |" and got["c.docx"] is None and got["d/b.md"] == "# é"
    line = "2025-01-02 03:04:05,678 - [TIME_STATS] thread_id: ab-1 ---- [SummaryNode[2].run] executed time: 1.500 s"
    (tmp_path / "metrics.log").write_text(f"{line}\nnoise\n")
    (tmp_path / "metrics.log.1").write_text(line.replace("[2]", "").replace("1.500", "0.000") + "\n" + line.replace("[2]", "") + "\n")
    lines = logs.read_logs(spark, str(tmp_path / "metrics.log*"))
    assert [r.file_rank for r in lines.orderBy("file_rank").collect()] == [-1, -1, 0, 0]
    runs = logs.node_runs(lines).collect()
    assert [(r.section_idx, r.duration, r.parent) for r in runs] == [(2, 1.5, "SummaryNode")]  # lines without a section don't count
    collector = lines.unionByName(spark.createDataFrame([(line.replace("Summary", "InfoCollector"), 0)], "value string, file_rank int"))
    assert {(r.node, r.parent) for r in logs.node_runs(collector).collect()} == {("SummaryNode", "InfoCollectorNode"), ("InfoCollectorNode", "EditorTeamNode")}
    assert logs.summary(logs.node_runs(lines)).first().calls == 1
    assert base64.b64decode(one(spark, F.base64(F.lit("é").cast("binary")))).decode() == "é"


def test_streams_equal_batches(spark, sf_small, tmp_path):
    events = spark.read.parquet(f"{sf_small}/events.parquet")
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = E.read_stream(spark, str(tmp_path / "in"))
    live = E.run_once(E.tumbling(stream, "1 hour"), "tumbling_live", str(tmp_path / "c1"), "complete")
    batch = E.tumbling(events, "1 hour")
    shape = lambda d: sorted((str(r.start), r.event_type, r.n) for r in d.collect())
    assert shape(live) == shape(batch)
    kinds = [r[0] for r in events.select("event_type").distinct().orderBy("event_type").collect()][:2]
    muted = E.run_once(E.suppressed_stream(stream, *kinds), "muted_live", str(tmp_path / "c2"))
    want = {r.event_id for r in E.suppressed(events, *kinds).collect()}
    assert {r.event_id for r in muted.collect()} == want
    assert E.framed(spark.createDataFrame([(1, "x")], "conv_id int, text string")).count() == 3
    end = spark.createDataFrame([("end", '{"report": "r"}'), ("end", "ALL END"), ("x", "{}")], "agent string, content string")
    assert [r.result.report for r in E.results(E.tagged(end, 1)).collect()] == ["r"]
