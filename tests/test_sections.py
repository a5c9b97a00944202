"""Golden cases of sections, insertions and inference graphs."""

from pyspark.sql import functions as F

from tessera.operators import nodes as N
from tessera.operators import sections as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_forbidden_rows(spark):
    text = "a\n```\n- x\n```\n\tb\n  > q\n1) n\n* m\n| t\nend"
    rows = S.with_forbidden(S.lines_of(spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string"))).orderBy("row").collect()
    assert [r.row for r in rows if not r.forbidden] == [1, 10]


def test_plans_and_insertions(spark):
    reports = spark.createDataFrame([(i, "a\n- b\nc") for i in range(7)], "doc_id int, text string")
    charts = spark.createDataFrame([(i, 0) for i in range(7)], "doc_id int, index int")
    s = "doc_id int, insertions array<struct<after_row:int,index:int>>"
    plans = spark.createDataFrame([(0, [(1, 0)]), (1, None), (2, [(4, 0)]), (3, [(2, 0)]), (4, [(1, 7)]), (5, [(1, 0), (3, 0)]), (6, [])], s)
    got = {r.doc_id: r.error for r in S.plan_errors(plans, reports, charts).collect()}
    assert got == {0: None, 1: "no insertions", 2: "row out of range", 3: "forbidden row", 4: "unknown chart", 5: "repeated chart", 6: None}
    ins = spark.createDataFrame([(0, 1, 1, "B"), (0, 1, 0, "A"), (0, 3, 0, "C"), (9, 1, 0, "no")], "doc_id int, after_row int, pos int, block string")
    texts = {r.doc_id: r.text for r in S.with_charts(reports, ins).collect()}
    assert texts[0] == "a\nA\nB\n- b\nc\nC" and texts[1] == "a\n- b\nc" and 9 not in texts
    block = one(spark, S.chart_block(F.lit("pie"), F.lit(" "), F.lit(3)))
    assert "```mermaid\npie\n```" in block and "**Image Title[citation:3]**" in block and one(spark, S.is_chart_chunk(F.lit(block)))
    assert not one(spark, S.is_chart_chunk(F.lit(None).cast("string")))


def test_headings_and_references(spark):
    md = "# T\nintro\n## A\ntext\n#### deep\ngone\n### B\nkept"
    assert one(spark, S.promoted(F.lit(md))) == "# A\n## B"
    assert one(spark, S.promoted(F.lit("# T\n# U\n## A\n### B"))) == "# T\n# U\n## A"
    both = spark.createDataFrame([(1, md), (2, "x\n# T\na\n# U\n### B\nb\n## C\nc"), (3, ""), (4, None)], "doc_id int, text string")
    got = {r.doc_id: r.text for r in S.shallow(both).collect()}
    assert got == {1: "# A\ntext\n## B\nkept", 2: "x\n# T\na\n# U\n## C\nc", 3: "", 4: ""}
    r = one(spark, S.without_references(F.lit("# A\n参考文献 here\n\n## 参考文献\n[1] x\n## 3. reference articles\n[2] y\n")))
    assert (r.body, r.removed) == ("# A\n参考文献 here\n\n## 参考文献\n[1] x", "## 3. reference articles\n[2] y")
    r = one(spark, S.without_references(F.lit("no list ")))
    assert (r.body, r.removed) == ("no list ", "")


def test_conclusions(spark):
    text = "# T\n# Abs\nx\n# A\nsay it now. say it\n# Z\nend"
    reports = spark.createDataFrame([(1, text)], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "say it"), (1, "end"), (1, "")], "doc_id int, sentence string")
    got = {r.sentence: r for r in S.located(asked, reports).collect()}
    at = text.index("say it")
    assert (got["say it"].section, got["say it"].start, got["say it"].end) == (3, at, at + 6) and got["end"].section is None and got[""].section is None
    spans = spark.createDataFrame([(1, at, at + 6, 1), (1, at + 12, at + 18, 2)], "doc_id int, start int, end int, id int")
    assert S.marked(reports, spans).first().text == text.replace("say it now. say it", "[say it](#inference:1) now. [say it](#inference:2)")


def test_citation_chunk_and_abstract(spark):
    f = lambda s: one(spark, S.citation_chunk(F.lit(s)))
    assert f("First one here。Second is long") == "Second is long" and f("abcdef。no") == "abcdef。 no" and f("abc[citation:1]。no") == "no" and f("") == ""
    show = lambda s, lang: one(spark, S.abstract_shown(F.lit(s).cast("string"), "# H\n", lang, "none"))
    assert show("摘要：内容[citation:2]", "zh") == "# H\n内容" and show("Abstract: a", "en") == "# H\na" and show("", "en") == "none" and show("# H\nx", "en") == "# H\nx"


def test_number_nodes(spark):
    records = [("P", "http://a"), ("Q", "http://a"), ("ProgrammerNode", ""), ("R", "http://b")]
    h = lambda r=None, t=None: (r, t)
    edges = [([h(0), h(None, "rain fell on the hills")], "r", "the river is high"), ([h(1), h(None, "rain fell on the hills.")], "s", "the flood comes today"), ([h(2), h(3)], "t", "the river is high")]
    s = "inference_id int, conclusion string, edges array<struct<heads:array<struct<ref:int,text:string>>,relation:string,tail:string>>, records array<struct<title:string,url:string>>"
    df = spark.createDataFrame([(1, "the flood comes today", edges, records), (2, None, None, None)], s)
    got = {r.inference_id: r for r in N.numbered(df).collect()}
    assert [(n.id, n.label, n.kind) for n in got[1].nodes] == [
        (0, "《P》", "citation"), (1, "rain fell on the hills", "statement"), (2, "the river is high", "statement"),
        (3, "the flood comes today", "conclusion"), (4, "2", "program"), (5, "《R》", "citation"),
    ]
    assert [(e.heads, e.tail) for e in got[1].edges] == [([0, 1], 2), ([0, 1], 3), ([4, 5], 2)]
    assert got[2].nodes == [] and got[2].edges == []


def test_tag_fragments(spark):
    assert N.tag_fragments("one two three", ["two", "one", "two"]) == "<mark>one</mark> <mark>two</mark> three"
    assert N.tag_fragments("the quick brown fox", ["quick brewn fox"]) == "the <mark>quick brown fox</mark>"
    assert N.tag_fragments("abc", ["xyz", "abcd", ""]) == "abc" and N.tag_fragments(None, ["a"]) is None and N.tag_fragments("a", None) == "a"
    df = spark.createDataFrame([("one two", ["two"]), (None, None)], "t string, p array<string>")
    assert [r[0] for r in df.select(N.tagged(F.col("t"), F.col("p"))).collect()] == ["one <mark>two</mark>", None]


def test_fragment_search_equals_all_windows():
    import random

    from tessera.functions import fuzzy

    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 40)))
        piece = "".join(rng.choice("abcd ") for _ in range(rng.randint(1, 8)))
        for threshold in (30.0, 60.0, 90.0):
            want = (text.find(piece), text.find(piece) + len(piece)) if piece in text else None
            if want is None:
                scored = [(fuzzy.ratio_of(piece, text[i : i + len(piece)]), -i) for i in range(len(text) - len(piece) + 1)]
                score, i = max(scored, default=(0.0, 0))
                want = (-i, -i + len(piece)) if score >= threshold and score > 0 else None
            assert N.find_fragment(text, piece, threshold) == want, (text, piece, threshold)


def test_removed_subgraphs(spark):
    hyper = spark.createDataFrame([(1, [1, 2], "r", 3), (2, [3], "r", 4), (3, [5], "r", 6)], "edge_id int, heads array<int>, relation string, tail int")
    nodes = spark.createDataFrame([(i,) for i in range(1, 7)], "id int")
    kept, left = N.without_nodes(hyper, nodes, nodes.where("id = 3"))
    assert {r.edge_id for r in kept.collect()} == {2, 3} and {r.id for r in left.collect()} == {4, 5, 6}
    assert {(r.src, r.dst, r.label) for r in N.rendered(hyper.where("edge_id < 3")).collect()} == {("1", "e1", None), ("2", "e1", None), ("e1", "3", "r"), ("3", "4", "r")}


def test_ratio_over_loses_nothing():
    import random

    from tessera.functions import fuzzy

    rng = random.Random(1)
    for _ in range(400):
        a = "".join(rng.choice("abc ") for _ in range(rng.randrange(30)))
        b = "".join(c if rng.random() < 0.9 else "x" for c in a) + "z" * rng.randrange(4)
        whole, got = fuzzy.ratio_of(a, b), fuzzy.ratio_over(a, b, 90.0)
        assert got == whole if whole > 90 else got in (0.0, whole)


def test_conclusions_meet_few_sections(spark):
    n = 400
    text = "# T\nt\n# A\na\n" + "".join(f"# S{i}\nIt says name number {i:05d}.\n" for i in range(n)) + "# End\n"
    reports = spark.createDataFrame([(1, text), (2, None), (None, text)], "doc_id int, text string")
    asked = spark.createDataFrame([(1, f"number {i:05d}") for i in range(n)] + [(1, "n"), (1, "no such"), (1, "say"), (2, "n"), (3, "n")], "doc_id int, sentence string")
    got = {(r.doc_id, r.sentence): (r.section, r.start, r.end) for r in S.located(asked, reports).collect()}
    want = {(1, f"number {i:05d}"): (i + 3, text.index(f"number {i:05d}"), text.index(f"number {i:05d}") + 12) for i in range(n)}
    at = text.index("name number")
    assert got == want | {(1, "n"): (3, at, at + 1), (1, "no such"): (None,) * 3, (1, "say"): (3, at - 5, at - 2), (2, "n"): (None,) * 3, (3, "n"): (None,) * 3}


def test_marks_across_blocks(spark):
    text = "".join(chr(97 + i % 26) for i in range(97)) + "🙂é"
    spans = [(0, 3), (3, 8), (8, 8), (15, 17), (24, 32), (40, 61), (97, 120)]
    want = text
    for k, (a, b) in reversed(list(enumerate(spans))):
        want = f"{want[:a]}[{want[a:b]}](#inference:{k}){want[b:]}"
    rows = spark.createDataFrame([(1, a, b, k) for k, (a, b) in enumerate(spans)] + [(1, 3, 8, 1)], "doc_id int, start int, end int, id int")
    reports = spark.createDataFrame([(1, text), (2, text), (3, None), (None, "x")], "doc_id int, text string")
    for block in (1, 8, 33, 4096):
        got = {r.doc_id: r.text for r in S.marked(reports, rows, block).collect()}
        assert got == {1: want, 2: text, 3: None, None: "x"}
