"""Pipelines around model calls, with scripted clients."""

import json

from pyspark.sql import functions as F

from tessera.operators import flows, outline, references, tools


def test_match_sources(spark):
    def client(prompts):
        out = []
        for p in map(json.loads, prompts):
            hits = [{"sentence": s, "matched_source_indices": [x["idx"] for x in p["sources"] if s in x["content"]] + [99]} for s in [*p["sentences"], "invented"]]
            out.append(json.dumps({"source_traced_results": hits}))
        return out

    asked = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "")], "doc_id int, sentence string")
    sources = spark.createDataFrame([(1, "web", i, "t", "a b" if i % 2 else "a") for i in range(5)] + [(2, "local", 0, "t", "b")], "doc_id int, source string, idx int, title string, content string")
    got = {(r.doc_id, r.sentence, r.source): r.indices for r in flows.match_sources(asked, sources, client, batch=2).collect()}
    assert got == {(1, "a", "web"): [0, 1, 2, 3, 4], (1, "b", "web"): [1, 3]}


def test_verified(spark):
    replies = {
        "good": {"source": "Paper", "marked_citation_content": ["rain fell"], "score": 0.9}, "low": {"source": "unknown", "marked_citation_content": ["rain"], "score": 0.5}, "none": {"source": "P", "marked_citation_content": [], "score": 0.9},
        "lost": {"source": "P", "marked_citation_content": ["zzzzzz"], "score": 0.9}, "part": {"source": "P", "score": 0.9},
    }

    def client(prompts):
        return [json.dumps(replies[f]) if (f := json.loads(p)["fact"]) in replies else "oops" for p in prompts]

    rows = [(1, i, "d.org", "the rain fell today", f, c) for i, (f, c) in enumerate([("good", False), ("low", False), ("none", None), ("lost", False), ("part", False), ("bad", False), ("bad", True), ("low", True)])]
    got = flows.verified(spark.createDataFrame(rows, "doc_id int, pos int, domain string, content string, fact string, is_chart boolean"), client).orderBy("pos").collect()
    assert [r.invalid_reason for r in got] == [None, "score lower than threshold", "marked citation content empty", "marked content not found", "missing required field: marked_citation_content", "reply can't be parsed", None, None]
    assert [r.valid for r in got] == [True, False, False, False, False, False, True, True]
    assert got[0].content == "the <mark>rain fell</mark> today" and got[0].source == "Paper" and got[1].source == "d.org" and got[6].source == "d.org" and got[6].score == 0.85 and got[7].score == 0.85


def test_research(spark):
    def client(prompts):
        return [json.dumps({"is_sufficient": len(json.loads(p)["titles"]) > 1, "knowledge_gap": "", "next_queries": ["more", "more", "again"]}) for p in prompts]

    def retrieve(q):
        n = F.when(F.col("query") == "wide", 2).otherwise(1)
        hit = q.select("topic_id", "query", F.explode(F.sequence(F.lit(1), n)).alias("pos"))
        return hit.select("*", F.concat("query", F.col("pos").cast("string")).alias("title"), F.lit("u").alias("url"), F.lit("c").alias("content"))

    topics = spark.createDataFrame([(1, "thin"), (2, "wide")], "topic_id int, query string")
    got = sorted((r.topic_id, r.title, r.round) for r in flows.research(topics, retrieve, client, rounds=3).collect())
    assert got == [(1, "again1", 1), (1, "more1", 1), (1, "thin1", 0), (2, "wide1", 0), (2, "wide2", 0)]


def test_chart_of(spark):
    def client(prompts):
        out = []
        for p in prompts:
            if p.startswith("{"):
                rows = json.loads(p)["records"]
                out.append(json.dumps({"unit": "t", "records": [[a, b] for a, b, _ in rows]}))
            elif p == "odd":
                out.append("{}")
            else:
                out.append(json.dumps({"image_title": p, "image_type": p, "unit": "t", "records": [["a", "1", "t"], ["b", "3", "t"], ["c", "2", "t"]]}))
        return out

    got = {r.doc_id: r for r in flows.chart_of(spark.createDataFrame([(1, "bar"), (2, "pie"), (3, "timeline"), (4, "odd")], "doc_id int, content string"), client).collect()}
    assert "bar [1, 3, 2]" in got[1].chart and got[2].chart.startswith('pie\n    "b (3t)" : 3') and got[3].chart.startswith("timeline\n        a : 1") and got[4].error == "extraction not valid"


def test_references(spark):
    raw = spark.createDataFrame([(1, "[1] A\n\n[1] B\n[2] A\nnoise")], "doc_id int, text string")
    refs = references.renumbered_lists(raw)
    assert {r.key: r.ref for r in refs.collect()} == {"1-1": 1, "3-1": 2, "3-2": 1}
    assert references.merged_list(refs).first().references == "[1] A\n\n[2] B"
    m = "[source_tracer_result][x](u)"
    paras = spark.createDataFrame([(1, 0, f"a {m} b {m}"), (1, 1, ""), (1, 2, f"!{m}c{m}")], "doc_id int, para int, text string")
    cites = spark.createDataFrame([(1, 0, True, False, "T", "u1"), (1, 1, False, False, "F", "u2"), (1, 2, True, False, "V", "u1")], "doc_id int, idx int, valid boolean, is_image boolean, title string, url string")
    assert references.rebuilt(paras, cites).first().text == "a [source_tracer_result][T](u1) b \n\n![source_tracer_result][V](u1)c"
    assert references.with_reference_section(paras, cites).first().text.endswith("c\n\n[1]. [T](u1)")


def test_flattened(spark):
    doc = "array<struct<title:string,url:string>>"
    s = f"outline_id int, language string, title string, thought string, sections array<struct<id:string,title:string,description:string,is_core_section:boolean,parent_ids:array<string>,relationships:array<string>,plans:array<struct<id:string,title:string,steps:array<struct<id:string,title:string,description:string,retrieval_queries:array<struct<query:string,doc_infos:{doc}>>>>>>>>"
    steps = [("s1", "S", "d", [("q1", [("t", "u"), ("t2", "u2")]), ("q2", None)]), ("s2", "S", "d", None)]
    data = [(1, "en", "T", "", [("1", "A", "a", True, [], [], [("p", "P", steps)]), ("2", "B", "b", None, ["1"], ["after"], None)]), (2, "en", "U", "", None)]
    got = {k: v.collect() for k, v in outline.flattened(spark.createDataFrame(data, s)).items()}
    assert {k: len(v) for k, v in got.items()} == {"outlines": 2, "sections": 2, "plans": 1, "steps": 2, "queries": 2, "documents": 2, "contents": 3}
    assert sorted(r.section_count for r in got["outlines"]) == [0, 2] and {(r.parents, r.plan_count) for r in got["sections"]} == {("", 1), ("1(after)", 0)}


def test_tools_and_prompts(spark):
    box = tools.Toolbox(tools.Tool("add", "adds", lambda a, b=0: a + b, {"a": "integer", "b": "integer"}, ("a",)), tools.Tool("fail", "fails", lambda: 1 / 0))
    assert box.call("add", {"a": 1, "b": 2})["result"] == 3 and box.call("add", {"b": 1})["error"] == "missing argument: a" and box.call("add", {"a": "x"})["error"] == "argument a is no integer"
    assert "ZeroDivisionError" in box.call("fail", {})["error"] and box.call("none", {})["error"] == "unknown tool: none" and len(box.log) == 5
    assert box.tools["add"].card()["parameters"]["required"] == ["a"]
    df = spark.createDataFrame([("{{ b }}", None)], "a string, b string")
    assert df.select(tools.prompt("x {{ a }} y {{b}}.", a=F.col("a"), b=F.col("b")).alias("p")).first().p == "x {{ b }} y ."
