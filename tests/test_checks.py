"""Checks of outlines, reports and urls, parsing of calls and search replies."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import urls
from tessera.operators import checks
from tessera.sources import engines, logs


def test_section_outlines(spark):
    rows = [
        ("5 a\n5.1 b\n5.2 c", 5, True), ("1 a\n1.1 b\n1.2 c", 1, True), ("1.a\n\n 1.1b", 1, True), ("1.1 a\n1.2 b", 1, False), ("1 a\n1 b", 1, False), ("1 a\n1.2 b", 1, False),
        ("1 a\n1.1 b\n1.1.1 c", 1, False), ("1 a\n123", 1, False), ("1 a\n1.1 b\n123", 1, False), ("", 1, False), (None, 1, False), ("1 a\n1.1 b", None, False), ("2 a\n2.1 b\nfree text", 2, True),
    ]
    got = spark.createDataFrame(rows, "text string, n int, want boolean").select("text", "want", checks.section_outline_valid(F.col("text"), F.col("n")).alias("got")).collect()
    assert [(r.text, r.got) for r in got] == [(r.text, r.want) for r in got]


def test_citation_check(spark):
    rows = [("# a\nb\n## c\nd", 2, True, "# a\nb\n## c"), ("no heading", 1, True, "no heading"), ("# a", 0, False, None), ("", 1, False, None), (None, 1, False, None), ("x # a\ny", 1, True, "x # a\ny")]
    got = spark.createDataFrame(rows, "r string, n int, need boolean, article string").select("need", "article", checks.citation_check(F.col("r"), F.col("n")).alias("c")).collect()
    assert [tuple(r.c) for r in got] == [(r.need, r.article) for r in got]


@pytest.mark.parametrize(("a", "b", "threshold", "want"), [
    ("https://example.com/path/to/resource", "https://example.com/path/to/resource/", 0.9, True), ("https://example.com/path/to/resource", "https://different.com/path/to/resource", 0.9, False),
    ("https://example.com/path/to/resource", "https://example.com/different/path", 0.9, False), ("https://example.com/path/to/resource", "https://example.com/path/to/other", 0.5, True),
    ("https://example.com/path/to/resource", "https://example.com/path/to/other", 0.9, False), ("https://example.com/api?query=test", "https://example.com/api?query=other", 0.9, True), (None, "https://example.com/", 0.9, False),
])
def test_similar_pages(spark, a, b, threshold, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(urls.similar_pages(F.col("a"), F.col("b"), threshold).alias("s")).first().s is want


def test_calls_in_logs(spark):
    head = "2025-01-02 03:04:05,678 - [TIME_STATS] thread_id: "
    lines = [head + "ab-1 ------ [LLM CALL STATISTICS]: {'method_name': 'plan', 'duration': 1.23456, 'input_tokens': 10, 'output_tokens': None, 'total_tokens': 10}", head + "ab-1 ------ [SEARCH TOOL STATISTICS]: {'function_name': 'f', 'duration': 2.0, 'query': 'q', 'res_count': 1, 'res_len_list': [4]}", head + "ab-1 ------ [LLM CALL STATISTICS]: {broken", "other"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert [(r.thread_id, r.method_name, r.duration, r.output_tokens) for r in logs.model_calls(df).collect()] == [("ab-1", "plan", 1.235, None)]
    assert [(r["query"], r.res_len_list) for r in logs.search_calls(df).collect()] == [("q", [4])]
    assert logs.of_threads(logs.search_calls(df), ["cd"]).count() == 0 and logs.of_threads(logs.search_calls(df), []).count() == 1


def test_replies_and_requests(spark):
    hit = {"title": "t", "url": "u" * 9000, "content": "c", "score": 0.5}
    rows = [("hosted", json.dumps({"results": [hit, {"url": "v"}]})), ("knowledge", json.dumps({"output_list": {"a": 1}})), ("pages", "no json"), ("pages", None)]
    for engine, reply in rows:
        found = spark.createDataFrame([(reply,)], "r string").select(engines.hits(F.col("r"), engine).alias("h")).first().h
        assert [(len(h.url), h.title, h.score) for h in found] == ([(8192, "t", 0.5), (1, "", None)] if engine == "hosted" else [])
    assert engines.page_request("http://x", "q", "news", gl=None, num=3) == {"url": "http://x/news", "params": {"q": "q", "num": 3}}
    with pytest.raises(ValueError, match="kind"):
        engines.page_request("http://x", "q", "videos")
