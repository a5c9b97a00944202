"""Golden cases of replies."""

import json

from pyspark.sql import functions as F

from tessera.operators import replies as R


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_json_text(spark):
    cases = {
        '```json\n{"a": 1}\n```': '{"a": 1}', " plain ": "plain", '{"a": [1, 2': '{"a": [1, 2]}', '{"a": "x': '{"a": "x"}', "{'a': 'b'}": '{"a": "b"}', '[1, 2,]': "[1, 2]", '{"a":': '{"a": null}', "[oops": "[oops", '"{[" in {"k": "]"}': '"{[" in {"k": "]"}',
    }
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()] + [(None, None)], "a string, b string").select("a", "b", R.json_text(F.col("a")).alias("got")).collect()
    assert [(r.a, r.got) for r in rows] == [(r.a, r.b) for r in rows]


def test_literals_and_errors(spark):
    got = one(spark, R.literal_dict(F.lit("{'n': None, 'ok': True, 's': \"it's\"}"), "n int, ok boolean, s string"))
    assert (got.n, got.ok, got.s) == (None, True, "it's")
    assert one(spark, R.failed_reply(F.lit("404 Not Found"))) and not one(spark, R.failed_reply(F.lit("fine"))) and one(spark, R.failed_reply(F.lit(None).cast("string")))
    assert one(spark, R.same_sizes(F.array(F.array(F.lit(1), F.lit(2))), 2)) and not one(spark, R.same_sizes(F.array(F.array(F.lit(1))), 2))


def test_scored_items(spark):
    reply = json.dumps({"items": [{"content": 1, "doc_time": "2024", "scores": {"authority": 8}}, {"score": {"relevance": 0.9}}, "odd", {"content": 7, "score": "bad"}]})
    got = one(spark, R.scored_items(F.lit(reply), F.lit(3)))
    assert [(x.content, x.doc_time, x.scores, x.in_range) for x in got] == [(1, "2024", {"authority": "8"}, True), (1, "Unknown", {"relevance": "0.9"}, True), (2, "Unknown", {}, True), (7, "Unknown", {}, False)]
    assert one(spark, R.scored_items(F.lit("nonsense"), F.lit(3))) == []
    item = F.struct(F.lit("").alias("doc_time"), F.create_map(F.lit("authority"), F.lit("8"), F.lit("relevance"), F.lit("0")).alias("scores"))
    r = spark.range(1).select(*R.score_notes(item)).first()
    assert r.source_authority.endswith("：8") and r.task_relevance.endswith("未提供相关性得分") and r.doc_time == "未提供时间信息"


def test_outline_from_arguments(spark):
    sections = [{"id": "abc", "title": "A", "description": "a"}, {"id": "xyz", "title": "B", "description": "b", "parent_ids": ["abc", "zz", "xyz"], "relationships": ["builds"]}]
    for given in (sections, json.dumps(sections)):
        got = one(spark, R.outline_of(F.lit(json.dumps({"title": "T", "sections": given}))))
        assert (got.title, got.thought) == ("T", "")
        assert [(s.id, s.title, s.is_core_section, s.parent_ids, s.relationships) for s in got.sections] == [("1", "A", False, [], []), ("2", "B", False, ["1"], ["builds"])]
    assert one(spark, R.outline_of(F.lit("no json"))).sections == []
    error = lambda a: one(spark, R.outline_error(F.lit(a)))
    assert error(json.dumps({"title": "T", "sections": sections})) is None and error("x") == "not an object" and error('{"title": " "}') == "no title" and error('{"title": "T"}') == "no sections"
    assert error('{"title": "T", "sections": [{"title": ""}]}') == "section without title" and error('{"title": "T", "sections": [{"title": "A"}]}') == "section without description"
    plan = lambda a: one(spark, R.plan_error(F.lit(a)))
    assert plan('{"is_research_completed": true}') is None and plan('{"is_research_completed": false, "steps": []}') == "no steps" and plan('{"title": "x"}') == "no state"
    assert plan('{"is_research_completed": false, "steps": [{"title": "a", "description": "b"}]}') is None
