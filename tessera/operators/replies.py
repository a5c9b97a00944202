"""Replies of models and tools: JSON cleaning, scored items, tool calls, outlines and plans from arguments."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.loose_json import mend
from tessera.operators.outline import repaired

#: Labels and defaults of the scores attached to documents, and what marks a failed reply.
SCORES = {
    "authority": ("source_authority", "该篇文章的信息来源权威性和可信度得分：", "未提供权威性得分"),
    "relevance": ("task_relevance", "该篇文章的内容与当前任务的相关性得分：", "未提供相关性得分"),
    "answerability": ("information_richness", "该篇文章的信息丰富程度与可答性得分：", "未提供可答性得分"),
    "data_density": ("data_density", "该篇文章的数据丰富和密集程度得分：", "未提供数据密度得分"),
}
NO_TIME = "未提供时间信息"
ERROR_SIGNALS = "Error|ERROR|Exception|404 Not Found|Client error|Request failed"

SECTION = "struct<id:string,title:string,description:string,is_core_section:boolean,parent_ids:array<string>,relationships:array<string>>"
STEP = "struct<id:string,title:string,description:string,type:string,parent_ids:array<string>,relationships:array<string>>"
ITEM = "struct<content:string,doc_time:string,scores:map<string,string>>"


def without_fences(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(text), "^```(?:json|ts)\\n*", ""), "\\n*```$", "")


def _mended(text: Column) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else mend(t) for t in texts], dtype=object)

    return F.pandas_udf(run, "string")(text)


def json_text(text: Column) -> Column:
    """JSON without fences, re-serialised (functions.loose_json); text without brackets and what can't be mended come back stripped."""
    bare = F.trim(text)
    return F.when(~bare.rlike("[{\\[]"), bare).otherwise(F.coalesce(_mended(without_fences(text)), bare))


def literal_dict(text: Column, schema: str) -> Column:
    """A Python literal dict, as logs print it, by schema; null where it is none."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "\\bNone\\b", "null"), "\\bTrue\\b", "true"), "\\bFalse\\b", "false")
    return F.from_json(plain, schema, {"allowSingleQuotes": "true"})


def failed_reply(text: Column) -> Column:
    return F.coalesce(text.rlike(ERROR_SIGNALS), F.lit(True))


def scored_items(reply: Column, n: Column) -> Column:
    """array<struct<content:int,doc_time,scores>> of an evaluator's reply: an object's `items` or an array.

    `score` is taken before `scores`; what is no object has no scores. A missing content is the item's place, a missing
    time Unknown; items whose content is no number in [0, n) keep it as it is, null if it is no number. A reply that
    can't be parsed has none.
    """
    raw = F.coalesce(F.from_json(F.get_json_object(reply, "$.items"), "array<string>"), F.from_json(reply, "array<string>"), F.array().cast("array<string>"))

    def one(x: Column, i: Column) -> Column:
        place = F.get_json_object(x, "$.content")
        score = F.coalesce(F.get_json_object(x, "$.score"), F.get_json_object(x, "$.scores"))
        scores = F.coalesce(F.from_json(score, "map<string,string>"), F.create_map().cast("map<string,string>"))
        return F.struct(
            F.when(place.isNull(), i).otherwise(place.try_cast("int")).alias("content"),
            F.coalesce(F.get_json_object(x, "$.doc_time"), F.lit("Unknown")).alias("doc_time"),
            scores.alias("scores"),
            F.coalesce(F.when(place.isNull(), i < n).otherwise(place.try_cast("int").between(0, n - 1)), F.lit(False)).alias("in_range"),
        )

    return F.transform(raw, one)


def score_notes(item: Column) -> list[Column]:
    """The labelled score columns and doc_time of a document; missing, empty and zero scores say so."""
    out = []
    for key, (name, label, missing) in SCORES.items():
        value = F.try_element_at(item["scores"], F.lit(key))
        empty = value.isNull() | value.isin("", "0", "0.0", "false", "null")
        out.append(F.concat(F.lit(label), F.when(empty, missing).otherwise(value)).alias(name))
    time = item["doc_time"]
    return [*out, F.when(F.coalesce(F.length(time), F.lit(0)) == 0, NO_TIME).otherwise(time).alias("doc_time")]


def listed(args: Column, name: str, kind: str) -> Column:
    """A list among a call's JSON arguments, given as such or as a JSON string; null where it is neither."""
    raw = F.get_json_object(args, f"$.{name}")
    return F.from_json(raw, f"array<{kind}>")


def renumbered(sections: Column) -> Column:
    """Ids become places from 1 as strings and parents follow; of equal ids the last counts, unknown parents go."""
    ids = F.transform(sections, lambda s: s["id"])

    def one(s: Column, i: Column, known: Column) -> Column:
        place = lambda p: F.array_max(F.transform(known, lambda k, j: F.when(k == p, j + 1)))
        parents = F.filter(F.transform(F.coalesce(s["parent_ids"], F.array().cast("array<string>")), lambda p: place(p).cast("string")), lambda p: p.isNotNull())
        return s.withField("id", (i + 1).cast("string")).withField("parent_ids", parents).withField("relationships", F.coalesce(s["relationships"], F.array().cast("array<string>")))

    return F.get(F.transform(F.array(ids), lambda known: F.transform(sections, lambda s, i: one(s, i, known))), F.lit(0))


def outline_of(args: Column) -> Column:
    """struct<title,thought,sections> from a call's arguments: defaults filled, ids renumbered, bad dependencies dropped."""
    given = F.coalesce(listed(args, "sections", SECTION), F.array().cast(f"array<{SECTION}>"))
    full = renumbered(given)
    fixed = repaired(full)
    text = lambda s, k: F.coalesce(s[k], F.lit(""))
    merged = F.zip_with(
        full, fixed,
        lambda s, r: F.struct(r["id"].alias("id"), text(s, "title").alias("title"), text(s, "description").alias("description"), F.coalesce(s["is_core_section"], F.lit(False)).alias("is_core_section"), r["parent_ids"].alias("parent_ids"), r["relationships"].alias("relationships")),
    )
    field = lambda k: F.coalesce(F.get_json_object(args, f"$.{k}"), F.lit(""))
    return F.struct(field("title").alias("title"), field("thought").alias("thought"), merged.alias("sections"))


def outline_error(args: Column) -> Column:
    """What is wrong with an outline's arguments; null if nothing is."""
    sections = listed(args, "sections", SECTION)
    blank = lambda c: F.coalesce(F.length(F.trim(c)), F.lit(0)) == 0
    return (
        F.when(F.from_json(args, "map<string,string>").isNull(), "not an object").when(blank(F.get_json_object(args, "$.title")), "no title").when(sections.isNull(), "no sections")
        .when(F.exists(sections, lambda s: s.isNull() | blank(s["title"])), "section without title").when(F.exists(sections, lambda s: blank(s["description"])), "section without description")
    )


def plan_error(args: Column) -> Column:
    """What is wrong with a plan's arguments: an unfinished one needs steps of title and description."""
    steps = listed(args, "steps", STEP)
    done = F.lower(F.get_json_object(args, "$.is_research_completed"))
    blank = lambda c: F.coalesce(F.length(F.trim(c)), F.lit(0)) == 0
    return (
        F.when(F.from_json(args, "map<string,string>").isNull(), "not an object").when(done.isNull() | ~done.isin("true", "false"), "no state").when((done == "false") & (F.coalesce(F.size(steps), F.lit(0)) <= 0), "no steps")
        .when(F.exists(steps, lambda s: s.isNull() | blank(s["title"]) | blank(s["description"])), "step without title or description")
    )


def same_sizes(lists: Column, n: int) -> Column:
    """Whether every inner list has n entries; null lists don't."""
    return F.coalesce(F.forall(lists, lambda x: F.coalesce(F.size(x), F.lit(-1)) == n), F.lit(False))
