"""Pipelines around model calls: matching sentences to sources, verification, research rounds, charts. Clients are injected.

Each is a DataFrame plan; only the rounds of `research` are driven by a loop, and every round is written out.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import charts as C
from tessera.operators.graph import settled
from tessera.operators.model import echo, model_map
from tessera.operators.nodes import find_fragment, tagged
from tessera.operators.records import ordered_list

#: Sources a call is shown, the least score of a citation and the likeness at which a mark counts as found.
BATCH, LEAST_SCORE, MARK_LIKENESS = 40, 0.85, 80.0


def match_sources(recognised: DataFrame, sources: DataFrame, client=echo, batch: int = BATCH) -> DataFrame:
    """doc_id, sentence, source, indices: sorted distinct places of the sources a model matched to recognised sentences.

    recognised: doc_id, sentence; sources: doc_id, source, idx (from 0), title, content. The prompt is JSON of `sentences` and
    of `sources` with their places, a batch at a time. Places out of the batch's range and other sentences are dropped.
    """
    part = F.floor(F.col("idx") / batch)
    shown = ordered_list("idx", F.struct("idx", "title", "content"))
    batches = sources.groupBy("doc_id", "source", part.alias("part")).agg(shown.alias("sources"), F.min("idx").alias("low"), F.max("idx").alias("high"))
    asked = recognised.where("length(sentence) > 0").groupBy("doc_id").agg(F.array_sort(F.collect_set("sentence")).alias("sentences"))
    prompts = batches.join(asked, "doc_id").select("doc_id", "source", "low", "high", F.to_json(F.struct("sentences", "sources")).alias("prompt"))
    found = model_map(prompts, "prompt", "match_sources", client).select("doc_id", "source", "low", "high", F.explode("parsed.source_traced_results").alias("x"))
    flat = found.select("doc_id", "source", "low", "high", "x.sentence", F.explode("x.matched_source_indices").alias("idx")).where("idx between low and high")
    merged = flat.groupBy("doc_id", "sentence", "source").agg(F.array_sort(F.collect_set("idx")).alias("indices"))
    return merged.join(recognised.select("doc_id", "sentence").distinct(), ["doc_id", "sentence"], "left_semi")


def found_marks(content: Column, marks: Column) -> Column:
    """The marks that are in content as they stand, or are like enough to a part of it."""

    def run(text: pd.Series, pieces: pd.Series) -> pd.Series:
        keep = lambda t, ps: None if ps is None else [p for p in ps if t and p and find_fragment(t, p, MARK_LIKENESS)]
        return pd.Series([keep(t, ps) for t, ps in zip(text, pieces, strict=True)], dtype=object)

    exact = F.forall(marks, lambda m: F.instr(content, m) > 0)
    return F.when(exact, marks).otherwise(F.pandas_udf(run, "array<string>")(content, marks))


def verified(citations: DataFrame, client=echo) -> DataFrame:
    """citations (doc_id, pos, domain, content, fact, is_chart) with source, score, valid, invalid_reason and marked content.

    A chart is kept at the least score or above, from its domain where its source is unknown or the call failed. Others are
    invalid when the call fails, the score is too low or no mark is given or found.
    """
    prompt = F.to_json(F.struct(F.col("fact").alias("fact"), F.col("content").alias("content")))
    out = model_map(citations.withColumn("_p", prompt), "_p", "verify", client)
    p = lambda k: F.col(f"parsed.{k}")
    missing = F.when(~F.col("valid"), "reply can't be parsed")
    for name in ("source", "marked_citation_content", "score"):
        missing = missing.when(p(name).isNull(), f"missing required field: {name}")
    out = out.withColumn("_marks", found_marks(F.col("content"), p("marked_citation_content")))
    lost = missing.when((F.size(p("marked_citation_content")) > 0) & (F.size("_marks") == 0), "marked content not found")
    out = out.withColumn("_failed", lost).withColumn("_chart", F.coalesce("is_chart", F.lit(False)))
    score, source = F.coalesce(p("score"), F.lit(0.0)), F.coalesce(p("source"), F.lit("unknown source"))
    reason = (
        F.when(F.col("_chart"), F.lit(None)).when(F.col("_failed").isNotNull(), F.col("_failed")).when(score < LEAST_SCORE, "score lower than threshold")
        .when(F.size("_marks") == 0, "marked citation content empty")
    )
    from_domain = source.contains("unknown") | (F.col("_chart") & F.col("_failed").isNotNull())
    shown = F.when(reason.isNull() & (F.size("_marks") > 0), tagged(F.col("content"), F.col("_marks"))).otherwise(F.col("content"))
    keep = [c for c in citations.columns if c != "content"]
    return out.select(
        *keep, shown.alias("content"), F.when(from_domain, F.col("domain")).otherwise(source).alias("source"),
        F.when(F.col("_chart"), F.greatest(score, F.lit(LEAST_SCORE))).otherwise(score).alias("score"), reason.isNull().alias("valid"), reason.alias("invalid_reason"),
    )


def research(topics: DataFrame, retrieve: Callable[[DataFrame], DataFrame], client=echo, rounds: int = 2, per_round: int = 3) -> DataFrame:
    """Hits (topic_id, query, pos, title, url, content, round), each (title, url) of a topic once, after rounds of retrieval.

    topics: topic_id, query. retrieve takes them and gives topic_id, query, pos, title, url, content. After each round a
    judge sees a topic's new titles; one that isn't satisfied names its next queries, at most `per_round`.
    """
    front, seen = topics.select("topic_id", "query"), None
    for n in range(rounds):
        hits = retrieve(front).where("title is not null and url is not null").select("topic_id", "query", "pos", "title", "url", "content", F.lit(n).alias("round"))
        first = F.row_number().over(Window.partitionBy("topic_id", "title", "url").orderBy("query", "pos"))
        new = hits.withColumn("_n", first).where("_n = 1").drop("_n")
        if seen is not None:
            new = new.join(seen.select("topic_id", "title", "url"), ["topic_id", "title", "url"], "left_anti").select(*hits.columns)
        new = settled(new)
        seen = new if seen is None else seen.unionByName(new)
        if n + 1 == rounds:
            break
        titles = new.groupBy("topic_id").agg(F.array_sort(F.collect_set("title")).alias("titles"))
        asked = front.groupBy("topic_id").agg(F.array_sort(F.collect_set("query")).alias("queries"))
        prompts = asked.join(titles, "topic_id", "left").select("topic_id", F.to_json(F.struct("queries", "titles")).alias("prompt"))
        judged = model_map(prompts, "prompt", "supervise", client)
        more = F.slice(F.array_distinct("parsed.next_queries"), 1, per_round)
        front = settled(judged.where("valid and not parsed.is_sufficient").select("topic_id", F.explode(more).alias("query")).where("length(query) > 0"))
        if front.isEmpty():
            break
    return seen


def chart_of(documents: DataFrame, client=echo) -> DataFrame:
    """doc_id, title, kind, chart and error of each document a chart is asked of: extracted, validated, brought to one unit, drawn.

    documents: doc_id, content. The second call sees the extraction and gives the unit and [label, value] rows.
    """
    first = model_map(documents.select("doc_id", F.col("content").alias("_p")), "_p", "chart_extract", client).select("doc_id", F.col("parsed").alias("e"))
    sound = C.valid_extraction(F.col("e.image_type"), F.coalesce("e.unit", F.lit("")), F.col("e.records"))
    timeline = F.col("e.image_type") == "timeline"
    asked = first.withColumn("sound", sound).withColumn("_p", F.when(F.col("sound") & ~timeline, F.to_json("e")))
    second = model_map(asked, "_p", "chart_units", client).select("doc_id", "e", "sound", F.when(F.col("valid"), F.col("parsed")).alias("u"))
    part = lambda rows, i: F.transform(rows, lambda r: F.get(r, F.lit(i)))
    labels, values = part(F.col("u.records"), 0), F.transform(F.col("u.records"), lambda r: F.get(r, F.lit(1)).try_cast("double"))
    kind, unit = F.col("e.image_type"), F.col("u.unit")

    def of_values(x: Column) -> Column:
        usable = C.valid_values(kind, x["v"])
        return F.when(usable & (kind == "pie"), C.mermaid_pie(unit, x["a"], x["v"])).when(usable, C.mermaid_xy(kind, unit, x["a"], x["v"]))

    drawn = F.when(timeline, C.mermaid_timeline(part(F.col("e.records"), 0), part(F.col("e.records"), 1))).otherwise(C.let(F.struct(labels.alias("a"), values.alias("v")), of_values))
    out = second.select("doc_id", F.col("e.image_title").alias("title"), kind.alias("kind"), F.coalesce("sound", F.lit(False)).alias("sound"), F.when(F.col("sound"), drawn).alias("chart"))
    return out.select("doc_id", "title", "kind", "chart", F.when(~F.col("sound"), "extraction not valid").when(F.col("chart").isNull(), "values not valid").alias("error"))
