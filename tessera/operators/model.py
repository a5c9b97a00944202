"""Model calls as an operator: a client is injected, a deterministic stand-in is the default.

model_map sends a prompt column through client(list[str]) -> list[str] a batch at a time, retries a batch
that raises, and falls back to a literal; replies are parsed by schema, and `valid` says whether they were.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Call -> (reply schema as DDL or None for plain text, retries, fallback reply).
CALLS = {
    "entry": ("needs_research boolean, lang string", 1, None),
    "questions": (None, 3, ""),
    "outline": ("title string, thought string, sections array<struct<id:string,title:string,description:string,parent_ids:array<string>,relationships:array<string>>>", 3, None),
    "plan": ("title string, is_research_completed boolean, steps array<struct<id:string,title:string,description:string,parent_ids:array<string>,relationships:array<string>>>", 3, None),
    "queries": ("queries array<string>, description string", 3, None),
    "tool_call": ("name string, args map<string,string>", 3, None),
    "evaluate": ("items array<struct<content:int,doc_time:string,scores:map<string,double>>>", 5, '{"items": []}'),
    "supervise": ("is_sufficient boolean, knowledge_gap string, next_queries array<string>", 3, '{"is_sufficient": true}'),
    "summary": ("need_programmer boolean, programmer_task string, info_summary string, evaluation string", 3, "{}"),
    "classify": ("core_content_url_list array<string>", 3, None),
    "section_outline": (None, 3, None),
    "chart_extract": ("image_title string, image_type string, unit string, records array<array<string>>", 3, "{}"),
    "chart_trace_check": ("valid boolean, error_msg string", 3, None),
    "chart_compliance": ("valid boolean, error_msg string", 3, None),
    "chart_units": ("unit string, records array<array<string>>", 3, None),
    "section_report": (None, 3, None),
    "insert_charts": ("insertions array<struct<after_row:int,index:int>>", 3, '{"insertions": []}'),
    "section_summary": (None, 3, None),
    "transition": (None, 3, None),
    "abstract": (None, 3, None),
    "recommendations": (None, 3, None),
    "recognise": ("sentences array<string>", 1, '{"sentences": []}'),
    "match_sources": ("source_traced_results array<struct<sentence:string,matched_source_indices:array<int>>>", 1, '{"source_traced_results": []}'),
    "verify": ("source string, marked_citation_content array<string>, score double", 3, None),
    "extract_conclusions": ("conclusions array<string>", 3, '{"conclusions": []}'),
    "validate_inference": ("indices array<int>", 3, None),
    "infer": ("inferences array<string>", 3, None),
    "filter_inference": (None, 3, ""),
    "structure_inference": ("edges array<struct<heads:array<string>,relation:string,tail:string>>", 3, None),
    "supplement": ("edges array<struct<heads:array<string>,relation:string,tail:string>>", 3, None),
    "template": (None, 3, None),
}


def echo(prompts: list[str]) -> list[str]:
    """The stand-in: replies with the prompt."""
    return list(prompts)


def model_map(df: DataFrame, prompt: str, call: str | tuple, client=echo, batch: int = 64) -> DataFrame:
    """df with reply (the text), parsed (by the call's schema; null for plain text) and valid. Null prompts get the fallback.

    call is a name in CALLS, or a schema, number of retries and fallback of its own.
    """
    schema, retries, fallback = CALLS[call] if isinstance(call, str) else call

    def ask(prompts: list[str]) -> list[str | None]:
        for _ in range(retries):
            try:
                return client(prompts)
            except Exception:  # a model call may fail in any way; the fallback says so downstream
                continue
        return [fallback] * len(prompts)

    # only prompts and replies pass through Python; a reply isn't asked for again where it is named twice
    def run(column: pa.Array) -> pa.Array:
        out = []
        for i in range(0, len(column), batch):
            prompts = column.slice(i, batch).to_pylist()
            known = [p for p in prompts if p is not None]
            replies = iter(ask(known) if known else [])
            out.append(pa.array([fallback if p is None else next(replies) for p in prompts], pa.string()))
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}  # arrow_udf reads them, and not as strings
    out = df.withColumn("reply", F.arrow_udf(run, "string").asNondeterministic()(F.col(prompt)))
    if schema is None:
        return out.withColumn("parsed", F.lit(None).cast("string")).withColumn("valid", F.coalesce(F.length("reply") > 0, F.lit(False)))
    bare = F.regexp_replace(F.regexp_replace("reply", "^\\s*```(?:json)?\\s*", ""), "\\s*```\\s*$", "")
    # what has no brace is no object; to find that out by parsing costs an exception a reply
    parsed = F.when(F.contains(bare, F.lit("{")), F.from_json(bare, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    out = out.withColumn("parsed", parsed).withColumn("valid", F.coalesce(F.col("reply").isNotNull() & F.col("parsed").isNotNull() & F.col("parsed._bad").isNull(), F.lit(False)))
    return out.withColumn("parsed", F.when(F.col("valid"), F.col("parsed").dropFields("_bad")))
