"""Requests and replies of search engines over HTTP, without the transport: an engine posts a request and parses the reply's text.

Replies are parsed as columns, so recorded ones can be read as a table, and as plain functions for search.register_engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.sources.search import LIMITS

#: The kinds of search of a results-page engine and the modes of a knowledge base.
KINDS = ("news", "search", "places", "images")
MODES = ("doc", "keyword", "mix")
#: Where a reply holds its list of hits.
HITS = {"hosted": "results", "pages": "web_pages", "knowledge": "output_list"}
HIT = "struct<title:string,url:string,content:string,score:double,raw_content:string>"


def page_request(base: str, query: str, kind: str = "search", **params) -> dict:
    """url and parameters for a results-page engine; parameters without a value are left out."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    return {"url": f"{base}/{kind}", "params": {"q": query} | {k: v for k, v in params.items() if v is not None}}


def knowledge_request(query: str, repos: list[str], top_k: int = 10, recall_threshold: float = 0.5, mode: str = "doc") -> dict:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    return {"query": query, "repo_ids": list(repos), "top_k": top_k, "recall_threshold": recall_threshold, "search_mode": mode}


def hits(reply: Column, engine: str, number: int | None = None) -> Column:
    """array<HIT> of a reply's text, the first `number`; titles, urls and contents are cut to LIMITS. A reply without a
    list of hits (an error, null, another shape) has none."""
    listed = F.ltrim(F.get_json_object(reply, f"$.{HITS[engine]}"))
    found = F.when(listed.startswith("["), F.from_json(listed, f"array<{HIT}>"))
    found = F.filter(F.coalesce(found, F.array().cast(f"array<{HIT}>")), lambda h: h.isNotNull())
    if number is not None:
        found = F.slice(found, 1, number)

    def cut(h: Column) -> Column:
        for name, most in LIMITS.items():
            h = h.withField(name, F.substring(F.coalesce(h[name], F.lit("")), 1, most))
        return h

    return F.transform(found, cut)


def hit_sizes(found: Column) -> Column:
    """struct<res_count, res_len_list>: how many hits and the length of each one's content."""
    return F.struct(F.size(found).cast("long").alias("res_count"), F.transform(found, lambda h: F.coalesce(F.length(h["content"]), F.lit(0))).alias("res_len_list"))
