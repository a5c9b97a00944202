"""Tracing of sentences to sources: citation markers with places, mappings, traced rows, insertion of references, evidence.

Reports are rows of doc_id and text. Places are code points from 0. Order is data: `pos` columns say it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators.records import ordered_list
from tessera.operators.sections import citation_chunk


def citation_mapping(classified: DataFrame) -> DataFrame:
    """doc_id, index, title, url, content of each citation number: the first title and url, all contents in order; 0 and null are none.

    classified: doc_id, pos, index, title, url, content.
    """
    rows = classified.where("index <> 0")
    joined = F.array_join(ordered_list("pos", F.coalesce("content", F.lit(""))), "")
    first = F.min_by(F.struct("title", "url"), "pos")
    return rows.groupBy("doc_id", "index").agg(first.alias("_f"), joined.alias("content")).select("doc_id", "index", "_f.title", "_f.url", "content")


def markers(reports: DataFrame) -> DataFrame:
    """doc_id, n (from 0), index, start and end of each citation marker: running lengths of the pieces between and the markers."""
    whole = F.regexp_extract_all("text", F.lit(X.CITATION), F.lit(0))
    pieces = F.arrays_zip(F.split("text", X.CITATION, -1).alias("p"), whole.alias("m"), X.citation_numbers(F.col("text")).alias("i"))
    rows = reports.select("doc_id", F.posexplode(pieces).alias("n", "x")).select("doc_id", "n", F.length("x.p").alias("a"), F.coalesce(F.length("x.m"), F.lit(0)).alias("b"), F.col("x.i").alias("index"))
    end = F.sum(F.col("a") + F.col("b")).over(Window.partitionBy("doc_id").orderBy("n"))
    return rows.withColumn("end", end).where("index is not null").select("doc_id", "n", "index", (F.col("end") - F.col("b")).alias("start"), "end")


def moved(spans: DataFrame) -> DataFrame:
    """spans (doc_id, start, end, replacement) with `new_start`, their place once all are replaced."""
    grown = F.length("replacement") - (F.col("end") - F.col("start"))
    before = F.sum(grown).over(Window.partitionBy("doc_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("new_start", F.col("start") + F.coalesce(before, F.lit(0)))


def origin_citations(reports: DataFrame, classified: DataFrame) -> DataFrame:
    """doc_id, n, index, title, url, content and chunk of the markers whose number the mapping knows."""
    found = markers(reports).join(citation_mapping(classified), ["doc_id", "index"]).join(reports.select("doc_id", "text"), "doc_id")
    chunk = citation_chunk(F.substr("text", F.lit(1), F.col("start").cast("int")))
    return found.select("doc_id", "n", "index", "title", "url", "content", chunk.alias("chunk"))


def valid_traces(traces: DataFrame, reports: DataFrame) -> DataFrame:
    """traces (doc_id, sentence, source, indices) of known text: sentence, source and indices there, and the sentence, without end marks, in the report."""
    clean = X.without_trailing_marks(F.col("sentence"))
    full = traces.where("length(sentence) > 0 and length(source) > 0 and size(indices) > 0")
    met = full.join(reports.select("doc_id", "text"), "doc_id").where((F.length(clean) > 0) & (F.instr(F.col("text"), clean) > 0))
    return met.select(*traces.columns)


def traced_rows(traces: DataFrame, sources: DataFrame) -> DataFrame:
    """One row for each traced source that is in range and has a title and content.

    traces: doc_id, sentence, source, indices; sources: doc_id, source, idx (from 0), title, url, content.
    """
    flat = traces.select("doc_id", "sentence", "source", F.posexplode("indices").alias("pos", "idx"))
    return flat.join(sources.where("length(title) > 0 and length(content) > 0"), ["doc_id", "source", "idx"]).select("doc_id", "sentence", "source", "pos", "idx", "title", "url", "content")


def merged_citations(generated: DataFrame, origin: DataFrame, reports: DataFrame) -> DataFrame:
    """Both kinds of citation (doc_id, pos, chunk, url) whose chunk is in the report, by its first place, generated ones first."""
    both = generated.select("doc_id", F.lit(0).alias("kind"), "pos", "chunk", "url").unionByName(origin.select("doc_id", F.lit(1).alias("kind"), "pos", "chunk", "url"))
    met = both.join(reports.select("doc_id", "text"), "doc_id").withColumn("position", F.instr("text", F.col("chunk")) - 1).where("position >= 0")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("position", "kind", "pos"))
    return met.select("doc_id", rank.alias("rank"), "position", "kind", "pos", "chunk", "url")


def with_references(reports: DataFrame, references: DataFrame) -> DataFrame:
    """doc_id and text with the links of each sentence put after its first place, the last place first.

    references: doc_id, pos, sentence, link. Links of one sentence stand in the order of pos; sentences not found are left out.
    """
    known = references.withColumn("sentence", X.without_trailing_marks(F.col("sentence"))).where("length(sentence) > 0")
    groups = known.groupBy("doc_id", "sentence").agg(F.array_join(ordered_list("pos", "link"), "").alias("links"))
    met = groups.join(reports, "doc_id").withColumn("at", F.instr("text", F.col("sentence"))).where("at > 0")
    # of sentences at one place the shortest is done first, as its end comes first
    order = F.struct((-F.col("at")).alias("at"), F.length("sentence").alias("l"), "sentence", "links")
    packed = met.groupBy("doc_id").agg(F.array_sort(F.collect_list(order)).alias("_g"))
    out = reports.join(packed, "doc_id", "left")
    put = F.aggregate("_g", F.col("text"), lambda t, g: X.insert_after(t, g["sentence"], g["links"]))
    return out.select("doc_id", F.when(F.col("_g").isNull(), F.col("text")).otherwise(put).alias("text"))


def evidence(index: Column, content: Column) -> Column:
    """A source as a model is shown it."""
    return F.format_string("[citation:%d begin]%s[citation:%d end]", index, content, index)


def research_record(messages: DataFrame) -> DataFrame:
    """doc_id and record: the one message, or what the user said; messages: doc_id, pos, role, content."""
    said = F.array_join(ordered_list("pos", F.when(F.col("role") == "user", F.concat(F.lit("User: "), F.coalesce("content", F.lit("None")), F.lit("\n"))).otherwise("")), "")
    return messages.groupBy("doc_id").agg(F.when(F.count("*") == 1, F.max("content")).otherwise(said).alias("record"))


def assembled(parts: DataFrame) -> DataFrame:
    """doc_id and report from parts (doc_id, kind, section, text): title, abstract, sections, conclusion, references; blank ones go."""
    kinds = F.array(*map(F.lit, ("title", "abstract", "section", "conclusion", "references")))
    rank = F.array_position(kinds, F.col("kind"))
    rows = parts.where((rank > 0) & (F.length(F.trim("text")) > 0))
    return rows.groupBy("doc_id").agg(F.array_join(ordered_list(F.struct(rank.alias("k"), F.coalesce("section", F.lit(0)).alias("s")), "text"), "\n\n").alias("report"))


def top_documents(scored: DataFrame, group: list[str], most: int = 10) -> DataFrame:
    """The documents that rounds of batches, each keeping its best `most`, come to: the best `most` of all by score.

    With one fixed score a document among the best of a group is among the best of any batch of it, so one ranking is
    enough and no round is run; ties go to the lower pos.
    """
    w = Window.partitionBy(*group).orderBy(F.desc("score"), "pos")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def completed_steps(state: DataFrame, results: DataFrame) -> DataFrame:
    """state (section, done array<int>, background map<int,string>) after results (section, step, background).

    Steps are appended in their order once, later backgrounds replace earlier ones; a section without results is over.
    """
    new = results.groupBy("section").agg(F.array_sort(F.collect_set("step")).alias("_s"), F.map_from_entries(F.array_sort(F.collect_set(F.struct("step", "background")))).alias("_m"))
    out = state.join(new, "section", "left")
    kept = F.map_filter("background", lambda k, v: ~F.map_contains_key(F.col("_m"), k))
    done = F.concat("done", F.array_except("_s", "done"))
    return out.select("section", F.coalesce(done, F.col("done")).alias("done"), F.when(F.col("_m").isNull(), F.col("background")).otherwise(F.map_concat(kept, "_m")).alias("background"), F.col("_s").isNull().alias("over"))
