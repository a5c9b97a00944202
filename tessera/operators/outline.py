"""Outlines: sections with parents, as array<struct<id,parent_ids,relationships>>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def synced(relations: Column, parents: Column, default: str = "related") -> Column:
    """relations cut or filled to as many as parents; the last one is repeated."""
    n = F.size(parents)
    fill = F.when(F.size(relations) > 0, F.try_element_at(relations, F.lit(-1))).otherwise(default)
    return F.slice(F.concat(relations, F.array_repeat(fill, n)), F.lit(1), n)


def repaired(sections: Column) -> Column:
    """Parents that are unknown, the section itself, later ones or repeated are dropped; relations follow."""

    def fix(ids: Column) -> Column:
        def one(s: Column) -> Column:
            parents = F.array_distinct(F.filter(s["parent_ids"], lambda p: F.array_contains(ids, p) & (p.cast("int") < s["id"].cast("int"))))
            return F.struct(s["id"].alias("id"), parents.alias("parent_ids"), synced(s["relationships"], parents).alias("relationships"))

        return F.transform(sections, one)

    return let(F.transform(sections, lambda s: s["id"]), fix)


def remapped(ids: Column, mapping: Column) -> Column:
    """ids through a map; those without an entry go, order stays, repeats go."""
    return F.array_distinct(F.filter(F.transform(ids, lambda i: F.try_element_at(mapping, i)), lambda i: i.isNotNull()))


def dependency_errors(outlines: DataFrame) -> DataFrame:
    """outline_id, id, parent and error (self, unknown or later) of each bad dependency."""
    flat = outlines.select("outline_id", F.transform("sections", lambda s: s["id"]).alias("ids"), F.explode("sections").alias("s")).select("outline_id", "ids", "s.id", F.explode("s.parent_ids").alias("parent"))
    error = F.when(F.col("parent") == F.col("id"), "self").when(~F.array_contains("ids", F.col("parent")), "unknown").when(F.col("parent").cast("int") > F.col("id").cast("int"), "later")
    return flat.select("outline_id", "id", "parent", error.alias("error")).where("error is not null")


def relations_shown(section: Column) -> Column:
    """parent(relation), comma-joined, as far as both lists go."""
    n = F.least(F.size(section["parent_ids"]), F.size(section["relationships"]))
    pairs = F.zip_with(F.slice(section["parent_ids"], F.lit(1), n), F.slice(section["relationships"], F.lit(1), n), lambda p, r: F.concat(p, F.lit("("), r, F.lit(")")))
    return F.array_join(pairs, ",")


def collected_background(steps: DataFrame, results: DataFrame) -> DataFrame:
    """step_id and the results of its parents, in their order. steps: step_id, parent_ids; results: step_id, result."""
    flat = steps.select("step_id", F.posexplode("parent_ids").alias("pos", "parent"))
    met = flat.join(results.select(F.col("step_id").alias("parent"), "result"), "parent")
    got = met.groupBy("step_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "result"))), lambda x: x["result"]).alias("background"))
    return steps.select("step_id").join(got, "step_id", "left").withColumn("background", F.coalesce("background", F.array().cast("array<string>")))


def flattened(outlines: DataFrame) -> dict[str, DataFrame]:
    """The levels of nested outlines as tables: outlines, sections, plans, steps, queries, documents and contents.

    outlines: outline_id, language, title, thought, sections; a section has plans, a plan steps, a step
    retrieval_queries, a query doc_infos. Null lists are empty; contents has a row for each section, plan and step.
    """

    def down(df: DataFrame, keys: list[str], items: str, name: str) -> DataFrame:
        rows = df.select(*keys, F.posexplode(items).alias(f"{name}_pos", "x"))
        return rows.select(*keys, f"{name}_pos", F.col("x.id").alias(f"{name}_id") if name != "query" else F.col("x.query").alias("query"), "x")

    sections = down(outlines, ["outline_id"], "sections", "section")
    plans = down(sections, ["outline_id", "section_pos", "section_id"], "x.plans", "plan")
    steps = down(plans, ["outline_id", "section_pos", "section_id", "plan_pos", "plan_id"], "x.steps", "step")
    at = ["outline_id", "section_pos", "section_id", "plan_pos", "plan_id", "step_pos", "step_id"]
    queries = down(steps, at, "x.retrieval_queries", "query")
    documents = queries.select(*at, "query_pos", "query", F.posexplode("x.doc_infos").alias("doc_pos", "d")).select(*at, "query_pos", "query", "doc_pos", "d.*")
    core = F.coalesce("x.is_core_section", F.lit(False))
    count = lambda c: F.coalesce(F.nullif(F.size(c), F.lit(-1)), F.lit(0))
    contents = sections.select(*at[:3], "x.plans").withColumn("p", F.explode_outer("plans")).withColumn("s", F.explode_outer("p.steps"))
    return {
        "outlines": outlines.select("outline_id", "language", "title", "thought", count("sections").alias("section_count")),
        "sections": sections.select(*at[:3], "x.title", "x.description", core.alias("is_core_section"), relations_shown(F.col("x")).alias("parents"), count("x.plans").alias("plan_count")),
        "plans": plans.select(*at[:5], "x.title", count("x.steps").alias("step_count")),
        "steps": steps.select(*at, "x.title", "x.description", count("x.retrieval_queries").alias("query_count")),
        "queries": queries.select(*at, "query_pos", "query", count("x.doc_infos").alias("doc_count")),
        "documents": documents,
        "contents": contents.select(*at[:3], F.col("p.id").alias("plan_id"), F.col("s.id").alias("step_id")),
    }
