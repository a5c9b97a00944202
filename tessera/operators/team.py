"""Work over dependency graphs in rounds: steps of plans, plans of sections, sections of outlines.

All graphs are in one DataFrame. A round takes every item whose parents are done, runs a stage on all of them at once and adds
what comes back to what the next round may use. Each round is written out, so that plans stay small and executors may be lost.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tessera.operators.graph import settled
from tessera.operators.model import echo, model_map
from tessera.operators.records import ordered_list

#: Fixed value: plans a section gets at most.
MOST_PLANS = 2

#: The levels of items that never get ready and of those whose graph is too large to be held by a task, and how many items that is.
NEVER, LARGE, MOST_ITEMS = -1, -2, 1 << 15

Stage = Callable[[DataFrame], DataFrame]


def with_background(items: DataFrame, done: DataFrame | None, by: list[str], firsts: bool = True) -> DataFrame:
    """Items (by, id, parent_ids) all of whose parents are done, with `background`: the results of the parents in their order; firsts: also those without."""
    empty = F.array().cast("array<string>")
    first = items.where(F.size(F.coalesce("parent_ids", empty)) == 0).withColumn("background", empty)
    if done is None:
        return first
    known = done.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("id").alias("_parent"), "result")
    several = F.size(F.array_distinct("parent_ids"))
    # an item of one parent has its list by that join alone
    one = items.where(several == 1).withColumn("_parent_id", F.col("parent_ids")[0])
    alone = one.join(known, (one["_parent_id"] == known["_parent"]) & _all([one[c].eqNullSafe(known[f"_{c}"]) for c in by]))
    alone = alone.where("id is not null").select(*items.columns, F.array(F.coalesce("result", F.lit(""))).alias("background"))
    wanted = items.where(several > 1)
    asked = wanted.select(*by, "id", F.posexplode(F.array_distinct("parent_ids")).alias("_pos", "_parent_id"))
    met = asked.join(known, (asked["_parent_id"] == known["_parent"]) & _all([asked[c].eqNullSafe(known[f"_{c}"]) for c in by]))
    lists = met.groupBy(*by, "id").agg(F.count("*").alias("_met"), ordered_list("_pos", F.coalesce("result", F.lit(""))).alias("background"))
    lists = lists.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("id").alias("_id"), "_met", "background")
    ready = wanted.join(lists, (wanted["id"] == lists["_id"]) & _all([wanted[c].eqNullSafe(lists[f"_{c}"]) for c in by]))
    ready = alone.unionByName(ready.where(F.col("_met") == several).select(*items.columns, "background"))
    return first.unionByName(ready) if firsts else ready


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def levels_of(graph: np.ndarray, ids: pa.Array, parents: pa.Array) -> np.ndarray:
    """The round in which each item can be ready at first: 0 without parents, NEVER where a parent is unknown or waits for the item itself. graph: a number for its graph."""
    flat, owner = parents.flatten(), pc.list_parent_indices(parents).to_numpy()
    names = pa.concat_arrays([ids, flat.cast(ids.type)]).dictionary_encode()
    code = names.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    own, asked, size = code[: len(ids)], code[len(ids) :], len(names.dictionary) + 1
    key = np.where(own < 0, -1, graph * size + own)
    order = np.argsort(key, kind="stable")
    wanted = graph[owner] * size + asked
    parent = order[np.minimum(np.searchsorted(key[order], wanted), max(0, len(key) - 1))]
    open_ = np.bincount(owner, minlength=len(ids))
    level = np.where(open_ == 0, 0, NEVER).astype(np.int32)
    open_ += own < 0  # an item without an id is met by no list of its parents
    known = (asked >= 0) & (key[parent] == wanted)
    owner, parent, n = owner[known], parent[known], 0
    while len(owner):
        met = level[parent] == n
        if not met.any():
            break
        done = owner[met]
        np.subtract.at(open_, done, 1)
        n += 1
        level[done[open_[done] == 0]] = n
        owner, parent = owner[~met], parent[~met]
    return level


def numbered_runs(columns: list[pa.Array]) -> np.ndarray:
    """A number for each run of rows with equal values."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        code = c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.cumsum(new)


def levelled(items: DataFrame, by: list[str], together: bool, most: int) -> DataFrame:
    """items with _level: as levels_of has it, LARGE for those of a graph of more than `most` items. together: the items of a graph lie in a row already."""

    def run(batches):
        rest, large = None, None
        for b in batches:
            rows = b if rest is None or not rest.num_rows else pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
            if not rows.num_rows:
                continue
            graph = numbered_runs([rows.column(c) for c in by])
            level = levels_of(graph, rows.column("id"), rows.column("parent_ids"))
            first, final = (tuple(rows.column(c)[i].as_py() for c in by) for i in (0, rows.num_rows - 1))
            if large == (first,):
                level[graph == 0] = LARGE
            last = int(np.searchsorted(graph, graph[-1]))
            if large == (final,) or rows.num_rows - last > most:
                # the rest of this graph is still to come and isn't held
                large, level[last:], last = (final,), LARGE, rows.num_rows
            rest = rows.slice(last)
            yield with_level(rows.slice(0, last), level[:last])
        if rest is not None and rest.num_rows:
            yield with_level(rest, levels_of(np.zeros(rest.num_rows, np.int64), rest.column("id"), rest.column("parent_ids")))

    def with_level(rows: pa.RecordBatch, level: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(level)], names=[*rows.schema.names, "_level"])

    dealt = items if together else items.repartition(*by).sortWithinPartitions(*by)
    return dealt.mapInArrow(run, StructType([*items.schema.fields, StructField("_level", IntegerType())]))


def ready_rounds(items: DataFrame, run: Stage, by: list[str], max_rounds: int = 1000, together: bool = False, most: int = MOST_ITEMS) -> DataFrame:
    """Items with round (from 0), and what run made of them; those that never got ready have a null round and nothing else.

    items: by..., id (distinct within by) and parent_ids. run takes ready items with `background` and gives by..., id, result (a string)
    and further columns; an item it leaves out stays undone, and so does what depends on it. Unknown parents and cycles block as well.
    In which round an item can be ready is told by its graph, so a round reads only its own items; graphs of more than `most` items
    go by joins alone. together: the items of a graph lie in a row already.
    """
    items = settled(levelled(items, by, together, most))
    sizes = {r["_level"]: r["count"] for r in items.groupBy("_level").count().collect()}
    own, done = items.drop("_level"), None
    for n in range(max(sizes, default=-1) + 1):
        if n > max_rounds:
            raise RuntimeError(f"work was left after {max_rounds} rounds")
        made = settled(run(with_background(items.where(F.col("_level") == n).drop("_level"), done, by, n == 0)).withColumn("round", F.lit(n)))
        done = made if done is None else done.unionByName(made)
        if made.isEmpty():
            break  # what waits at the next level waits for something of this one
        if n % 16 == 15:
            done = settled(done)  # one table instead of one a round
    if LARGE in sizes or done is None:
        more = joined_rounds(items.where(F.col("_level") == LARGE).drop("_level"), sizes.get(LARGE, 0), run, by, max_rounds)
        done = more if done is None else done.unionByName(more)
    extra = [c for c in done.columns if c not in (*by, "id")]
    made = done.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("id").alias("_id"), *extra)
    return own.join(made, (own["id"] == made["_id"]) & _all([own[c].eqNullSafe(made[f"_{c}"]) for c in by]), "left").select(*own.columns, *extra)


def joined_rounds(items: DataFrame, missing: int, run: Stage, by: list[str], max_rounds: int) -> DataFrame:
    """What run made of items, `missing` in number, with round: after each round all that is left meets all that is done."""
    done, n = None, 0
    while missing or done is None:
        left = items
        if done is not None:
            own = done.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("id").alias("_id"))
            left = items.join(own, (items["id"] == own["_id"]) & _all([items[c].eqNullSafe(own[f"_{c}"]) for c in by]), "left_anti")
        made = settled(run(with_background(left, done, by)).withColumn("round", F.lit(n)))
        done = made if done is None else done.unionByName(made)
        found, n = made.count(), n + 1
        missing -= found
        if not found:
            break
        if n > max_rounds:
            raise RuntimeError(f"work was left after {max_rounds} rounds")
        if n % 16 == 0:
            done = settled(done)  # one table instead of one a round
    return done


def collected(steps: DataFrame, client=echo) -> DataFrame:
    """One collecting call for each ready step: it sees title, description and background, and gives a summary; a failed call leaves an empty one."""
    prompt = F.to_json(F.struct("title", "description", "background"))
    out = model_map(steps.withColumn("_p", prompt), "_p", "summary", client)
    return out.select("outline_id", "section_id", "plan", "id", F.coalesce("parsed.info_summary", F.lit("")).alias("result"))


def section_plans(sections: DataFrame, planner=echo, collect: Stage = collected, most: int = MOST_PLANS) -> tuple[DataFrame, DataFrame]:
    """Plans of all given sections, round by round: (sections, steps).

    sections: outline_id, section_id, title, background array<string>. In each round a planner sees a section's title, background,
    the results so far and the number of the plan; its steps are worked off as their parents allow. A section ends when the planner says that its
    research is completed (`completed`), when its reply is no plan (`failed`), or after `most` plans (`limit`, `empty` if nothing was collected).
    Sections have status, plans (those with steps) and results (of all steps, by plan and order). Steps: outline_id, section_id, plan, id,
    place, parent_ids, result, round; a step that was never ready has a null round.
    """
    keys = ["outline_id", "section_id"]
    live = sections.select(*keys, "title", "background", F.array().cast("array<string>").alias("results"), F.lit(0).alias("plans"))
    ended, steps = None, None
    for k in range(most):
        prompt = F.to_json(F.struct("title", "background", "results", F.lit(k).alias("plan")))
        planned = settled(model_map(live.withColumn("_p", prompt), "_p", "plan", planner).drop("_p", "reply"))
        over = F.when(~F.col("valid"), "failed").when(F.coalesce("parsed.is_research_completed", F.lit(False)), "completed")
        stop = planned.where(over.isNotNull()).select(*keys, over.alias("status"), "plans", "results")
        ended = stop if ended is None else ended.unionByName(stop)
        going = planned.where(over.isNull())
        one = going.select(*keys, F.lit(k).alias("plan"), F.posexplode("parsed.steps").alias("place", "s"))
        none = F.array().cast("array<string>")
        one = one.select(*keys, "plan", F.col("s.id").alias("id"), "place", F.coalesce("s.title", F.lit("")).alias("title"), F.coalesce("s.description", F.lit("")).alias("description"), F.coalesce("s.parent_ids", none).alias("parent_ids"))
        worked = ready_rounds(one.where("length(id) > 0"), collect, [*keys, "plan"], together=True)
        steps = worked if steps is None else steps.unionByName(worked)
        found = worked.where("round is not null").groupBy(*keys).agg(ordered_list("place", "result").alias("_new")).withColumnsRenamed({c: f"_{c}" for c in keys})
        after = going.select(*keys, "title", "background", "results", "plans").join(found, _all([going[c].eqNullSafe(found[f"_{c}"]) for c in keys]), "left")
        live = after.select(*keys, "title", "background", F.concat("results", F.coalesce("_new", none)).alias("results"), (F.col("plans") + 1).alias("plans"))
    rest = live.select(*keys, F.when(F.size("results") > 0, "limit").otherwise("empty").alias("status"), "plans", "results")
    return ended.unionByName(rest), steps


def outline_research(sections: DataFrame, planner=echo, collect: Stage = collected, most: int = MOST_PLANS, value: Callable[[Column], Column] | None = None) -> DataFrame:
    """Sections of outlines (outline_id, id, title, parent_ids) planned and worked off when the sections they depend on are.

    A section sees the results of its parents' steps (by value, a string made of their array; default a line each). Returned are the
    sections' columns with result, status, plans, results and round; those on a cycle or with an unknown parent have nulls.
    """
    told = value or (lambda results: F.array_join(results, "\n"))

    def run(ready: DataFrame) -> DataFrame:
        own, _ = section_plans(ready.select("outline_id", F.col("id").alias("section_id"), "title", "background"), planner, collect, most)
        return own.select("outline_id", F.col("section_id").alias("id"), told(F.col("results")).alias("result"), "status", "plans", "results")

    return ready_rounds(sections, run, ["outline_id"])
