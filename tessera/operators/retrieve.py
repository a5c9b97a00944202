"""Retrieval: thresholded vector and keyword top-k, containment and fuzzy matches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.functions.fuzzy import best_ratios
from tessera.operators.graph import settled


def ranked(df: DataFrame, within: list[str], order: list, k: int) -> DataFrame:
    w = Window.partitionBy(*within).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def vector_topk(queries: DataFrame, base: DataFrame, k: int, threshold: float = -1.0, block: int = 512) -> DataFrame:
    """query_id, kb, vec_id, score and rank: the k best cosines per query and kb with score >= threshold.

    queries (query_id, embedding) are taken in blocks of `block`, so the driver and each task hold one block;
    each block is one pass over base (vec_id, embedding, kb) that keeps k rows per partition, query and kb.
    Ties go to the smaller vec_id. Rows whose vector is null are left out.
    """
    queries = queries.where("query_id is not null and embedding is not null")
    blocks, out = max(1, -(-queries.count() // block)), None
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
        if not rows:
            continue
        ids = np.array([r.query_id for r in rows], np.int64)
        q = np.array([r.embedding for r in rows], np.float64)
        shared = base.sparkSession.sparkContext.broadcast((ids, q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)))

        def run(batches, shared=shared):
            ids, q = shared.value
            for part in batches:
                vec, kb = part.column(0).to_numpy(), part.column(2).to_numpy()
                x = np.array(part.column(1).to_pylist(), np.float64).reshape(len(vec), -1)
                if not len(vec):
                    continue
                s = q @ (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).T
                for name in np.unique(kb):
                    own = np.flatnonzero(kb == name)
                    order = np.lexsort((np.broadcast_to(vec[own], (len(ids), len(own))), -s[:, own]), axis=1)[:, :k]
                    best = own[order]
                    score = np.take_along_axis(s, best, axis=1)
                    ok = score >= threshold
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.broadcast_to(ids[:, None], best.shape)[ok]), pa.array(np.full(int(ok.sum()), name, np.int64)), pa.array(vec[best][ok]), pa.array(score[ok])], names=["query_id", "kb", "vec_id", "score"]
                    )

        typed = base.where("embedding is not null").select(F.col("vec_id").cast("long"), "embedding", F.col("kb").cast("long"))
        got = typed.mapInArrow(run, "query_id long, kb long, vec_id long, score double")
        out = got if out is None else out.unionByName(got)
    if out is None:
        out = base.sparkSession.createDataFrame([], "query_id long, kb long, vec_id long, score double")
    return ranked(out, ["query_id", "kb"], [F.desc("score"), "vec_id"], k)


def contained(docs: DataFrame, passages: DataFrame, block_chars: int = 1 << 24) -> DataFrame:
    """doc_id, item_id and position of the first occurrence of each passage inside each text that has it.

    Passages are searched all at once by an automaton, in blocks of bounded size; each block is one pass.
    """
    import ahocorasick

    passages = passages.where("text is not null and text <> ''").select("item_id", "text")
    blocks, out = max(1, -(-(passages.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars)), None
    for b in range(blocks):
        wanted: dict[str, list[int]] = {}
        for r in passages.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect():
            wanted.setdefault(r.text, []).append(r.item_id)
        items = sorted(wanted.items())

        def run(batches, items=items):
            auto = ahocorasick.Automaton()
            for text, ids in items:
                auto.add_word(text, (len(text), ids))
            if items:
                auto.make_automaton()
            for part in batches:
                docs_, item, at = [], [], []
                for i, text in enumerate(part.column(1).to_pylist() if items else []):
                    first: dict[int, int] = {}
                    for end, (n, ids) in auto.iter(text or ""):
                        for x in ids:
                            first.setdefault(x, end - n + 1)
                    docs_ += [i] * len(first)
                    item += list(first)
                    at += list(first.values())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(docs_, pa.int64())), pa.array(item, pa.int64()), pa.array(at, pa.int64())], names=["doc_id", "item_id", "position"])

        got = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, position long")
        out = got if out is None else out.unionByName(got)
    return out


def in_units(side: DataFrame, own: str, parts: DataFrame, other: str) -> DataFrame:
    """Rows of a side once for each unit of their group that they belong to: own is the part a text is dealt to, other goes over all parts of the other side."""
    n = side.join(F.broadcast(parts), "grp", "left").fillna(1, ["_l", "_r"])
    dealt = n.withColumn("_own", F.pmod(F.xxhash64("text"), F.col(own)).cast("int"))
    return dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), (F.col(other) - 1).cast("int")))).withColumnsRenamed({"_own": f"{own}b", "_other": f"{other}b"}).drop("_l", "_r")


def best_alike(left: DataFrame, right: DataFrame, threshold: float, limit: int, most: int = 2048, wide: int | None = None) -> DataFrame:
    """lid, rid and score of the best right texts of its group for each left text (grp, id, text; ids and texts of a group's side distinct).

    A group is taken as it is; one of more than `most` left or `wide` (default 16 times as many) right texts is cut into parts of about that many,
    and each left part meets each right part, so that a task holds two parts at most. Each gives up to `limit` rows a left text. Texts are
    shipped once for each part of the other side; likenesses are worked out only of those that are found by their numbers, or where a bound from shared
    characters can still be among the best (functions.fuzzy.best_ratios).
    """
    count = lambda side, name, size: side.groupBy("grp").agg(F.ceil(F.count("*") / size).alias(name))
    over = count(left, "_l", most).where("_l > 1").join(count(right, "_r", wide or 16 * most).where("_r > 1"), "grp", "full")
    parts = settled(over.select("grp", F.coalesce("_l", F.lit(1)).cast("long").alias("_l"), F.coalesce("_r", F.lit(1)).cast("long").alias("_r")))
    sides = in_units(left, "_l", parts, "_r").select("grp", "_lb", "_rb", F.lit(0).alias("side"), "id", "text").unionByName(in_units(right, "_r", parts, "_l").select("grp", "_lb", "_rb", F.lit(1).alias("side"), "id", "text"))
    kind = left.schema["id"].dataType.simpleString()

    def found(lefts: list[tuple], rights: list[tuple]):
        rights.sort()
        ids, texts = [i for i, _ in rights], [s for _, s in rights]
        for (i, _), best in zip(lefts, best_ratios([s for _, s in lefts], texts, threshold, limit), strict=True):
            yield from ((i, ids[k], score) for score, k in best)

    def run(batches):
        unit, lefts, rights, out = None, [], [], []
        for b in batches:
            grp, lb, rb, side, ids, texts = (c.to_pylist() for c in b.columns)
            for k, own in enumerate(zip(grp, lb, rb, strict=True)):
                if own != unit:
                    if lefts and rights:
                        out += found(lefts, rights)
                    unit, lefts, rights = own, [], []
                (rights if side[k] else lefts).append((ids[k], texts[k]))
            yield rows_of(out)
            out = []
        if lefts and rights:
            yield rows_of(list(found(lefts, rights)))

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        lid, rid, score = zip(*rows, strict=True) if rows else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(lid, at), pa.array(rid, at), pa.array(score, pa.float64())], names=["lid", "rid", "score"])

    at = to_arrow_type(left.schema["id"].dataType)
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sides.repartition(n, "grp", "_lb", "_rb").sortWithinPartitions("grp", "_lb", "_rb")
    return dealt.mapInArrow(run, f"lid {kind}, rid {kind}, score double")


def best_fuzzy(left: DataFrame, right: DataFrame, threshold: float, limit: int = 1) -> DataFrame:
    """id, match_id, score and rank of the `limit` best ratios of each left text among right texts of its group; ties to the smaller id.

    left, right: grp, id (of one kind, distinct within a side), text. Null groups and texts have no match; threshold is over 0. Each different text is
    compared once however often it occurs; of equal right texts the `limit` smallest ids are taken.
    """
    keys = ["grp", "text"]
    lefts, rights = (side.where("grp is not null and text is not null").groupBy(*keys) for side in (left, right))
    lefts = lefts.agg(F.min("id").alias("id"))
    rights = rights.agg(F.min("id").alias("id")) if limit == 1 else rights.agg(F.min("id").alias("id"), F.slice(F.sort_array(F.collect_set("id")), 1, limit).alias("ids"))
    lefts, rights = settled(lefts), settled(rights)  # each is read several times
    scored = best_alike(lefts, rights.select(*keys, "id"), threshold, limit)
    if limit > 1:
        scored = scored.join(rights.select(F.col("id").alias("rid"), "ids"), "rid").select("lid", "score", F.explode("ids").alias("rid"))
    best = ranked(scored, ["lid"], [F.desc("score"), "rid"], limit)
    own = left.select("id", *keys).join(lefts.select(*keys, F.col("id").alias("lid")), keys)
    return own.join(best, "lid").select("id", F.col("rid").alias("match_id"), "score", "rank")
