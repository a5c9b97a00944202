"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints of 64 bits are linked where they differ in `radius` bits or fewer. Candidates come from the
pigeonhole principle and are exact: the bits are cut into radius + 2 blocks, and two fingerprints within
the radius agree on two of those blocks at least, so they meet in the table of that pair of blocks. Within
a bucket of a table, fingerprints are compared bit-sliced: plane b holds bit b of all lanes, differences
are added into carry-save counters that serve 64 lanes an operation, and a block of lanes is given up
as soon as each lane exceeds the radius. A bucket is searched breadth-first against lanes not yet reached,
so it yields a spanning forest, never all pairs. Buckets over `tile` rows are cut into tiles, and each pair
of tiles is its own group: no task holds more than two tiles, no link is lost.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import ASCII_LOWER, components, cut, drop_cut, slices

ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(text: str | None, width: int) -> list[bytes]:
    """Word shingles with repeats, space-joined, A-Z lower-cased; fewer words give the whole sequence."""
    words = (text or "").encode().translate(ASCII_LOWER).split()
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]


def shingle_hashes(text: str | None, width: int, seed: int = 42) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, seed) for s in shingles(text, width)], dtype=np.uint64)


def majority(h: np.ndarray) -> int:
    """The 64-bit number whose bits are 1 where over half of h have 1; 0 for none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):  # bounded memory for very long texts
        part = np.ascontiguousarray(h[at : at + (1 << 15)]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def planes(fps: np.ndarray, bits: int = 64) -> np.ndarray:
    """(bits, words) matrix: row b has bit b of all lanes, 64 lanes a word; spare lanes are 0."""
    n = len(fps)
    table = np.zeros(((n + 63) // 64 * 64, 64), np.uint8)
    table[:n] = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(table.T, axis=1, bitorder="little")).view(np.uint64)[:bits]


def within(differ, count: int, shape: tuple, radius: int) -> np.ndarray:
    """Lanes (as bits) where at most `radius` of `count` difference planes are set; differ(b, keep) gives one.

    Carry-save: counter digit k is a plane of its own; a carry out of the highest digit, or a count over the
    radius when the planes end, kills the lane. Words whose lanes are all dead are given up every 8 planes.
    """
    digits = max(1, radius.bit_length())
    counter = [np.zeros(shape, np.uint64) for _ in range(digits)]
    dead = np.zeros(shape, np.uint64)
    keep = np.arange(shape[-1])
    out = np.zeros(shape, np.uint64)
    for b in range(count):
        carry = differ(b, keep)
        for k in range(digits):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        dead |= carry
        if b % 8 == 7 and len(keep):
            alive = (dead != ONES).any(axis=tuple(range(dead.ndim - 1))) if dead.ndim > 1 else dead != ONES
            if alive.sum() * 4 <= 3 * len(keep):
                keep, dead = keep[alive], dead[..., alive]
                counter = [c[..., alive] for c in counter]
        if not len(keep):
            return out
    over, equal = np.zeros_like(dead), np.full_like(dead, ONES)
    for k in reversed(range(digits)):  # count > radius, from the highest digit down
        if radius >> k & 1:
            equal = equal & counter[k]
        else:
            over, equal = over | (equal & counter[k]), equal & ~counter[k]
    out[..., keep] = ~(dead | over)
    return out


def lanes_of(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), axis=-1, bitorder="little")[..., :n].astype(bool)


def pairs_within(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Mask of lanes where a[i] and b[i] differ in at most radius bits."""
    if not len(a):
        return np.zeros(0, bool)
    x = planes(a ^ b)
    return lanes_of(within(lambda i, keep: x[i, keep], 64, x.shape[1:], radius), len(a))


def forest(fps: np.ndarray, radius: int, batch: int = 32) -> np.ndarray:
    """Edges (i, j) that connect what links within `radius` connects among distinct fps: one a row, and one for
    each two trees that meet.

    Heads are compared with the lanes not yet reached and, while several trees grow, with all reached lanes whose
    turn has not come: of two linked lanes, the one that is a head first sees the other.
    """
    n, edges = len(fps), []
    left, root = np.arange(n), np.arange(n)
    table, frontier = planes(fps), np.zeros(0, np.int64)

    def meet(near: np.ndarray, heads: np.ndarray, lanes: np.ndarray) -> None:
        while (apart := near & (root[heads][:, None] != root[lanes])).any():
            i, j = np.unravel_index(apart.argmax(), apart.shape)
            edges.append(np.array([[heads[i], lanes[j]]]))
            root[root == root[lanes[j]]] = root[heads[i]]

    while len(left) or len(frontier):
        if not len(frontier):
            heads, left = left[:batch], left[batch:]
            table = planes(fps[left])
        else:
            heads, frontier = frontier[:batch], frontier[batch:]
        waiting = np.concatenate([heads, frontier])
        if (root[waiting] != root[waiting[0]]).any():
            meet(np.bitwise_count(fps[heads][:, None] ^ fps[waiting]) <= radius, heads, waiting)
        if not len(left):
            continue
        flip = np.where((fps[heads][:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1), ONES, np.uint64(0))
        hit = lanes_of(within(lambda b, keep, t=table, f=flip: t[b][keep][None, :] ^ f[:, b][:, None], 64, (len(heads), table.shape[1]), radius), len(left))
        reached = hit.any(axis=0)
        if not reached.any():
            continue
        hit, lanes = hit[:, reached], left[reached]
        first = heads[hit.argmax(axis=0)]
        edges.append(np.stack([first, lanes], axis=1))
        root[lanes] = root[first]
        meet(hit, heads, lanes)  # lanes that several trees reach join them
        frontier = np.concatenate([frontier, lanes])
        left = left[~reached]
        table = planes(fps[left])
    return np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)


def bucket_links(keys: np.ndarray, fps: np.ndarray, radius: int, small: int = 64) -> list[tuple[int, int]]:
    """Links among rows sorted by key, within runs of equal keys, as pairs of fingerprints."""
    if len(keys) < 2:
        return []
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    length = np.diff(np.r_[start, len(keys)])
    size = np.repeat(length, length)
    out = []
    rows = np.flatnonzero((size > 1) & (size <= small))
    end = np.repeat(start + length, length)
    for shift in range(1, small):
        rows = rows[rows + shift < end[rows]]
        if not len(rows):
            break
        for at in range(0, len(rows), 1 << 16):
            i = rows[at : at + (1 << 16)]
            ok = i[pairs_within(fps[i], fps[i + shift], radius)]
            out += zip(fps[ok].tolist(), fps[ok + shift].tolist(), strict=True)
    for s, k in zip(start[length > small], length[length > small], strict=True):
        part = np.unique(fps[s : s + k])
        out += [(int(part[i]), int(part[j])) for i, j in forest(part, radius)]
    return out


def fingerprint_frame(docs: DataFrame, width: int = 3) -> DataFrame:
    """docs' columns doc_id and fp (the fingerprint as a signed long). Null and empty texts have 0."""

    def run(batches):
        for b in slices(batches):
            fps = np.array([majority(shingle_hashes(t, width)) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def deal(rows: DataFrame, tile: int) -> DataFrame:
    """(g, fp, node) sorted by g within partitions: g is a bucket of rows (t, key, fp, node), or a pair of tiles of one over tile rows."""
    hot = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > tile).withColumn("c", F.ceil(F.col("n") / tile).cast("int"))
    mine = F.pmod(F.xxhash64("node"), F.col("c")).cast("int")
    tiled = rows.join(hot, ["t", "key"], "left").withColumn("mine", F.coalesce(mine, F.lit(0)))
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("c") - 1, F.lit(0)))).alias("other")
    tiled = tiled.select("t", "key", "fp", "node", "mine", other)
    group = F.xxhash64("t", "key", F.least("mine", "other"), F.greatest("mine", "other"))
    return tiled.select(group.alias("g"), "fp", "node").repartition("g").sortWithinPartitions("g")


def fingerprint_links(fps: DataFrame, radius: int = 3, tile: int = 8192) -> DataFrame:
    """Edges (u, v) of longs that connect, directly or through others, all distinct fps within radius."""
    blocks = radius + 2
    bounds = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [sum(((1 << (bounds[i + 1] - bounds[i])) - 1) << bounds[i] for i in pair) for pair in combinations(range(blocks), 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    tables = F.array(*[F.struct(F.lit(i).cast("int").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)])
    rows = fps.select("fp").distinct().select("fp", F.explode(tables).alias("b")).select("b.t", "b.key", "fp", F.col("fp").alias("node"))
    dealt = deal(rows, tile).select("g", "fp")

    def run(batches):
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for b in batches:
            keys = np.concatenate([keys, b.column(0).to_numpy()])
            fps = np.concatenate([fps, b.column(1).to_numpy().view(np.uint64)])
            if len(keys) < 1 << 15:
                continue
            whole = int(np.searchsorted(keys, keys[-1]))  # the last run may go on in the next batch
            if whole:
                yield edges(keys[:whole], fps[:whole])
                keys, fps = keys[whole:], fps[whole:]
        yield edges(keys, fps)

    def edges(keys, fps):
        found = np.array(bucket_links(keys, fps, radius), dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["u", "v"])

    return dealt.mapInArrow(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Null, empty and blank texts have fingerprint 0 and are linked like any other. Repeated rows stay, with
    the same result. A null doc_id never is a component_id unless its whole component has none. Ties don't
    arise. Other columns of docs are ignored. An empty table gives an empty result.
    """
    fps = cut(fingerprint_frame(docs, width), "fps")
    firsts = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(fingerprint_links(fps, radius)).withColumnRenamed("node", "fp")
    rooted = firsts.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = cut(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: The near-copy stage: after SimHash, an exact join on shingles, rarest first; common ones are known from SAMPLE texts or a quarter of all, whichever are more.
SAMPLE, COMMON = 16_000, 100_000
#: In buckets over CROWD nodes, SimHash finds most links before all that is left is compared; TILE nodes at once.
CROWD, TILE = 16, 4096
#: Slots of a tally: how many of a set's items fall into each, 255 at most.
SLOTS = 256


def sketch(text: str | None, width: int) -> tuple[int, int, np.ndarray]:
    """(hash of the word sequence, SimHash fingerprint, sorted 31-bit hashes of the distinct shingles)."""
    words = (text or "").encode().translate(ASCII_LOWER).split()
    h = shingle_hashes(text, width)
    return xxhash.xxh64_intdigest(b" ".join(words), 7), majority(h), np.unique(h & np.uint64(0x7FFFFFFF)).astype(np.int32)


def prefix_length(n, similarity: float):
    """Two sets of sizes n and m that are alike in `similarity` share one of the first so many in any common order."""
    return n - np.ceil(similarity * n - 1e-6).astype(np.int64) + 1


def sketch_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of shingle hashes; two empty ones are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def tally(a: np.ndarray) -> bytes:
    """How many hashes of a set fall into each of SLOTS slots, a byte each."""
    return np.minimum(np.bincount(a & (SLOTS - 1), minlength=SLOTS), 255).astype(np.uint8).tobytes()


def may_be_alike(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, similarity: float) -> np.ndarray:
    """Mask of pairs of tallies (a row each) that the sets' similarity may still reach: sets differ in as many items as their
    tallies do at least, and alike ones in (1 - similarity) / (1 + similarity) of their sizes' sum at most. No alike pair is lost."""
    apart = np.abs(a.astype(np.int16) - b.astype(np.int16)).sum(axis=1, dtype=np.int64)
    return apart <= (na + nb) * (1 - similarity) / (1 + similarity) + 1e-6


def near_forest(fps: np.ndarray, sketches: list[np.ndarray], similarity: float, radius: int = 20, keep: int = 64, batch: int = 32) -> np.ndarray:
    """Edges (i, j) of alike sketches that join lanes into trees: each lane is compared, nearest fingerprint first, with
    `keep` lanes of other trees within radius (found bit-sliced). All edges are right; lanes may be left apart."""
    table, sizes, root, out = planes(fps), np.array([len(s) for s in sketches]), np.arange(len(fps)), []
    for at in range(0, len(fps), batch):
        heads = np.arange(at, min(at + batch, len(fps)))
        flip = np.where((fps[heads][:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1), ONES, np.uint64(0))
        near = lanes_of(within(lambda b, keep, f=flip: table[b][keep][None, :] ^ f[:, b][:, None], 64, (len(heads), table.shape[1]), radius), len(fps))
        near &= np.minimum(sizes[heads][:, None], sizes) >= similarity * np.maximum(sizes[heads][:, None], sizes) - 1e-6
        for k, i in enumerate(heads):
            lanes = np.flatnonzero(near[k] & (root != root[i]))
            lanes = lanes[np.argsort(np.bitwise_count(fps[lanes] ^ fps[i]), kind="stable")]
            for _ in range(keep):
                if not len(lanes):
                    break
                j, lanes = lanes[0], lanes[1:]
                if sketch_similarity(sketches[i], sketches[j]) >= similarity:
                    out.append((i, j))
                    root[root == root[j]] = root[i]
                    lanes = lanes[root[lanes] != root[i]]
    return np.array(out, np.int64).reshape(-1, 2)


def near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8, radius: int = 3, broadcast_ids: int = 1_000_000) -> DataFrame:
    """doc_id and component_id of each row of docs whose texts are alike in `similarity` of their `width`-word shingles.

    Texts with equal words are one node. SimHash proposes the first links, bit-sliced: all fingerprints within `radius`,
    and in crowded buckets of shingles each node's nearest ones (near_forest). Links count if the shingles prove them. What SimHash
    can't see (a cut tail moves many bits) an exact join adds: two alike sets of shingles share one of the first items of
    each in a common order, so all pairs that still lie in different components meet in a bucket of such an item. A group
    whose members are alike costs pairs in proportion to its size, and no pair is left out. component_id is the smallest
    doc_id of the group. Blank and null texts are one group. Rows are kept one for one; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sketches(batches):
        for b in slices(batches):
            found = [sketch(t, width) for t in b.column(1).to_pylist()]
            numbers = [pa.array(np.array([f[i] for f in found], dtype=np.uint64).view(np.int64)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *numbers, pa.array([f[2] for f in found], pa.list_(pa.int32()))], names=["doc_id", "node", "fp", "sketch"])

    rows = docs.select("doc_id", "text").mapInArrow(sketches, f"doc_id {kind}, node long, fp long, sketch array<int>")
    rows = cut(rows.withColumn("rid", F.monotonically_increasing_id()), "sketches")
    total = rows.count()

    def small(df: DataFrame, label: str) -> DataFrame:
        df = cut(df, label, total)
        return F.broadcast(df) if df.count() <= broadcast_ids else df  # some bytes an id; more are shuffled

    repeated = small(rows.groupBy("node").agg(F.count("*").alias("n"), F.min("rid").alias("first")).where("n > 1").select("node", "first"), "repeated")
    others = small(rows.select("node", "rid").join(repeated, "node").where("rid <> first").select("rid"), "others")
    nodes = rows.join(others, "rid", "left_anti").select("node", "fp", "sketch")

    heads = cut(nodes.groupBy("fp").agg(F.min("node").alias("head")), "heads", total)
    same = nodes.select("node", "fp").join(heads, "fp").where("node <> head").select(F.col("node").alias("u"), F.col("head").alias("v"))
    links = fingerprint_links(heads, radius).select(F.col("u").alias("fp"), F.col("v").alias("fpv"))
    links = links.join(heads, "fp").select(F.col("head").alias("u"), F.col("fpv").alias("fp")).join(heads, "fp").select("u", F.col("head").alias("v"))
    proposed = same.union(links)

    seen = nodes.where(F.pmod(F.xxhash64("node"), F.lit(max(1, min(4, total // SAMPLE)))) == 0).select(F.explode("sketch").alias("item")).groupBy("item").count().where("count > 1")
    common = seen.orderBy(F.desc("count"), "item").limit(COMMON).toPandas().sort_values("item")
    items, counts = common["item"].to_numpy(np.int32), common["count"].to_numpy(np.int64)

    def prefixes(batches):
        for b in slices(batches):
            out = []
            for node, h in zip(b.column(0).to_numpy(), b.column(1), strict=True):
                h = h.values.to_numpy()
                if not len(h):
                    continue
                at = np.minimum(np.searchsorted(items, h), max(0, len(items) - 1))
                often = np.where(items[at] == h, counts[at], 0) if len(items) else np.zeros(len(h), np.int64)
                first = h[np.argsort(often, kind="stable")[: prefix_length(np.int64(len(h)), similarity)]]
                out.append((first, np.full(len(first), node), np.full(len(first), len(h), np.int32), np.arange(len(first), dtype=np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["item", "node", "n", "i"])

    bucket = Window.partitionBy("item")
    shared = nodes.select("node", "sketch").mapInArrow(prefixes, "item int, node long, n int, i int").withColumn("of", F.count("*").over(bucket))
    shared = cut(shared.where("of > 1").select("item", "node", "n", "i", "of"), "shared")

    def trees(rows: pa.Table) -> pa.Table:
        node, fps = rows.column("node").to_numpy(), rows.column("fp").to_numpy().view(np.uint64)
        pairs = near_forest(fps, [x.values.to_numpy() for x in rows.column("sketch")], similarity)
        return pa.table({"u": node[pairs[:, 0]], "v": node[pairs[:, 1]]})

    crowded = shared.where(F.col("of") > CROWD).groupBy("node").agg(F.max(F.struct("of", "item")).alias("b")).select("node", "b.*")
    crowded = nodes.join(small(crowded, "crowded"), "node").withColumn("tile", F.pmod(F.xxhash64("node"), F.ceil(F.col("of") / TILE)))
    crowded = crowded.select("item", "tile", "node", "fp", "sketch").groupBy("item", "tile").applyInArrow(trees, "u long, v long")

    def tallies(batches):
        for b in slices(batches):
            held = [x.values.to_numpy() for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in held], pa.int32()), pa.array([tally(x) for x in held], pa.binary())], names=["node", "n", "tally"])

    def plausible(pairs: DataFrame, label: str) -> DataFrame:
        """The pairs (u, v) that may be alike by the tallies of their shingles: a fraction of the sketches' bytes."""
        edges = cut(pairs.select("u", "v"), label, total)
        ends = small(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "tallied")
        held = nodes.select("node", "sketch").join(ends, "node", "left_semi").mapInArrow(tallies, "node long, n int, tally binary")
        held = cut(held, "tallies", total)
        both = edges.join(held.toDF("u", "nu", "a"), "u").join(held.toDF("v", "nv", "b"), "v").select("u", "v", "nu", "nv", "a", "b")

        def keep(batches):
            for b in slices(batches, 4096):
                nu, nv = (b.column(i).to_numpy().astype(np.int64) for i in (2, 3))
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, SLOTS) for i in (4, 5))
                ok = pa.array(may_be_alike(x, y, nu, nv, similarity), pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["u", "v"])

        return both.mapInArrow(keep, "u long, v long")

    def verified(pairs: DataFrame, label: str) -> DataFrame:
        """The pairs (u, v) that are alike."""
        edges = cut(pairs.select("u", "v"), label, total)
        ends = small(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "ends")
        held = cut(nodes.select("node", "sketch").join(ends, "node", "left_semi"), "held", total, 20_000)
        both = edges.join(held.select(F.col("node").alias("u"), F.col("sketch").alias("a")), "u").join(held.select(F.col("node").alias("v"), F.col("sketch").alias("b")), "v").select("u", "v", "a", "b")

        def verify(batches):
            for b in batches:
                ok = pa.array([sketch_similarity(x.values.to_numpy(), y.values.to_numpy()) >= similarity for x, y in zip(b.column(2), b.column(3), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["u", "v"])

        out = cut(both.mapInArrow(verify, "u long, v long"), f"{label}-verified")
        drop_cut(held)
        return out

    linked = cut(verified(proposed.distinct(), "proposed").union(crowded), "linked", total)
    roots = components(linked, rows=total)
    placed = shared.join(small(roots, "placed"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = placed.withColumn("lo", F.min("root").over(bucket)).withColumn("hi", F.max("root").over(bucket))
    mixed = cut(placed.where("lo <> hi").select("item", "node", "n", "i", "root"), "mixed")  # buckets that hold several components
    mine = mixed.select("item", F.col("node").alias("u"), F.col("n").alias("nu"), F.col("i").alias("iu"), F.col("root").alias("ru"))
    other = mixed.select("item", F.col("node").alias("v"), F.col("n").alias("nv"), F.col("i").alias("iv"), F.col("root").alias("rv"))
    overlap = F.ceil(similarity / (1 + similarity) * (F.col("nu") + F.col("nv")) - 1e-6)  # the first common item has so many from it on in both
    meet = (F.col("u") < F.col("v")) & (F.col("ru") != F.col("rv")) & (F.col("iu") <= F.col("nu") - overlap) & (F.col("iv") <= F.col("nv") - overlap)
    meet = meet & (F.least("nu", "nv") >= similarity * F.greatest("nu", "nv") - 1e-6)
    rest = verified(plausible(mine.join(other, (mine["item"] == other["item"]) & meet).select("u", "v").distinct(), "met"), "rest")
    roots = components(rest.union(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))), rows=total)
    whole, rows = rows, cut(rows.select("doc_id", "node"), "nodes", total)
    drop_cut(whole)
    firsts = rows.groupBy("node").agg(F.min("doc_id").alias("first")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = cut(firsts, "firsts", total)
    named = firsts.join(firsts.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("node", "component_id")
    return rows.select("doc_id", "node").join(named, "node").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, groups: DataFrame, broadcast_ids: int = 1_000_000) -> DataFrame:
    """docs without the documents that aren't the component_id of their group in groups (doc_id, component_id).

    Rows without a doc_id stay, and rows that repeat a kept doc_id stay too.
    """
    gone = groups.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("kept")).where("not kept").select("doc_id")
    gone = cut(gone, "gone")
    if gone.count() <= broadcast_ids:  # 8 bytes an id; more are shuffled with the documents
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
