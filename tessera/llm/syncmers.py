"""Document fingerprints from closed syncmers. DataFrame functions only.

Tokens are runs of at most PIECE_CHARS characters without white space, and single characters of scripts written without
spaces; all texts are read alike, with K - 1 marks before and after them. A k-mer of tokens is a closed syncmer if the
smallest hash among its inner s-mers is that of its first or last one: whether it is chosen depends on nothing outside
it, so equal passages have equal anchors wherever they stand, and among any K - S neighbouring k-mers one is chosen.

Matching is positional: a link is an anchor, the distance to the next anchor, and that one. A fingerprint is all links of
a text in their order (8 hex digits each, so it grows with the text), from the beginning's to the end's. The likeness of
two is the number of distinct links they share over that of the one that has more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import named_back, set_aside

K, S = 7, 2
PIECE_CHARS = 8
SINGLE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}"
PIECE = rf"[{SINGLE}]|[^ \t\n\x0B\f\r{SINGLE}]{{1,{PIECE_CHARS}}}"
MASK = 0xFFFFFFFF
#: Stand for the marks before and after a text.
BEFORE, AFTER = -1, -2


def let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def closed(h: Column, k: int, s: int) -> Column:
    """Places, in order, of the closed syncmers among the k-mers of an array of hashes."""

    def chosen(inner: Column) -> Column:
        def keep(i: Column) -> Column:
            first, last = F.get(inner, i), F.get(inner, i + (k - s))
            least = F.least(first, *[F.get(inner, i + j) for j in range(1, k - s)], last)
            return (least == first) | (least == last)

        return F.filter(F.sequence(F.lit(0), F.size(h) - k), keep)

    return let(F.transform(F.slice(h, 1, F.size(h) - (s - 1)), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, s)])), chosen)


def anchors(text: Column) -> Column:
    """array<struct<hash,pos>> of the closed syncmers of K tokens, in order; an empty or blank text has none. text may not be null."""

    def named(h: Column) -> Column:
        return F.transform(closed(h, K, S), lambda i: F.struct(F.xxhash64(*[F.get(h, i + j) for j in range(K)]).alias("hash"), i.alias("pos")))

    hashes = F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda w: F.xxhash64(w))
    marked = lambda h: F.concat(F.array_repeat(F.lit(BEFORE).cast("long"), K - 1), h, F.array_repeat(F.lit(AFTER).cast("long"), K - 1))
    return let(hashes, lambda h: F.when(F.size(h) > 0, let(marked(h), named)).otherwise(F.array().cast("array<struct<hash:bigint,pos:int>>")))


def links(text: Column) -> Column:
    """array<int>: for each anchor a hash of it, the distance to the next one and that one, and one for the way to the first."""

    def joined(a: Column) -> Column:
        first = F.array(F.xxhash64(F.lit(BEFORE), F.get(a, F.lit(0))["pos"], F.get(a, F.lit(0))["hash"]))
        after = F.transform(a, lambda x, i: F.xxhash64(x["hash"], F.coalesce(F.get(a, i + 1)["pos"] - x["pos"], F.lit(0)), F.coalesce(F.get(a, i + 1)["hash"], F.lit(AFTER).cast("long"))))
        return F.transform(F.concat(first, after), lambda x: F.shiftright(x, 32).cast("int"))

    return let(anchors(text), lambda a: F.when(F.size(a) > 0, joined(a)).otherwise(F.array().cast("array<int>")))


def shown(sk: Column) -> Column:
    return F.array_join(F.transform(sk, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(MASK))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: shared distinct links over those of the fingerprint that has more; two empty ones are alike."""
    most = F.greatest(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return let(most, lambda n: F.when(n == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / n))


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs' columns, then sketch (the links) and fingerprint. Null texts count as empty: an empty fingerprint. Rows are kept one for one."""
    out = set_aside(docs).withColumn("sketch", links(F.coalesce("text", F.lit(""))))
    return named_back(out.withColumn("fingerprint", shown(F.col("sketch"))), docs)


def with_ranges(docs: DataFrame, rows: int, coarse: int = 1024, fine: int = 128) -> DataFrame:
    """docs (doc_id, text, h) with `range`: numbers that rise in the order of descending doc_id, nulls last, then h.

    A range has about `rows` rows, more from coarse * fine * rows rows on. Ids are cut at quantiles of all ids, and evenly
    between them; an id with the rows of two quantiles (at most coarse / 2 have) and the null are cut evenly by h.
    """
    n = docs.count()
    parts = max(1, min(coarse, -(-n // rows)))
    inner = max(1, min(fine, -(-n // (rows * parts))))
    marks = docs.agg(F.percentile_approx("doc_id", F.array(*[F.lit(i / parts) for i in range(parts + 1)]), 20 * parts)).first()[0] or [0, 0]
    often = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > max(rows, 2 * n // parts)).collect()
    hot = {r.doc_id: -(-r.n // rows) for r in often}
    ids = [int(v) for v in hot if v is not None]
    bounds = sorted({int(b) for b in marks[1:-1]} | {v - 1 for v in ids} | set(ids))
    edges = [int(marks[0]), *bounds, int(marks[-1])]
    cuts = [hot.get(b, inner) for b in bounds] + [inner]  # range p ends at bounds[p]; that of a hot id holds nothing else
    longs = lambda x: F.array(*map(F.lit, x)).cast("array<bigint>")
    p = F.size(F.filter(longs(bounds), lambda b: b < F.col("doc_id")))
    out = docs.withColumn("_p", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(p))
    low, high, m = F.get(longs(edges[:-1]), F.col("_p")), F.get(longs(edges[1:]), F.col("_p")), F.coalesce(F.get(longs(cuts), F.col("_p")), F.lit(hot.get(None, 1)))
    by_id = (high - F.col("doc_id")).cast("double") / (high - low + 1)
    by_hash = F.col("h").cast("double") / F.lit(2.0**64) + 0.5
    split = F.col("doc_id").isNull() | F.col("doc_id").isin(ids) if ids else F.col("doc_id").isNull()
    sub = F.greatest(F.lit(0), F.least(m - 1, F.floor(F.when(split, by_hash).otherwise(by_id) * m)))
    return out.withColumn("range", (F.lit(len(bounds)) - F.col("_p")) * F.lit(1 << 32) + sub).drop("_p")


def edited_likeness(docs: DataFrame, rows: int = 2000) -> DataFrame:
    """Each document's fingerprint against its edited text's and the next document's.

    The next document is that of the next smaller doc_id (rows of one id, and those of none at the end, by a hash of the
    text); the first follows the last. The edited text is the text with its last floor(n_chars / 2) code points replaced
    by the next one's first as many, or all. Null texts count as empty, repeated rows stay. Texts are shuffled once, into
    ranges of that order; a range's first row also goes to the range before it, so no range needs another. Copies of one
    text under one id are one place in the order and share a range.
    """
    rows_ = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    ranged = with_ranges(rows_, rows)
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not("doc_id").alias("down"), F.col("h").alias("h"))
    heads = ranged.groupBy("range").agg(F.min(place).alias("head"))
    order = Window.orderBy("range")  # a row a range
    heads = heads.withColumn("to", F.coalesce(F.lag("range").over(order), F.max("range").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    sketched = ranged.withColumn("sketch", links(F.col("text"))).join(F.broadcast(heads), "range")
    own = F.struct("range", F.lit(False).alias("guest"))
    goes = F.when(F.col("head").eqNullSafe(place), F.array(own, F.struct(F.col("to").alias("range"), F.lit(True).alias("guest")))).otherwise(F.array(own))
    dealt = sketched.select("doc_id", "text", "h", "sketch", F.explode(goes).alias("g")).select("doc_id", "text", "h", "sketch", "g.range", "g.guest")
    w = Window.partitionBy("range").orderBy("guest", F.desc_nulls_last("doc_id"), "h")
    paired = dealt.withColumn("_next", F.lead("text").over(w)).withColumn("_nsk", F.lead("sketch").over(w)).where("not guest")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("_next", F.lit(1), half))
    paired = paired.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("_edited"), "sketch", "_nsk")
    out = paired.withColumn("_esk", links(F.col("_edited")))
    return out.select(
        "doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), shown(F.col("sketch")).alias("fingerprint"), shown(F.col("_esk")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("_esk")).alias("near_edited"), likeness(F.col("sketch"), F.col("_nsk")).alias("near_next"),
    )
