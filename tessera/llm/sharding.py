"""Sharding by extendible hashing. DataFrame functions only.

Rows are keyed by 60 bits of a hash of their id, followed by 60 bits of a hash of their place in the input, so
that even rows of one id can be told apart. The directory starts as one bucket; a bucket over the byte limit
splits on the next bit, and only such buckets do, until each fits or holds a single row. Splits are worked out
`step` bits at a time from sums of bytes by prefix, and only rows of oversized buckets take part in the next round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut

BITS = 60


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, bytes, and the key as a string of 120 binary digits."""
    bits = lambda x: F.lpad(F.conv(F.substring(F.md5(x), 1, 15), 16, 2), BITS, "0")
    own = bits(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    place = bits(F.monotonically_increasing_id().cast("string").cast("binary"))
    return docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), F.concat(own, place).alias("key"))


def shard(docs: DataFrame, limit: int = 16 << 20, step: int = 8) -> DataFrame:
    """doc_id, bytes, shard (the prefix of bits), depth, shard_rows, shard_bytes, over_limit of each row.

    Every shard holds `limit` bytes of text at most, but for one that is a single longer row (over_limit). Null
    texts have no bytes, null ids hash like an empty one. Repeated rows are told apart by their place. An
    empty table gives no rows. Other columns are ignored.
    """
    rows = cut(keyed(docs), "keyed")
    left, leaves = rows.select("key", "bytes"), None
    for low in range(0, 2 * BITS, step):
        top = min(low + step, 2 * BITS)
        fine = left.groupBy(F.substring("key", 1, top).alias("prefix")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n"))
        fine = cut(fine, "directory")
        depths = F.sequence(F.lit(low if low == 0 else low + 1), F.lit(top))
        sums = fine.select("prefix", "b", "n", F.explode(depths).alias("depth")).groupBy(F.substr("prefix", F.lit(1), F.col("depth")).alias("shard"), "depth").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
        fits = (F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1) | (F.col("depth") == 2 * BITS)
        fit = sums.where(fits)
        # a leaf fits and its parent, split on the last bit, doesn't
        parent = sums.where(~fits).select(F.col("shard").alias("up"), (F.col("depth") + 1).alias("depth"))
        first = F.col("depth") == (low if low == 0 else low + 1)
        leaf = fit.where(first).unionByName(fit.where(~first).join(parent, (F.substr("shard", F.lit(1), fit["depth"] - 1) == parent["up"]) & (fit["depth"] == parent["depth"]), "left_semi"))
        leaf = cut(leaf.select("shard", "depth", "shard_bytes", "shard_rows", F.lit(top).alias("top")), "leaves")
        leaves = leaf if leaves is None else leaves.unionByName(leaf)
        over = cut(sums.where(~fits & (F.col("depth") == top)).select(F.col("shard").alias("prefix")), "over")
        if over.isEmpty():
            break
        left = left.join(over, F.substring("key", 1, top) == over["prefix"], "left_semi")
    # each row meets its leaf by the fine prefix that the leaf covers
    leaves = cut(leaves, "directory")
    depths = [r.depth for r in leaves.select("depth").distinct().orderBy("depth").collect()]
    tries = F.explode(F.transform(F.array(*map(F.lit, depths or [0])), lambda d: F.substr("key", F.lit(1), d))).alias("shard")
    small = leaves.count() <= 100_000
    dim = leaves.drop("top")
    dealt = rows.select("doc_id", "bytes", tries).join(F.broadcast(dim) if small else dim, "shard")
    return dealt.select("doc_id", "bytes", "shard", F.col("depth").cast("int").alias("depth"), "shard_rows", "shard_bytes", (F.col("shard_bytes") > limit).alias("over_limit"))


SQL = """
WITH RECURSIVE k AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS bytes,
    lpad(bin(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT)), 60, '0') AS key FROM documents),
t AS (
  SELECT doc_id, bytes, key, 0 AS depth, '' AS shard, sum(bytes) OVER () AS shard_bytes, count(*) OVER () AS shard_rows FROM k
  UNION ALL
  SELECT doc_id, bytes, key, depth + 1, substr(key, 1, depth + 1), sum(bytes) OVER (PARTITION BY substr(key, 1, depth + 1)), count(*) OVER (PARTITION BY substr(key, 1, depth + 1))
  FROM t WHERE shard_bytes > {limit} AND shard_rows > 1 AND depth < 60)
SELECT doc_id, bytes, shard, CAST(depth AS INTEGER) AS depth, CAST(shard_rows AS BIGINT) AS shard_rows, CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_bytes > {limit} AS over_limit
FROM t WHERE shard_bytes <= {limit} OR shard_rows = 1
"""
