"""Benchmark decontamination: a prefix-filtered set join with exact, item-sized windows.

A window is `window` consecutive words of an item (all of a shorter item). For exact containment one prefix
token is enough: the rarest word of the window, by counts over all documents. A document that has the token
is aligned with the item there, must have room for the window (length and position bounds), and the words
around the token are compared until they differ; neighbouring windows with the same token share that work.

The benchmark is held in memory in blocks of at most `block_chars` characters. Each block is one pass over
the rows of the same task, chained without a shuffle, so a benchmark of any size works with a bounded
broadcast, and results over several blocks are merged row by row.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import ASCII_LOWER, named_back, set_aside, slices

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
FOUND = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("hit_ranges", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))]


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode().translate(ASCII_LOWER)) if text else []


def build_index(items: list[tuple[str, str | None]], counts: dict[bytes, int], window: int) -> dict[bytes, list]:
    """Rarest token -> [(item id, item words, token's place, first and last word any of its windows has, length)]."""
    spans: dict[tuple, list[int]] = {}
    tokens = [(str(i), words_of(t)) for i, t in items]
    for k, (_, words) in enumerate(tokens):
        size, seen = min(window, len(words)), set()
        for p in range(len(words) - size + 1 if words else 0):
            same = tuple(words[p : p + size])
            if same in seen:  # a window that the item repeats is found by its first place
                continue
            seen.add(same)
            at = min(range(p, p + size), key=lambda q: (counts.get(words[q], 0), words[q], q))
            spans.setdefault((k, at, size), []).append(p)
    index: dict[bytes, list] = {}
    for (k, at, size), starts in spans.items():
        item, words = tokens[k]
        index.setdefault(words[at], []).append((item, words, at, min(starts), max(starts) + size - 1, size))
    return index


def hits(words: list[bytes], index: dict[bytes, list]) -> tuple[list[tuple[int, int]], set[str]]:
    """Ranges [start, end) of document words within an occurring window, not yet merged, and the items."""
    ranges, found, n = [], set(), len(words)
    if index.keys().isdisjoint(words):
        return ranges, found
    for i, w in enumerate(words):
        for item, other, at, low, high, size in index.get(w, ()):
            if n < size or i + (high - at) < size - 1 or n - i + (at - low) < size:
                continue
            left = right = 0
            while left < at - low and i > left and words[i - left - 1] == other[at - left - 1]:
                left += 1
            while right < high - at and i + right + 1 < n and words[i + right + 1] == other[at + right + 1]:
                right += 1
            if left + right + 1 >= size:
                ranges.append((i - left, i + right + 1))
                found.add(item)
    return ranges, found


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def corpus_counts(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """How often each word of vocabulary occurs in all documents; as large as the vocabulary at most."""

    def run(batches):
        counts: Counter = Counter()
        for b in slices(batches):
            for text in b.column(0).to_pylist():
                counts.update(w for w in words_of(text) if w in vocabulary)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["w", "n"])

    rows = docs.select("text").mapInArrow(run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.w): r.n for r in rows}


def match_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_chars: int = 1 << 24) -> DataFrame:
    """docs' columns, then n_words, n_hit, n_items, items_sha256 and contaminated.

    Every row of docs stays, repeated ones included. A null or wordless text has no words and no hit. Items
    that are null, wordless or without an id are left out; repeated item ids count once. An empty benchmark
    hits nothing. Columns of docs that have the name of an added one come back with _in after it.
    """
    spark, given = docs.sparkSession, docs
    docs = set_aside(docs)
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    blocks = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    at = docs.columns.index("text")
    wide = T.StructType([*docs.schema.fields, *FOUND])
    out = docs
    for k in range(blocks):
        block = [(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()]
        counts = corpus_counts(docs, {w for _, t in block for w in words_of(t)})
        shared = spark.sparkContext.broadcast(build_index(sorted(block), counts, window))

        def run(batches, shared=shared, first=k == 0):
            index = shared.value
            for b in slices(batches):
                n_words, n_hit, kept, items = [], [], [], []
                for j, text in enumerate(b.column(at).to_pylist()):
                    words = words_of(text)
                    ranges, found = hits(words, index)
                    if not first:
                        old = b.column(b.num_columns - 2)[j].as_py()
                        ranges += list(zip(old[::2], old[1::2], strict=True))
                        found |= set(b.column(b.num_columns - 1)[j].as_py())
                    ranges = merged(ranges)
                    n_words.append(len(words))
                    n_hit.append(sum(y - x for x, y in ranges))
                    kept.append([v for r in ranges for v in r])
                    items.append(sorted(found))
                own = b.columns if first else b.columns[:-4]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(kept, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names=wide.names)

        out = out.mapInArrow(run, wide)
    out = out.select(*docs.columns, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
    return named_back(out, given)


SQL = """
WITH iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (
  SELECT DISTINCT item, least(10, len(w)) AS k, array_to_string(list_slice(w, p, p + least(10, len(w)) - 1), ' ') AS g
  FROM iw, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS r(p) WHERE len(w) > 0),
dw AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
grams AS (
  SELECT rid, k, p, array_to_string(list_slice(w, p, p + k - 1), ' ') AS g
  FROM dw, (SELECT DISTINCT k FROM win) AS ks, unnest(range(1, len(w) - k + 2)) AS r(p) WHERE len(w) >= k),
found AS (SELECT rid, p, grams.k, item FROM grams JOIN win ON grams.k = win.k AND grams.g = win.g),
hit AS (SELECT rid, count(DISTINCT q) AS n_hit FROM found, unnest(range(p, p + k)) AS r(q) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT rid, item FROM found) AS x GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
"""
