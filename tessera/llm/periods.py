"""Periodic runs: stretches of words that repeat themselves with a period, as long as they can be made.

A suffix automaton over a text's words has a state for each set of places at which some sequences of words
end. The sets are built from the longest states to the shortest: the smaller of two ordered sets is put into
the larger, place by place. Two places that become neighbours in the set of a state at a distance of at most
the state's length are two ends of a sequence whose copies touch or overlap: a square. It is followed to
both sides as far as words at that distance are equal, which gives the whole run. Neighbours are at the
smallest distance, so this is the smallest period.

Before that, stretches are looked up that alone can hold runs. A run of `least` words or of two periods is
covered by sequences of `least`/2 words that occur at two places of it, whatever its period: a text without
such repeated sequences has no run, and an automaton is made only for stretches that they cover. Equal hashes
of different sequences only add to the stretches.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.common import named_back, set_aside, slices

LEAST = 12
BASE = np.uint64(0x9E3779B97F4A7C15)
RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))


class Places:
    """An ordered set of integers, in blocks, so that adding one moves few others."""

    BLOCK = 512

    def __init__(self, first: int):
        self.size, self.blocks, self.heads = 1, [[first]], [first]

    def __iter__(self):
        for b in self.blocks:
            yield from b

    def add(self, x: int) -> tuple[int | None, int | None]:
        """Put x in; returns its neighbours, the next smaller and the next larger."""
        k = max(0, bisect_right(self.heads, x) - 1)
        block = self.blocks[k]
        at = bisect_left(block, x)
        before = block[at - 1] if at else None
        after = block[at] if at < len(block) else self.heads[k + 1] if k + 1 < len(self.heads) else None
        block.insert(at, x)
        self.heads[k] = block[0]
        self.size += 1
        if len(block) > 2 * self.BLOCK:
            self.blocks[k : k + 1] = [block[: self.BLOCK], block[self.BLOCK :]]
            self.heads.insert(k + 1, block[self.BLOCK])
        return before, after


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix link, length and own place (-1 for a copied state) of each state of the words' suffix automaton; 0 is the root."""
    follow, link, length, place = [{}], [-1], [0], [-1]
    last = 0
    for i, c in enumerate(words):
        new = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        place.append(i)
        p = last
        while p != -1 and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if p == -1:
            link.append(0)
        else:
            q = follow[p][c]
            if length[q] == length[p] + 1:
                link.append(q)
            else:
                copied = new + 1
                link.append(copied)
                follow.append(follow[q].copy())
                link.append(link[q])
                length.append(length[p] + 1)
                place.append(-1)
                link[q] = copied
                while p != -1 and follow[p].get(c) == q:
                    follow[p][c] = copied
                    p = link[p]
        last = new
    return link, length, place


def repeats(words: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of each maximal stretch that is at least two of its smallest periods long."""
    link, length, place = automaton(words)
    n, found, out = len(words), {}, []

    def square(x: int, d: int, known: int) -> None:
        """Words end alike at x and x + d over `known` words: the run around them, unless it was seen."""
        starts, ends = found.setdefault(d, ([], []))
        at = bisect_right(starts, x)
        if at and ends[at - 1] > x:
            return
        low, high = x - known + 1, x + 1
        while low > 0 and words[low - 1] == words[low - 1 + d]:
            low -= 1
        while high + d < n and words[high] == words[high + d]:
            high += 1
        starts.insert(at, low)
        ends.insert(at, high)
        out.append((low, high - low + d, d))

    sets = [Places(x) if x >= 0 else None for x in place]
    for v in sorted(range(1, len(link)), key=length.__getitem__, reverse=True):
        own, sets[v] = sets[v], None
        p = link[v]
        if p == 0:
            continue
        if sets[p] is None:
            sets[p] = own
            continue
        large, small = (own, sets[p]) if own.size > sets[p].size else (sets[p], own)
        most = length[p]
        for x in small:
            before, after = large.add(x)
            if before is not None and x - before <= most:
                square(before, x - before, most)
            if after is not None and after - x <= most:
                square(x, after - x, most)
        sets[p] = large
    return out


def covered(words: np.ndarray, gram: int, least: int) -> list[tuple[int, int]]:
    """Stretches [start, end) of at least `least` words, all within sequences of `gram` words that occur twice."""
    n = len(words)
    if n < least:
        return []
    h = np.zeros(n - gram + 1, dtype=np.uint64)
    for k in range(gram):
        h = h * BASE + words[k : n - gram + 1 + k]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return []
    often = np.zeros(len(h), dtype=bool)
    often[order[1:][same]] = often[order[:-1][same]] = True
    steps = np.zeros(n + 1, dtype=np.int64)
    steps[:-gram] += often
    steps[gram:] -= often
    inside = np.r_[False, np.cumsum(steps)[:-1] > 0, False]
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    return [(int(a), int(b)) for a, b in zip(turns[::2], turns[1::2], strict=True) if b - a >= least]


def runs_of(words: list[bytes], least: int = LEAST, passes: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run: at least `least` words and two periods long; by start, then period.

    The stretches are narrowed in a few passes; fewer passes give the same runs.
    """
    if len(words) < least:
        return []
    seen: dict[bytes, int] = {}
    ids = [seen.setdefault(w, len(seen) + 1) for w in words]
    own, gram = np.array(ids, dtype=np.uint64) * BASE, max(1, least // 2)
    parts = [(0, len(ids))]
    for _ in range(passes):
        inner = [(a + s, a + e) for a, b in parts for s, e in covered(own[a:b], gram, least)]
        if inner == parts:
            break
        parts = inner
    return sorted(((a + s, length, d) for a, b in parts for s, length, d in repeats(ids[a:b]) if length >= least), key=lambda r: (r[0], r[2]))


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    steps = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(steps)[:-1] == 0)]


def periodic_runs(docs: DataFrame, least: int = LEAST, edit: Callable | None = None, key: str = "doc_id") -> DataFrame:
    """docs' columns, then `runs` (start, length, period in words; by start, then period) and `collapsed`: the words
    without the repetitions in runs, joined by one space.

    Words are what ASCII white space parts. edit(key value, words), if given, is applied to the words first. A null
    or wordless text has no runs and an empty collapsed text. Each row is worked on by itself, so rows are kept one
    for one, repeated ones included, without a shuffle; a text's time is about n log n in the words of its covered stretches.
    Other columns pass through, those that have the name of an added one with _in after it.
    """
    given, docs = docs, set_aside(docs, (key, "text"))
    at, own_key = docs.columns.index("text"), docs.columns.index(key)
    wide = T.StructType([*docs.schema.fields, T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])

    def run(batches):
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
        for b in slices(batches):
            runs, texts = [], []
            for k, text in zip(b.column(own_key).to_pylist(), b.column(at).to_pylist(), strict=True):
                words = text.encode().split() if text else []
                if edit:
                    words = edit(k, words)
                found = runs_of(words, least)
                runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                texts.append(b" ".join(kept_words(words, found)).decode())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(runs, kind), pa.array(texts, pa.string())], names=wide.names)

    return named_back(docs.mapInArrow(run, wide), given)
