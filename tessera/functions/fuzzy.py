"""Ratcliff-Obershelp similarities. Spark has no such function: pandas UDFs over Arrow batches."""

from __future__ import annotations

import math
import re
from bisect import insort
from collections import Counter
from difflib import SequenceMatcher
from itertools import combinations
from os.path import commonprefix

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def ratio_of(a: str, b: str) -> float:
    return 100.0 * SequenceMatcher(None, a or "", b or "").ratio()


def ratio_over(a: str, b: str, bar: float) -> float:
    """ratio_of, or 0 where bounds by lengths and letters show that it isn't over bar."""
    a, b = a or "", b or ""
    if a == b:
        return 100.0
    if 200.0 * min(len(a), len(b)) <= bar * (len(a) + len(b)):
        return 0.0
    m = SequenceMatcher(None, a, b)
    return 100.0 * m.ratio() if 100.0 * m.quick_ratio() > bar else 0.0


def ratio_reaches(a: str, b: str, bar: float) -> bool:
    """Whether ratio_of is bar or more; it is worked out only where two bounds don't tell.

    Characters that match are a common subsequence, so there are no more of them than the longest one has. SequenceMatcher takes the longest common
    piece first, unless b has the 200 characters from which on it leaves out frequent ones, so they are no fewer than a common start or end has.
    """
    a, b = a or "", b or ""
    if a == b:
        return bar <= 100.0
    n, short = len(a) + len(b), min(len(a), len(b))
    start = len(commonprefix((a, b)))
    end = len(commonprefix((a[::-1], b[::-1])))
    if len(b) < 200 and 100.0 * (2.0 * max(start, end) / n) >= bar:
        return True
    end = min(end, short - start)
    if 100.0 * (2.0 * short / n) < bar or 100.0 * (2.0 * (start + end + common_length(a[start : len(a) - end], b[start : len(b) - end])) / n) < bar:
        return False
    return ratio_of(a, b) >= bar


def counted_grams(texts: list[str], q: int) -> tuple[np.ndarray, np.ndarray]:
    """For each sequence of q (1 or 2) characters of each text: the text's place, and a number for the sequence and the how manieth it is in its text."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(s) for s in texts])
    if q == 2:
        codes, owner = ((codes[:-1] << 21) | codes[1:])[own := owner[:-1] == owner[1:]], owner[:-1][own]
    kinds, gram = np.unique(codes, return_inverse=True)
    key = np.sort(owner * len(kinds) + gram)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    nth = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
    return key // max(1, len(kinds)), np.unique(key % max(1, len(kinds)) + len(kinds) * nth, return_inverse=True)[1]


def shared_grams(lefts: list[str], rights: list[str], q: int, keep: int = 1024):
    """A function of a slice of lefts: at most how many sequences of q characters, repeats counted, each shares with each right text.

    It is a product of matrices of zeros and ones. Of sequences that both sides have, the keep most frequent are columns; of the others
    a pair is taken to share as many as the one of the two with fewer has.
    """
    n = len(lefts)
    owner, gram = counted_grams(lefts + rights, q)
    mine = owner < n
    size = int(gram.max(initial=-1)) + 1
    a, b = np.bincount(gram[mine], minlength=size), np.bincount(gram[~mine], minlength=size)
    both = np.flatnonzero((a > 0) & (b > 0))
    kept = both if len(both) <= keep else both[np.argpartition(-(a + b)[both], keep)[:keep]]
    column, rest = np.full(size, -1), np.zeros(size, bool)
    column[kept] = np.arange(len(kept))
    rest[both] = True
    rest[kept] = False
    has = np.zeros((n + len(rights), len(kept)), np.float32)
    own = column[gram] >= 0
    has[owner[own], column[gram[own]]] = 1
    more = np.bincount(owner[rest[gram]], minlength=len(has)).astype(np.float32)
    x, y, other = has[:n], has[n:].T, more[n:]
    return lambda at: x[at] @ y + (np.minimum(more[:n][at][:, None], other) if rest.any() else 0)


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, all of a in one word."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    left = full
    for c in b:
        m = masks.get(c, 0)
        left = ((left + (left & m)) | (left & ~m)) & full
    return len(a) - left.bit_count()


def expanded(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of places: which range, and the place."""
    of = np.repeat(np.arange(len(count)), count)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)


#: The distances that by_forms looks within, one after another, and the digits a text may have for that.
WITHIN, DIGITS = (4, 6), 9


class Forms:
    """Texts as forms (what is left without digits) and their digits; kind: a number for the pair of form and number of digits."""

    def __init__(self, texts: list[str]):
        digits = [re.sub("[^0-9]", "", s) for s in texts]
        forms, self.form = np.unique(np.array([re.sub("[0-9]", "", s) for s in texts], object), return_inverse=True)
        self.forms, self.n = forms.tolist(), np.array([len(s) for s in digits])
        kinds, self.kind = np.unique(self.form * (DIGITS + 1) + np.minimum(self.n, DIGITS), return_inverse=True)
        self.kind_form, self.kind_n = kinds // (DIGITS + 1), kinds % (DIGITS + 1)
        self.kind_length = np.array([len(s) for s in self.forms])[self.kind_form] + self.kind_n
        self.fits = bool(self.n.max(initial=0) <= DIGITS)
        self.digits = np.zeros((len(texts), DIGITS), np.int64)
        if self.fits:
            for i, s in enumerate(digits):
                self.digits[i, : len(s)] = np.frombuffer(s.encode(), np.uint8) - 47

    def kept(self, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Texts of n digits, and a code for each choice of k of them in their order; a code tells k."""
        own = np.flatnonzero(self.n == n)
        places = np.array(list(combinations(range(n), k)), np.int64).reshape(math.comb(n, k), k)
        return own, self.digits[own][:, places] @ (11 ** np.arange(k, dtype=np.int64))


def by_forms(lefts: list[str], rights: list[str], threshold: float, limit: int) -> list[tuple[list[tuple[float, int]], bool]]:
    """For each left text its best right ones as far as found here, and whether those are the best of all.

    For texts of few forms that differ in their numbers. A common subsequence is one of the forms and one of the digits, so the characters that
    two texts don't share are at least as many as those of their forms and those of their digits. Pairs with up to D of them in all are found without
    comparing others: what is left of a number by leaving out digits is looked up among what is left of those of the other side, with
    so many left out of both as D allows. When the last of the best is over what any other pair can have, no other is needed.
    """
    x, y = Forms(lefts), Forms(rights)
    none = [([], False)] * len(lefts)
    # texts without forms in common gain nothing: their forms alone are as many as they
    if not (x.fits and y.fits) or 8 * len(x.forms) > len(lefts) + 64 or 8 * len(y.forms) > len(rights) + 64 or len(x.kind_n) * len(y.kind_n) > 1 << 20:
        return none
    common = np.array([[common_length(a, b) for b in y.forms] for a in x.forms])
    size = lambda z: np.array([len(s) for s in z.forms])
    apart = (size(x)[:, None] + size(y) - 2 * common)[x.kind_form][:, y.kind_form]
    at_least = apart + np.abs(x.kind_n[:, None] - y.kind_n)
    both = x.kind_length[:, None] + y.kind_length
    key, place = [], []
    for q in np.unique(y.n).tolist():
        for k in range(max(0, q - WITHIN[-1]), q + 1):
            own, codes = y.kept(q, k)
            key.append(((y.kind[own][:, None] << 33) | codes).ravel())
            place.append(np.repeat(own, codes.shape[1]))
    key, place = np.concatenate(key), np.concatenate(place)
    order = np.argsort(key, kind="stable")
    place = place[order]
    key, first = np.unique(key[order], return_index=True)
    count = np.diff(np.append(first, len(place)))
    out, open_ = none, np.arange(len(lefts))
    for d in WITHIN:
        # the least distance over d that the kinds allow, of the same parity as their lengths
        beyond = np.maximum(at_least, d + 1 + (both + d + 1) % 2)
        most = np.where(both > 0, 100.0 * (2.0 * np.maximum((both - beyond) // 2, 0) / np.maximum(both, 1)), 0.0).max(axis=1, initial=0.0)
        pair, shared = [], []
        for p in np.unique(x.n[open_]).tolist():
            for k in range(p, max(-1, p - d - 1), -1):
                own, codes = x.kept(p, k)
                mine = np.isin(own, open_)
                own, codes = own[mine], codes[mine]
                near = (y.kind_n >= k) & (apart + p + y.kind_n - 2 * k <= d)
                starts, others = np.concatenate([[0], np.cumsum(near.sum(axis=1))]), np.nonzero(near)[1]
                row, at = expanded(starts[x.kind[own]], np.diff(starts)[x.kind[own]])
                wanted = (others[at].astype(np.int64)[:, None] << 33) | codes[row]
                left = np.broadcast_to(own[row][:, None], wanted.shape).ravel()
                wanted = wanted.ravel()
                spot = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
                hit = key[spot] == wanted
                of, right = expanded(first[spot[hit]], count[spot[hit]])
                pair.append(left[hit][of] * len(rights) + place[right])
                shared.append(np.full(len(of), k))
        pair, shared = np.concatenate(pair), np.concatenate(shared)
        pair, once = np.unique(pair, return_index=True)  # the first has the most digits in common
        i, j = pair // len(rights), pair % len(rights)
        a, b = x.kind[i], y.kind[j]
        k = (both[a, b] - (apart[a, b] + x.n[i] + y.n[j] - 2 * shared[once])) // 2
        bounds = np.where(both[a, b] > 0, 100.0 * (2.0 * k / np.maximum(both[a, b], 1)), 100.0)
        ends = np.searchsorted(i, open_, side="right")
        out, rest = list(out), []
        for n, start, end in zip(open_.tolist(), np.searchsorted(i, open_).tolist(), ends.tolist(), strict=True):
            best = best_of(lefts[n], rights, bounds[start:end], threshold, limit, places=j[start:end])
            may = most[x.kind[n]]
            done = may < threshold or (len(best) == limit and best[-1][0] > may)
            out[n] = (best, done)
            if not done:
                rest.append(n)
        open_ = np.array(rest, np.int64)
        if not len(open_):
            break
    return out


def best_ratios(lefts: list[str], rights: list[str], threshold: float, limit: int, step: int = 256, block: int = 4096):
    """For each left text the `limit` best of rights (score, place) with a ratio of threshold or more, of equals the first.

    Texts of few forms are looked up by their numbers first (by_forms). For those left, the ratio of texts of n and m characters is 2K / (n + m), with K
    at most the characters they share, and at most a third of n + m + 1 and the pairs of neighbouring characters they share (functions.grams).
    Right texts are taken, a block after another, by these bounds, best first, until none can be among the best.
    """
    found = by_forms(lefts, rights, threshold, limit)
    rest = [i for i, (_, done) in enumerate(found) if not done]
    own = [lefts[i] for i in rest]
    # what was found sets a floor; all right texts that reach it are taken again
    floor = [max(threshold, best[-1][0]) if len(best) == limit else threshold for best in (found[i][0] for i in rest)]
    bests: list[list[tuple[float, int]]] = [[] for _ in rest]
    for begin in range(0, len(rights), block) if rest else ():
        some = rights[begin : begin + block]
        single, double = shared_grams(own, some, 1), shared_grams(own, some, 2)
        n, m = (np.array([len(s) for s in side]) for side in (own, some))
        for at in range(0, len(own), step):
            rows = slice(at, at + step)
            both = n[rows][:, None] + m
            k = np.minimum(single(rows), np.floor((double(rows) + both + 1) / 3))
            bounds = np.where(both > 0, 100.0 * (2.0 * k / np.maximum(both, 1)), 100.0)
            for i, bound in enumerate(bounds, at):
                bests[i] = best_of(own[i], some, bound, floor[i], limit, bests[i], begin)
    again = iter(bests)
    for best, done in found:
        yield best if done else next(again)


def best_of(text: str, rights: list[str], bound: np.ndarray, threshold: float, limit: int, known=(), begin: int = 0, few: int = 64, places: np.ndarray | None = None) -> list[tuple[float, int]]:
    """The best of known (score, place from `begin` on; all before these) and of rights, or of those at `places`, whose bounds are given."""
    best, done = [(-s, k) for s, k in known], 0
    may = np.flatnonzero(bound >= (max(threshold, known[-1][0]) if len(best) == limit else threshold))
    # first those over the few-th bound, as mostly no other is needed
    least = np.partition(bound, -few)[-few] if len(may) > few else None
    for own in ([may[bound[may] > least]] if least is not None else []) + [may]:
        own = own[np.argsort(-bound[own], kind="stable")]
        for j in own[done:].tolist():
            place = j if places is None else int(places[j])
            if len(best) == limit and (-bound[j], place + begin) > best[-1]:
                return [(-s, k) for s, k in best]
            score = 100.0 if text == rights[place] else ratio_of(text, rights[place])
            if score >= threshold:
                insort(best, (-score, place + begin))
                del best[limit:]
        done = len(own)
    return [(-s, k) for s, k in best]


def partial_of(a: str, b: str) -> float:
    """Best ratio of the shorter string against each window of its length in the longer one."""
    short, long = sorted((a or "", b or ""), key=len)
    if not short:
        return 100.0 if not long else 0.0
    if short in long:
        return 100.0
    return max(ratio_of(short, long[i : i + len(short)]) for i in range(len(long) - len(short) + 1))


def common_of_windows(short: str, long: str) -> np.ndarray:
    """Length of the longest common subsequence of short with each window of its length in long, all windows at once, 63 bits a word."""
    n, w = len(short), len(long) - len(short) + 1
    words, full = -(-n // 63), np.uint64((1 << 63) - 1)
    masks: dict[str, list[int]] = {}
    for i, c in enumerate(short):
        masks.setdefault(c, [0] * words)[i // 63] |= 1 << i % 63
    none = [0] * words
    has = np.array([masks.get(c, none) for c in long], dtype=np.uint64).T.copy()
    left = np.full((words, w), full)
    for j in range(n):
        carry = np.uint64(0)
        for k in range(words):
            m, v = has[k, j : j + w], left[k]
            s = v + (v & m) + carry
            carry = s >> np.uint64(63)
            left[k] = (s & full) | (v & ~m)
    left[-1] |= full & ~np.uint64((1 << (n - 63 * (words - 1))) - 1)
    return 63 * words - np.bitwise_count(left).sum(axis=0).astype(np.int64)


def partial_over(a: str, b: str, bar: float) -> bool:
    """Whether partial_of is over bar. A window's ratio is at most its share of a common subsequence; the likeliest come first."""
    short, long = sorted((a or "", b or ""), key=len)
    if not short:
        return not long and bar < 100.0
    if short in long:
        return bar < 100.0
    n, common = len(short), common_of_windows(short, long)
    for i in np.argsort(-common, kind="stable"):
        if 100.0 * common[i] / n <= bar:
            return False
        if ratio_of(short, long[i : i + n]) > bar:
            return True
    return False


def token_set_of(a: str, b: str) -> float:
    x, y = set((a or "").lower().split()), set((b or "").lower().split())
    if not x and not y:
        return 100.0
    jaccard = 100.0 * len(x & y) / len(x | y)
    return (jaccard + ratio_of(" ".join(sorted(x)), " ".join(sorted(y)))) / 2


def token_set_over(a: str, b: str, bar: float) -> bool:
    """Whether token_set_of is over bar; the ratio is worked out only where lengths and letters let it be."""
    x, y = set((a or "").lower().split()), set((b or "").lower().split())
    if not x and not y:
        return 100.0 > bar
    jaccard, s, t = 100.0 * len(x & y) / len(x | y), " ".join(sorted(x)), " ".join(sorted(y))
    n = len(s) + len(t)
    if (jaccard + 100.0 * (2.0 * min(len(s), len(t)) / n)) / 2 <= bar or (jaccard + 100.0 * (2.0 * (Counter(s) & Counter(t)).total() / n)) / 2 <= bar:
        return False
    return (jaccard + ratio_of(s, t)) / 2 > bar


def _column(f, a, b) -> F.Column:
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([f(i, j) for i, j in zip(x, y, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")(a, b)


def ratio(a, b) -> F.Column:
    return _column(ratio_of, a, b)


def partial_ratio(a, b) -> F.Column:
    return _column(partial_of, a, b)


def token_set_ratio(a, b) -> F.Column:
    return _column(token_set_of, a, b)


def may_reach(a: F.Column, b: F.Column, threshold: float) -> F.Column:
    """Lossless filter before ratio: it can't be over 2 * min / (a + b) of the lengths."""
    x, y = F.length(a), F.length(b)
    return (x + y == 0) | (200.0 * F.least(x, y) / F.greatest(x + y, F.lit(1)) >= threshold)
