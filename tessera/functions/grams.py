"""Which texts can be alike: a prefix filter under the Ratcliff-Obershelp ratio.

The ratio of texts of n and m characters is 2K / (n + m) for K characters that match, and those are a common subsequence. So
texts whose ratio is `bar` per cent share at least (2q - 1)K - (q - 1)(n + m) - q + 1 sequences of q characters, repeats counted:
each character left out breaks q of them, each put in q - 1. Of two sets that share that many members, the first ones in any
order common to both meet already, if each gives all but so many less one. Texts too short for pairs of characters to say
anything meet by single characters, which every ratio over zero bounds.
"""

from __future__ import annotations

import math


def slope(bar: float, q: int) -> float:
    """Shared sequences of q characters for each character of a text, with the worst partner."""
    t = bar / 100.0
    k = (2 * q - 1) * t / 2 - (q - 1)
    return k * 2 / (2 - t) if k > 0 else k * 2 / t


def short_below(bar: float, q: int) -> float:
    """The length under which a text may share no sequence of q characters with one that it is like."""
    c = slope(bar, q)
    return q / c if c > 0 else math.inf


def first_tokens(text: str, q: int, bar: float, often: dict[str, int]) -> list[str]:
    """The rarest tokens of a text, one more than it may fail to share. A token is q, the how manieth, and the sequence, for each sequence of
    q characters. often: how often a sequence occurs, roughly; it only orders."""
    shared = math.ceil(slope(bar, q) * len(text) - q + 1 - 1e-9)
    seen: dict[str, int] = {}
    own = []
    for i in range(len(text) - q + 1):
        g = text[i : i + q]
        k = seen[g] = seen.get(g, 0) + 1
        own.append((often.get(g, 0) / k, f"{q}:{k}:{g}"))
    own.sort()
    return [t for _, t in own[: max(0, len(own) - max(1, shared) + 1)]]


def meeting_tokens(text: str, bar: float, often: dict[str, int], q: int = 2) -> list[str]:
    """Tokens of which any two texts with a ratio of bar or more have one in common, unless both are empty."""
    short = short_below(bar, q)
    out = first_tokens(text, q, bar, often) if len(text) >= short else []
    if len(text) * bar / (200 - bar) < short:
        out += first_tokens(text, 1, bar, often)
    return out
