"""Quality by Bradley-Terry ranking.

Each document has a score w.x of plain text features. A pair of a good and a bad document says that the first
beats the second with probability sigmoid(w.(x_good - x_bad)); w is fitted by the logistic loss of such
feature differences. The decision is a quantile of the scores of the training sample: the one that decides
most of its rows rightly. Scores are shown as sigmoid(slope * (w.x - cut)) shifted so that the cut is `at`.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import held_out, named_back, set_aside, slices
from tessera.llm.samples import MAX_ROWS, labelled_sample

SYMBOLS = [b for b in b"*&$%#|~^<>{}[]\\=+_@!"]
N_FEATURES = 24
MARKED = re.compile(r"\w[.,]?[*&$%#!]{2,}(?=\s|$)")


def features(text: str | None) -> list[float]:
    """A fixed number of measures of the whole text; all 0 for null and empty texts."""
    text = text or ""
    raw = text.encode()
    n = max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = text.split(), text.split("\n")
    k = max(1, len(words))
    low = [w.lower() for w in words]
    types: dict[str, int] = {}
    for w in low:
        types[w] = types.get(w, 0) + 1
    same = sum(a == b for a, b in zip(low, low[1:], strict=False)) / k
    alternate = sum(a == b for a, b in zip(low, low[2:], strict=False)) / k
    symbols = float(counts[SYMBOLS].sum()) / n
    upper = float(counts[65:91].sum()) / n
    unique = len(types) / k
    line_unique = len(set(lines)) / len(lines)
    top = max(types.values(), default=0) / k
    marked = len(MARKED.findall(text)) / k if symbols else 0.0
    expected = 1.0 / (1.0 + 0.0012 * k)  # how the share of distinct words falls with length
    return [
        math.log1p(len(words)), 1.0 / k, symbols, min(symbols * 10, 1.0), upper, float(upper > 0.25), float(counts[48:58].sum()) / n, float(counts[124]) / k,
        min(10.0 * float(counts[124]) / k, 1.0), len(text) / k / 10, unique, unique / expected, line_unique, 1.0 - line_unique ** 4, same, min(4 * same, 1.0), alternate,
        top, float(top > 0.3), marked, float(counts[10]) / k, float(counts[46] + counts[44]) / k, float(counts[33]) / k, float((counts[128:]).sum()) / n,
    ]


@dataclass(frozen=True)
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float
    at: float

    def score(self, x: np.ndarray) -> np.ndarray:
        s = ((x - self.mean) / self.scale) @ self.weights
        shift = math.log(self.at / (1 - self.at))
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * (s - self.cut) + shift, -40, 40)))


def best_cut(s: np.ndarray, y: np.ndarray) -> float:
    """The score from which on rows are called good, right most often over all quantiles of the sample; of equal ones the lowest, halfway to the next score below."""
    order = np.argsort(s, kind="stable")
    s, good = s[order], y[order] == 1
    right = np.r_[0, np.cumsum(~good)] + good.sum() - np.r_[0, np.cumsum(good)]  # right if the k lowest are called bad
    right[1:-1][s[1:] == s[:-1]] = -1  # equal scores are called alike
    k = int(np.argmax(right))
    return float(s[0] if k == 0 else s[-1] + 1.0 if k == len(s) else (s[k - 1] + s[k]) / 2)


def fit_ranker(x: np.ndarray, y: np.ndarray, at: float = 0.3, pairs: int = 40000, rounds: int = 400, seed: int = 7) -> Ranker:
    """Preference pairs are drawn with a fixed seed from the sample's good and bad rows. With one label only, all score alike."""
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    z, good, bad = (x - mean) / scale if len(x) else x, np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w = np.zeros(len(mean))
    if not len(good) or not len(bad):
        return Ranker(mean, scale, w, 0.0 if len(good) or not len(bad) else 1.0, 1.0, at)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):  # Adam
        g = -(d / (1.0 + np.exp(np.clip(d @ w, -40, 40)))[:, None]).mean(axis=0) + 1e-3 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    s = z @ w
    return Ranker(mean, scale, w, best_cut(s, y), 1.0 / (float(s.std()) * 0.3 + 1e-6), at)


def fit_quality(docs: DataFrame, labels: DataFrame, at: float = 0.3, max_rows: int = MAX_ROWS) -> Ranker:
    def run(batches):
        for b in slices(batches):
            x = [features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], names=["x", "y"])

    rows = labelled_sample(docs, labels, "quality", max_rows).select("text", "label").mapInArrow(run, "x array<double>, y int").toPandas()
    rows = rows.sort_values(["y", "x"], key=lambda c: c if c.name == "y" else c.map(tuple))
    return fit_ranker(np.array(rows["x"].tolist(), float).reshape(-1, N_FEATURES), rows["y"].to_numpy(), at)


def score_quality(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """docs' columns, then held_out, score and predicted (score >= the ranker's cut). One row a row; nulls score as empty.

    Columns of docs that have the name of an added one come back with _in after it.
    """
    given, docs = docs, set_aside(docs)
    at = docs.columns.index("text")
    wide = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches):
        for b in slices(batches):
            x = np.array([features(t) for t in b.column(at).to_pylist()], float).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ranker.score(x))], names=wide.names)

    out = docs.mapInArrow(run, wide).select(*docs.columns, held_out().alias("held_out"), "score", (F.col("score") >= ranker.at).cast("int").alias("predicted"))
    return named_back(out, given)
