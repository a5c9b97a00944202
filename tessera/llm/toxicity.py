"""Toxicity by a weighted finite-state pattern grammar.

A text is read as clauses, and the words of a clause as classes (insult, target, negation, report, intent, harm,
quote, other). Five transducers are composed in this order; each reads the classes that the one before it writes,
may rewrite them, and multiplies a weight into the word:

* INSULT writes `phrase` for an insult that follows another one within two words;
* THREAT writes `threat` for a verb of harm that follows a word of intent within five words;
* TARGET keeps the weight of insults that have a target up to four words before or three after them; phrases without
  one keep 0.6 and lone insults LONE of it. A threat counts only if a target follows it within three words;
* NEGATION lowers what stands within three words after a negation, REPORT what is reported or quoted.

TARGET guesses whether a target follows, so a clause has several paths; its weight is that of the best path that ends
in a final state, the sum over its words. A text's features come from the weights of its clauses alone. The weights of
insults (words, and word beginnings) are log-odds learned from labelled rows over a short list of general ones; a
logistic layer over the features, fitted on other labelled rows than the lexicon, gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import cut, held_out, named_back, set_aside, slices
from tessera.llm.samples import MAX_ROWS, labelled_sample

TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[.!?;\n\"«»]")
END = frozenset(".!?;\n")
QUOTE = frozenset("\"«»")
INSULTS = dict.fromkeys("idiot idiots moron morons loser losers scum clown clowns stupid disgusting worthless pathetic trash imbecile fool fools jerk vermin filth filthy bastard idiota estúpido imbécil idioten dumm abschaum".split(), 3.0)
HARM = frozenset("kill hurt destroy beat punch stab shoot attack burn crush smash töten tuer matar".split())
INTENT = frozenset("will shall gonna going i'll we'll must should werde vais voy".split())
TARGETS = frozenset("you your you're u he she they him her them tu vous du ihr sie usted ustedes".split())
NEGATIONS = frozenset("not no never isn't aren't wasn't don't nor without nicht kein keine pas jamais nunca".split())
REPORTS = frozenset("said says wrote writes claimed called reported quoted sagte dit dijo".split())
CLASSES = {"target": TARGETS, "negation": NEGATIONS, "report": REPORTS, "intent": INTENT, "harm": HARM, "quote": QUOTE}
PREFIXES = (5, 6, 7)
THREAT_WEIGHT, LONE = 3.0, 0.1
N_FEATURES = 8


@dataclass(frozen=True)
class Machine:
    """arcs: (state, class or "" for any other) -> [(next state, class written or "" for the one read, weight)]."""

    start: str
    final: frozenset
    arcs: dict

    def step(self, state: str, read: str) -> list[tuple[str, str, float]]:
        return [(to, write or read, w) for to, write, w in self.arcs.get((state, read), self.arcs.get((state, ""), ()))]


def counted(name: str, first: int, last: str) -> dict:
    """States name<first> ... name1 that any word counts down, to `last` in the end."""
    return {(f"{name}{k}", ""): [(f"{name}{k - 1}" if k > 1 else last, "", 1.0)] for k in range(first, 0, -1)}


def insult_machine() -> Machine:
    after = [f"i{k}" for k in (2, 1)]
    arcs = {("-", ""): [("-", "", 1.0)], ("-", "insult"): [("i2", "", 1.0)], **counted("i", 2, "-")}
    return Machine("-", frozenset(["-", *after]), arcs | {(s, "insult"): [("i2", "phrase", 1.0)] for s in after})


def threat_machine() -> Machine:
    after = [f"h{k}" for k in range(5, 0, -1)]
    arcs = {("-", ""): [("-", "", 1.0)], **counted("h", 5, "-"), **{(s, "intent"): [("h5", "", 1.0)] for s in ("-", *after)}}
    return Machine("-", frozenset(["-", *after]), arcs | {(s, "harm"): [("-", "threat", 1.0)] for s in after})


def target_machine() -> Machine:
    seen, due = [f"t{k}" for k in range(4, 0, -1)], [f"d{k}" for k in range(3, 0, -1)]
    arcs = {("-", ""): [("-", "", 1.0)], **counted("t", 4, "-"), **{(s, ""): [(f"d{int(s[1]) - 1}", "", 1.0)] for s in due if s != "d1"}}
    for s in ("-", *seen):
        on = arcs[s, ""][0][0]
        for read, bare in (("insult", LONE), ("phrase", 0.6)):
            arcs[s, read] = [(on, "", 1.0)] if s in seen else [("-", "", bare), ("d3", "", 1.0)]
        arcs[s, "threat"] = [(on, "", 0.0), ("d3", "", 1.0)]
    arcs |= {(s, "target"): [("t4", "", 1.0)] for s in ("-", *seen, *due)}
    return Machine("-", frozenset(["-", *seen]), arcs | {("d1", ""): []})


def negation_machine() -> Machine:
    after = [f"n{k}" for k in (3, 2, 1)]
    arcs = {("-", ""): [("-", "", 1.0)], **counted("n", 3, "-"), **{(s, "negation"): [("n3", "", 1.0)] for s in ("-", *after)}}
    lowered = {(s, c): [(arcs[s, ""][0][0], "", 0.3)] for s in after for c in ("insult", "phrase", "threat")}
    return Machine("-", frozenset(["-", *after]), arcs | lowered)


def report_machine() -> Machine:
    states = ("-", "reported", "quoted")
    arcs = {(s, ""): [(s, "", 1.0)] for s in states} | {("-", "report"): [("reported", "", 1.0)]}
    arcs |= {(s, "quote"): [("-" if s == "quoted" else "quoted", "", 1.0)] for s in states}
    lowered = {(s, c): [(s, "", 0.4)] for s in states[1:] for c in ("insult", "phrase", "threat")}
    return Machine("-", frozenset(states), arcs | lowered)


MACHINES = (insult_machine(), threat_machine(), target_machine(), negation_machine(), report_machine())
SCORED = {"insult", "phrase", "threat"}


class Composition:
    """The composed transducer; its states are tuples of the machines' states, its arcs are made when first needed."""

    def __init__(self, machines: tuple[Machine, ...] = MACHINES):
        self.machines, self.arcs = machines, {}

    def step(self, state: tuple, read: str) -> list[tuple[tuple, str, float]]:
        found = self.arcs.get((state, read))
        if found is None:
            found = [((), read, 1.0)]
            for machine, own in zip(self.machines, state, strict=True):
                found = [((*to, n), write, w * v) for to, c, w in found for n, write, v in machine.step(own, c)]
            self.arcs[state, read] = found
        return found

    def start(self, quoted: bool = False) -> tuple:
        return (*(m.start for m in self.machines[:-1]), "quoted" if quoted else self.machines[-1].start)

    def clause(self, words: list[tuple[str, float]], quoted: bool = False) -> tuple[float, int, bool]:
        """(weight, threats, whether a quotation is open at the end) of the best path over (class, weight of the word)."""
        best = {self.start(quoted): (0.0, 0)}
        for read, value in words:
            after: dict = {}
            for state, (total, threats) in best.items():
                for to, write, factor in self.step(state, read):
                    gain = (THREAT_WEIGHT if write == "threat" else value) * factor if write in SCORED else 0.0
                    got = (total + gain, threats + (write == "threat" and factor > 0))
                    if to not in after or got > after[to]:
                        after[to] = got
            best = after
        ends = {s: got for s, got in best.items() if all(own in m.final for own, m in zip(s, self.machines, strict=True))}
        state, (total, threats) = max(ends.items(), key=lambda x: x[1])
        return total, threats, state[-1] == "quoted"


class Lexicon(dict):
    """word -> weight as an insult; words of no entry have that of their longest known beginning, or 0."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = INSULTS | weights

    def __missing__(self, word: str) -> float:
        got = self.weights.get(word, 0.0)
        if not got:
            got = max((self.weights.get(f"{word[:k]}*", 0.0) for k in PREFIXES if len(word) > k), default=0.0)
        if len(self) > 100_000:  # a memo, not data
            self.clear()
        self[word] = got
        return got

    def __reduce__(self):
        return Lexicon, (self.weights,)


@lru_cache(100_000)
def classed(word: str, weight: float) -> tuple[str, float]:
    return ("insult", weight) if weight else (next((c for c, words in CLASSES.items() if word in words), "other"), 0.0)


def clauses(text: str | None, lexicon: Lexicon, grammar: Composition) -> tuple[list[tuple[float, int]], int]:
    """((weight, threats) of each clause of the whole text that the grammar gives a weight, number of tokens)."""
    tokens = TOKEN.findall((text or "").lower())
    weights = [lexicon[t] for t in tokens]
    found: list[tuple[float, int]] = []
    if any(weights) or not HARM.isdisjoint(tokens):
        clause: list[tuple[str, float]] = []
        quoted, scored = False, False
        for t, w in zip([*tokens, "\n"], [*weights, 0.0], strict=True):
            if t not in END:
                clause.append(classed(t, w))
                scored = scored or w > 0 or t in HARM
                continue
            if scored:
                weight, threats, quoted = grammar.clause(clause, quoted)
                if weight > 0:
                    found.append((weight, threats))
            elif any(c == "quote" for c, _ in clause):
                quoted ^= sum(c == "quote" for c, _ in clause) % 2 == 1
            quoted, scored, clause = quoted and t != "\n", False, []
    return found, len(tokens)


def clause_features(text: str | None, lexicon: Lexicon, grammar: Composition) -> list[float]:
    """Sums, maxima and rates of the clause weights of the whole text; all 0 but the length for clean texts."""
    found, n = clauses(text, lexicon, grammar)
    weights = sorted((w for w, _ in found), reverse=True)
    total, n = sum(weights), max(1, n)
    return [math.log1p(10 * total), max(weights, default=0.0), math.log1p(len(found)), total / math.sqrt(n), 100.0 * total / (n + 50), float(sum(h for _, h in found)), sum(weights[:3]), math.log1p(n)]


@dataclass(frozen=True)
class Grammar:
    weights: dict
    mean: np.ndarray
    scale: np.ndarray
    layer: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(((x - self.mean) / self.scale) @ self.layer + self.bias, -40, 40)))


def learn_lexicon(sample: DataFrame, min_docs: int = 4) -> dict[str, float]:
    """All words and word beginnings that toxic rows of the bounded sample have much more often; smoothed log-odds of rates, 4 at most."""

    def run(batches):
        docs, uses = (Counter(), Counter()), (Counter(), Counter())
        for b in slices(batches):
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = Counter()
                words = [t for t in TOKEN.findall((text or "").lower()) if len(t) > 2]
                own.update(words)
                for k in PREFIXES:
                    own.update(f"{w[:k]}*" for w in words if len(w) > k)
                own[""] = len(words)
                docs[y].update(own.keys())
                uses[y].update(own)
                if len(docs[y]) > 100_000:  # partial counts, so that memory is bounded
                    yield shown(docs, uses, y)
        for y in (0, 1):
            yield shown(docs, uses, y)

    def shown(docs, uses, y):
        terms = list(docs[y])
        out = pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([y] * len(terms), pa.int32()), *(pa.array([c[y][t] for t in terms], pa.int64()) for c in (docs, uses))], names=["t", "y", "d", "n"])
        docs[y].clear()
        uses[y].clear()
        return out

    rows = sample.select("text", "label").mapInArrow(run, "t string, y int, d long, n long")
    rows = rows.groupBy("t").agg(*[F.sum(F.when(F.col("y") == y, F.col(c))).alias(f"{c}{y}") for y in (0, 1) for c in ("d", "n")]).na.fill(0)
    rows = cut(rows.where((F.col("t") == "") | ((F.col("d1") >= min_docs) & (F.col("d1") * 2 > F.col("d0")))), "terms")
    tops = rows.where(F.col("t") == "").first()
    n0, n1 = (tops["n0"], tops["n1"]) if tops else (0, 0)
    odds = F.log(((F.col("n1") + 0.1) / F.lit(n1 + 1.0)) / ((F.col("n0") + 0.1) / F.lit(n0 + 1.0)))
    return {r.t: min(4.0, r.w) for r in rows.where(F.col("t") != "").select("t", odds.alias("w")).where("w > 1.5").collect()}


def fit_layer(x: np.ndarray, y: np.ndarray, rounds: int = 600) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    if not len(x):
        return np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), -3.0
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z, w, b = (x - mean) / scale, np.zeros(x.shape[1]), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, rounds + 1):
        r = 1.0 / (1.0 + np.exp(-np.clip(z @ w + b, -40, 40))) - y
        g = np.append(z.T @ r / len(y) + 1e-3 * w, r.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return mean, scale, w, float(b)


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Grammar:
    """The lexicon from two thirds of the bounded sample, the logistic layer from the other third."""
    sample = cut(labelled_sample(docs, labels, "toxic", max_rows), "toxic")
    weights = learn_lexicon(sample.where("not half"))
    lexicon, machine = Lexicon(weights), Composition()

    def run(batches):
        for b in slices(batches):
            x = [clause_features(t, lexicon, machine) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], names=["x", "y"])

    rows = sample.where("half").select("text", "label").mapInArrow(run, "x array<double>, y int").toPandas()
    rows = rows.sort_values(["y", "x"], key=lambda c: c if c.name == "y" else c.map(tuple))
    return Grammar(weights, *fit_layer(np.array(rows["x"].tolist(), float).reshape(-1, N_FEATURES), rows["y"].to_numpy()))


def score_toxicity(docs: DataFrame, grammar: Grammar, at: float = 0.5) -> DataFrame:
    """docs' columns, then held_out, score and predicted (score >= at). One row a row; nulls score as empty texts.

    Columns of docs that have the name of an added one come back with _in after it.
    """
    given, docs = docs, set_aside(docs)
    place = docs.columns.index("text")
    wide = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    lexicon, machine = Lexicon(grammar.weights), Composition()

    def run(batches):
        for b in slices(batches):
            x = np.array([clause_features(t, lexicon, machine) for t in b.column(place).to_pylist()], float).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(grammar.score(x))], names=wide.names)

    out = docs.mapInArrow(run, wide).select(*docs.columns, held_out().alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"))
    return named_back(out, given)
