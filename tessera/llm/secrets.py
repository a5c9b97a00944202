"""Secret scans by assignment-aware lexing.

Three base patterns (assignments to secret names, access key ids, long hex runs) are found exactly. Beside
them a lexer parses source and configuration syntax (name = "x", name: 'x', name => x, name := x) into
name-literal pairs, follows names that are given the value of another name (a = "x"; password = a), and
scores each literal by the most sensitive name it reaches, its length, its mix of characters, and whether
it is a placeholder. Literals that score enough and lie in no base span become spans of kind `literal`.

A second lexer takes texts that name something sensitive apart into strings, names, operators, brackets and elements, and a parser over
those tokens makes pairs of what lines alone don't show: strings joined by + or side by side, literals as the argument of a call,
values under a general key within a sensitive one ({"password": {"value": "x"}}), <name>x</name>, quoted passphrases of several words,
and constants given to a sensitive name before their own assignment. What it adds lies in no other span and is of kind `value`.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.common import named_back, set_aside, slices

KINDS = ("assign", "access", "hex", "literal", "value")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a run, once begun by AKIA, is taken whole: as long as 20 or dropped
HEX = re.compile(r"[0-9a-f]{24,}")
HEXED = bytes(104 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
# A name is tried once a run of its characters, and nothing is given back: linear in runs of any length.
PAIR = re.compile(r"""(?<![A-Za-z0-9_.-])[0-9.-]*+([A-Za-z_][A-Za-z0-9_.-]*+)["']?+[ \t]*+(?::=|=>|[:=])[ \t]*+(?:"([^"\n]*+)"|'([^'\n]*+)'|([^\s"',;|(){}\[\]]++))""")
TOKEN = re.compile(
    r"""(?P<string>"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+')|(?P<name>[A-Za-z_][A-Za-z0-9_.-]*+)|(?P<op>:=|=>|==|!=|<=|>=|[=:+])|(?P<open>[{\[(])|(?P<close>[}\])])|(?P<end>[,;\n])|(?P<other>[^\s])"""
)
BARE = re.compile(r"""[^\s"',;|(){}\[\]]++""")
ELEMENT = re.compile(r"<([A-Za-z][A-Za-z0-9_.-]*+)>([^<>\n]*+)</([A-Za-z0-9_.-]++)>")
ASSIGNS = ("=", ":", ":=", "=>")
#: Keys that say nothing by themselves: what is under them is named by the key around them.
GENERAL = {"value", "val", "default", "data", "text", "content", "current", "raw", "string", "literal"}
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "api_key": 1.0, "private": 0.8, "credential": 0.9, "auth": 0.6, "access_key": 1.0, "passphrase": 1.0, "key": 0.4, "salt": 0.5}
SIGNS = re.compile("|".join(sorted(SENSITIVE)).encode())
PLACEHOLDERS = re.compile(r"(?i)^(?:x+|\*+|none|null|true|false|changeme|example|placeholder|your[-_].*|<.*>|\$\{.*\}|todo)$")
THRESHOLD = 0.6


def sensitivity(name: str) -> float:
    low = name.lower()
    return max((w for k, w in SENSITIVE.items() if k in low), default=0.0)


def literal_strength(text: str) -> float:
    """0 to 1 by length and entropy; placeholders, addresses and short literals have 0."""
    if len(text) < 6 or PLACEHOLDERS.match(text) or "://" in text or " " in text:
        return 0.0
    counts = Counter(text)
    bits = -sum(c / len(text) * math.log2(c / len(text)) for c in counts.values())
    return min(1.0, bits * len(text) / 48)


def lex(text: str) -> list[tuple[str, str, int, int, bool]]:
    """(name, value, start, end, quoted) of each assignment."""
    out = []
    for m in PAIR.finditer(text):
        g = next(i for i in (2, 3, 4) if m.group(i) is not None)
        out.append((m.group(1), m.group(g), m.start(g), m.end(g), g != 4))
    return out


def literals(text: str) -> list[tuple[int, int]]:
    """Spans of literals that reach a sensitive name, directly or through names given each other's values."""
    reached: dict[tuple[str, int, int], float] = {}
    held: dict[str, tuple[str, int, int]] = {}
    for name, value, start, end, quoted in lex(text):
        source = (value, start, end) if quoted or value not in held else held[value]
        held[name] = source
        reached[source] = max(reached.get(source, 0.0), sensitivity(name))
    return [(start, end) for (value, start, end), w in reached.items() if w >= THRESHOLD and w * literal_strength(value) >= THRESHOLD]


def phrase_strength(text: str) -> float:
    """1 for a quoted phrase of four to a dozen words without marks of a sentence, else 0."""
    return float(3 <= text.count(" ") <= 11 and len(text) <= 80 and text == text.strip() and not re.search(r"[.!?,:;<>{}]", text))


def joined_strings(tokens: list[tuple], i: int) -> tuple[str, list[tuple[int, int]], int]:
    """Value, spans of the contents, and the place after the strings from token i on that are added up or stand side by side."""
    out, spans = [], []
    while True:
        _, s, start, end = tokens[i]
        out.append(s[1:-1])
        spans.append((start + 1, end - 1))
        i += 1
        if i < len(tokens) and tokens[i][1] == "+":
            k = i + 1
            while k < len(tokens) and tokens[k][1] == "\n":
                k += 1
            if k < len(tokens) and tokens[k][0] == "string":
                i = k
                continue
        if i < len(tokens) and tokens[i][0] == "string":
            continue
        return "".join(out), spans, i


def pairs(text: str) -> list[tuple[str, str, str, list[tuple[int, int]], bool]]:
    """(name, key around it, value, spans, quoted) of each assignment, in their order."""
    tokens = [(m.lastgroup, m[0], m.start(), m.end()) for m in TOKEN.finditer(text)]
    out, around, pending, i, n = [], [""], "", 0, len(tokens)
    while i < n:
        kind, s, _, _ = tokens[i]
        if kind == "open":
            around.append(pending or (around[-1] if s != "{" else ""))
            pending = ""
        elif kind == "close":
            if len(around) > 1:
                around.pop()
            pending = ""
        elif kind in ("name", "string") and i + 2 < n and tokens[i + 1][1] in ASSIGNS:
            name, j = s.strip("\"'"), i + 2
            following = tokens[j][0]
            call = following == "name" and j + 2 < n and tokens[j + 1][1] == "(" and tokens[j + 1][2] == tokens[j][3] and tokens[j + 2][0] == "string"
            if following == "string" or call:
                value, spans, after = joined_strings(tokens, j + 2 if call else j)
                # a string before a colon is the next key, not a value
                if after < n and tokens[after][1] in ASSIGNS and not call:
                    i += 1
                    continue
                out.append((name, around[-1], value, spans, True))
                i = after
                continue
            if following == "open":
                pending = name
                i = j
                continue
            if following != "end" and following != "close" and (m := BARE.match(text, tokens[j][2])):
                out.append((name, around[-1], m[0], [m.span()], False))
                while i < n and tokens[i][2] < m.end():
                    i += 1
                continue
        elif kind == "end" and s != "\n":
            pending = ""
        i += 1
    out += [(m[1], "", m[2], [m.span(2)], True) for m in ELEMENT.finditer(text) if m[1] == m[3]]
    return out


def parsed_values(text: str) -> list[tuple[int, int]]:
    """Spans of literals that reach a sensitive name, directly or through names given each other's values, before or after."""
    found = pairs(text)
    given = {name for name, *_ in found}
    own: dict[str, float] = {}
    takes: dict[str, list[str]] = {}
    for name, key, value, _, quoted in found:
        around = sensitivity(key) if key and name.lower() in GENERAL else 0.0
        own[name] = max(own.get(name, 0.0), sensitivity(name), around)
        if not quoted and value in given and value != name:
            takes.setdefault(name, []).append(value)
    reached: dict[str, float] = {}
    for first, w in sorted(own.items(), key=lambda x: -x[1]):
        todo = [first] if w > 0 else []
        while todo:
            name = todo.pop()
            if name not in reached:
                reached[name] = w
                todo += takes.get(name, ())
    out = []
    for name, key, value, spans, quoted in found:
        around = sensitivity(key) if key and name.lower() in GENERAL else 0.0
        w = around if name.lower() in GENERAL else reached.get(name, 0.0)
        if (quoted or value not in given) and w >= THRESHOLD and w * (phrase_strength(value) if quoted and " " in value else literal_strength(value)) >= THRESHOLD:
            out += spans
    return sorted(set(out))


def outside(spans: list[tuple[int, int]], base: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans that lie in none of base."""
    base = sorted(base)
    starts, far = [s for s, _ in base], list(accumulate((e for _, e in base), max))
    return [(s, e) for s, e in spans if not (at := bisect_right(starts, s)) or far[at - 1] < e]


def apart(spans: list[tuple[int, int]], known: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans that share no place with any of known or with one kept before."""
    known, out, reach = sorted(known), [], 0
    starts, far = [s for s, _ in known], list(accumulate((e for _, e in known), max))
    for s, e in spans:
        at = bisect_right(starts, e - 1)
        if s >= reach and not (at and far[at - 1] > s):
            out.append((s, e))
            reach = e
    return out


def find_secrets(text: str | None) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the secret value) by start, then kind; places are code points."""
    if not text:
        return []
    out, raw = [], text.encode()
    low = raw.lower()
    if any(n in low for n in NAMES):
        out += [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in raw:
        out += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text)]
    if b"h" * 24 in raw.translate(HEXED):
        out += [("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    if b"=" in raw or b":" in raw:
        out += [("literal", s, e, s) for s, e in outside(literals(text), [(s, e) for _, s, e, _ in out])]
    if SIGNS.search(low) and (b"=" in raw or b":" in raw or b"</" in raw):
        out += [("value", s, e, s) for s, e in apart(parsed_values(text), [(s, e) for _, s, e, _ in out])]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def redact(text: str, spans: list[tuple[str, int, int, int]], mark: str = "[SECRET]") -> str:
    out, at = [], 0
    for _, _, end, value in sorted(spans, key=lambda x: (x[3], x[2])):
        if end <= at:
            continue
        if value >= at:
            out += [text[at:value], mark]
        at = end
    return "".join([*out, text[at:]])


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, *_ in spans)


def scan_secrets(docs: DataFrame, text_out: bool = False) -> DataFrame:
    """docs' columns, then n_assign, n_access, n_hex, n_literal, n_value, base_spans, spans (kind:start:end, comma-joined).

    With text_out, `text` is given with every secret value replaced by a mark. Null texts have no spans and
    stay null. Rows are kept one for one, in any number and repeated; other columns pass through, those that
    have the name of an added one with _in after it.
    """
    given, docs = docs, set_aside(docs)
    at = docs.columns.index("text")
    added = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField("base_spans", T.StringType()), T.StructField("spans", T.StringType())]
    wide = T.StructType([*docs.schema.fields, *added])

    def run(batches):
        for b in slices(batches):
            texts = b.column(at).to_pylist()
            found = [find_secrets(t) for t in texts]
            own = list(b.columns)
            if text_out:
                own[at] = pa.array([redact(t, f) if f else t for t, f in zip(texts, found, strict=True)], pa.string())
            counts = [pa.array([sum(s[0] == k for s in f) for f in found], pa.int64()) for k in KINDS]
            base = pa.array([joined(s for s in f if s[0] not in ("literal", "value")) for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([*own, *counts, base, pa.array([joined(f) for f in found], pa.string())], names=wide.names)

    return named_back(docs.mapInArrow(run, wide), given)
