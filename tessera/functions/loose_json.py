"""A tolerant reader of JSON: an automaton with a stack of open objects and lists, one pass over the text.

It takes what models write instead of JSON: a fence or words around it, single or curly quotes, bare keys and words, quotes
within strings, missing and trailing commas, missing colons, comments, literals of Python, and a text cut off anywhere. Closers that fit
nothing open are passed over; those that fit an outer object or list close the inner ones.
"""

from __future__ import annotations

import json
import re

QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’"}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "/": "/", "\\": "\\"}
WORDS = {"true": True, "false": False, "null": None, "none": None, "nan": None, "undefined": None}
LITERAL = re.compile(r"(?:-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|True|False|None|NaN|undefined)(?=[\s,}\]]|$)")
BARE = re.compile(r"[^,}\]\n]*")
KEY = re.compile(r"[^:=,{}\[\]\s\"']+")
BLANK = re.compile(r"(?:[\s﻿]+|//[^\n]*|/\*(?:[^*]|\*(?!/))*+(?:\*/|$)|#[^\n]*)*+")
MISSING = object()


class Reader:
    def __init__(self, text: str):
        self.s, self.i = text, 0
        self.root, self.stack, self.keys = MISSING, [], []
        self.open = {"{": 0, "[": 0}

    def blank(self) -> None:
        self.i = BLANK.match(self.s, self.i).end()

    def attach(self, value) -> None:
        if not self.stack:
            self.root = value
        elif isinstance(self.stack[-1], list):
            self.stack[-1].append(value)
        elif self.keys[-1] is not MISSING:
            self.stack[-1][self.keys[-1]] = value
            self.keys[-1] = MISSING

    def begin(self, c: str) -> None:
        new = {} if c == "{" else []
        self.attach(new)
        self.stack.append(new)
        self.keys.append(MISSING)
        self.open[c] += 1

    def end(self, c: str) -> None:
        """Close the innermost of c's kind and all within it; nothing if there is none."""
        kind, of = ("{", dict) if c == "}" else ("[", list)
        while self.open[kind]:
            if self.keys[-1] is not MISSING:
                self.attach(None)
            self.keys.pop()
            top = self.stack.pop()
            self.open["{" if isinstance(top, dict) else "["] -= 1
            if isinstance(top, of):
                return

    def quoted(self, key: bool) -> str:
        """A string from its quote on. A quote ends it where a string may end: before a delimiter, another string, a line's end or nothing."""
        s, close, out, n = self.s, QUOTES[self.s[self.i]], [], len(self.s)
        at = i = self.i + 1
        while i < n:
            c = s[i]
            if c == "\\":
                out.append(s[at:i])
                nxt = s[i + 1 : i + 2]
                if nxt == "u" and re.fullmatch("[0-9a-fA-F]{4}", s[i + 2 : i + 6]):
                    out.append(chr(int(s[i + 2 : i + 6], 16)))
                    i += 6
                else:
                    out.append(ESCAPES.get(nxt, nxt))
                    i += 2
                at = i
                continue
            if c == close:
                after = BLANK.match(s, i + 1).end()
                if key or after >= n or s[after] in ",}]:" or s[after] in QUOTES or "\n" in s[i + 1 : after]:
                    break
            i += 1
        out.append(s[at:i])
        self.i = min(i + 1, n)
        text = "".join(out)
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if any("\ud800" <= c <= "\udfff" for c in text) else text

    def value(self) -> None:
        """A string, literal or bare word; a bare word that the text ends in isn't one."""
        if self.s[self.i] in QUOTES:
            self.attach(self.quoted(False))
            return
        if m := LITERAL.match(self.s, self.i):
            self.i = m.end()
            word = m[0].lower()
            self.attach(WORDS[word] if word in WORDS else json.loads(re.sub(r"^(-?)0+(?=\d)", r"\1", m[0])))
            return
        m = BARE.match(self.s, self.i)
        self.i = m.end()
        if self.i < len(self.s) and m[0].strip():
            self.attach(re.split(r"\s(?://|#)", m[0])[0].strip())

    def key(self) -> None:
        s = self.s
        if s[self.i] in QUOTES:
            self.keys[-1] = self.quoted(True)
        elif m := KEY.match(s, self.i):
            self.i, self.keys[-1] = m.end(), m[0]
        else:
            self.i += 1
            return
        self.blank()
        if s[self.i : self.i + 2] == "=>":
            self.i += 2
        elif s[self.i : self.i + 1] in (":", "="):
            self.i += 1

    def read(self):
        """The first object or list of the text, or MISSING."""
        s, n = self.s, len(self.s)
        start = re.search(r"[{\[]", s)
        if not start or re.search("[\"'“‘]", s[: start.start()]):
            return MISSING
        self.i = start.start()
        while self.i < n:
            self.blank()
            if self.i >= n:
                break
            c = s[self.i]
            if c in "{[" and (not self.stack or isinstance(self.stack[-1], list) or self.keys[-1] is not MISSING):
                self.i += 1
                self.begin(c)
            elif c in "}]":
                self.i += 1
                self.end(c)
                if not self.stack:
                    return self.root
            elif c == ",":
                self.i += 1
                if self.keys[-1] is not MISSING:
                    self.attach(None)
            elif isinstance(self.stack[-1], dict) and self.keys[-1] is MISSING:
                self.key()
            else:
                self.value()
        while self.stack:
            self.end("}" if isinstance(self.stack[-1], dict) else "]")
        return self.root if self.root else MISSING


def loads(text: str):
    """The value of a text as JSON, strictly if it is, else as far as it can be read; ValueError if it holds no object or list."""
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        pass
    value = Reader(text).read()
    if value is MISSING:
        raise ValueError("no object or list")
    return value


def mend(text: str) -> str | None:
    """text as canonical JSON, or None where it holds no object or list or is nested beyond what can be written."""
    try:
        return json.dumps(loads(text), ensure_ascii=False)
    except (ValueError, RecursionError):
        return None
