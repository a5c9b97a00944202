"""Prompt templates compiled once into columns: values, loops, conditions; no Python runs for the rows.

A template has {{ value }}, {% for x in list %} ... {% endfor %}, {% if a %} ... {% elif b %} ... {% else %} ... {% endif %} and {# comments #}.
Values are names of columns or of loops with .field and [index], literals, comparisons, in, not, and, or, `is none`, and filters
(length, default, upper, lower, trim, join, escape); loop.index, loop.first and loop.last are those of the innermost loop.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAG = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
TOKEN = re.compile(r"\s*(\"[^\"]*\"|'[^']*'|\d+(?:\.\d+)?|[A-Za-z_]\w*|==|!=|<=|>=|[<>|().,\[\]])")


@dataclass
class Value:
    """A column with its type."""

    column: Column
    kind: T.DataType

    def true(self) -> Column:
        """As a condition: null, empty, zero and false are not."""
        c, k = self.column, self.kind
        if isinstance(k, T.BooleanType):
            held = c
        elif isinstance(k, (T.ArrayType, T.MapType)):
            held = F.size(c) > 0
        elif isinstance(k, T.NumericType):
            held = c != 0
        else:
            held = F.length(c) > 0 if isinstance(k, T.StringType) else c.isNotNull()
        return F.coalesce(held, F.lit(False))

    def shown(self, escape: bool) -> Column:
        """As text; null is empty, lists and structs are JSON."""
        if isinstance(self.kind, (T.ArrayType, T.MapType, T.StructType)):
            c = F.to_json(self.column)
        else:
            c = F.initcap(self.column.cast("string")) if isinstance(self.kind, T.BooleanType) else self.column.cast("string")
        if escape:
            for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
                c = F.replace(c, F.lit(a), F.lit(b))
        return F.coalesce(c, F.lit(""))


class Expression:
    """One expression, read from left to right."""

    def __init__(self, text: str, names: dict[str, Value]):
        self.text, self.names, self.at, self.tokens = text, names, 0, []
        i = 0
        while text[i:].strip():
            m = TOKEN.match(text, i)
            if not m:
                raise ValueError(f"can't read {text[i:]!r} in {text!r}")
            self.tokens.append(m[1])
            i = m.end()

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self, *wanted: str) -> str | None:
        if self.peek() in wanted:
            self.at += 1
            return self.tokens[self.at - 1]
        return None

    def need(self, wanted: str | None = None) -> str:
        t = self.peek()
        if t is None or wanted is not None and t != wanted:
            raise ValueError(f"expected {wanted or 'more'} in {self.text!r}")
        self.at += 1
        return t

    def whole(self) -> Value:
        out = self.either()
        if self.peek() is not None:
            raise ValueError(f"can't read {self.peek()!r} in {self.text!r}")
        return out

    def either(self) -> Value:
        left = self.both()
        while self.take("or"):
            left = Value(left.true() | self.both().true(), T.BooleanType())
        return left

    def both(self) -> Value:
        left = self.negated()
        while self.take("and"):
            left = Value(left.true() & self.negated().true(), T.BooleanType())
        return left

    def negated(self) -> Value:
        if self.take("not"):
            return Value(~self.negated().true(), T.BooleanType())
        left = self.filtered()
        if self.take("is"):
            no = bool(self.take("not"))
            self.need("none")
            return Value(left.column.isNotNull() if no else left.column.isNull(), T.BooleanType())
        if self.take("in"):
            right = self.filtered()
            held = F.array_contains(right.column, left.column) if isinstance(right.kind, T.ArrayType) else F.contains(right.column, left.column)
            return Value(F.coalesce(held, F.lit(False)), T.BooleanType())
        if sign := self.take("==", "!=", "<", "<=", ">", ">="):
            a, b = left.column, self.filtered().column
            held = {"==": a.eqNullSafe(b), "!=": ~a.eqNullSafe(b), "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[sign]
            return Value(F.coalesce(held, F.lit(False)), T.BooleanType())
        return left

    def filtered(self) -> Value:
        out = self.primary()
        while self.take("|"):
            name, args = self.need(), []
            if self.take("("):
                while not self.take(")"):
                    args.append(self.either())
                    self.take(",")
            out = self.apply(name, out, args)
        return out

    def apply(self, name: str, v: Value, args: list[Value]) -> Value:
        text = T.StringType()
        if name == "length":
            return Value(F.coalesce(F.size(v.column) if isinstance(v.kind, (T.ArrayType, T.MapType)) else F.length(v.column), F.lit(0)), T.IntegerType())
        if name == "default":
            return Value(F.coalesce(v.column.cast(args[0].kind) if type(v.kind) is not type(args[0].kind) else v.column, args[0].column), args[0].kind)
        if name == "join":
            between = args[0].column if args else F.lit("")
            return Value(F.aggregate(F.transform(v.column, lambda x: F.coalesce(x.cast("string"), F.lit(""))), F.lit(None).cast("string"), lambda a, x: F.when(a.isNull(), x).otherwise(F.concat(a, between, x))), text)
        if name == "escape":
            return Value(v.shown(True), text)
        if name in ("upper", "lower", "trim"):
            return Value({"upper": F.upper, "lower": F.lower, "trim": F.trim}[name](v.shown(False)), text)
        raise ValueError(f"unknown filter {name}")

    def primary(self) -> Value:
        t = self.need()
        if t == "(":
            out = self.either()
            self.need(")")
        elif t[0] in "\"'":
            out = Value(F.lit(t[1:-1]), T.StringType())
        elif t[0].isdigit():
            out = Value(F.lit(float(t)), T.DoubleType()) if "." in t else Value(F.lit(int(t)), T.IntegerType())
        elif t in ("true", "false"):
            out = Value(F.lit(t == "true"), T.BooleanType())
        elif t in self.names:
            out = self.names[t]
        else:
            raise ValueError(f"unknown name {t} in {self.text!r}")
        while step := self.take(".", "["):
            if step == "[":
                if not isinstance(out.kind, T.ArrayType):
                    raise ValueError(f"no list before [ in {self.text!r}")
                out = Value(F.get(out.column, self.either().column), out.kind.elementType)
                self.need("]")
                continue
            field = self.need()
            if not isinstance(out.kind, T.StructType) or field not in out.kind.names:
                raise ValueError(f"no field {field} in {self.text!r}")
            out = Value(out.column[field], out.kind[field].dataType)
        return out


def blocks(template: str) -> list[str]:
    """Texts and tags in turn; blanks before a block tag that stands first on its line go, and so does the line end after one."""
    parts = TAG.split(template)
    tags = [i for i in range(1, len(parts), 2) if parts[i][:2] != "{{"]
    for i in tags:
        if "\n" in parts[i - 1] or i == 1:
            parts[i - 1] = re.sub(r"(^|\n)[ \t]*$", r"\1", parts[i - 1])
    for i in tags:
        parts[i + 1] = parts[i + 1].removeprefix("\n")
    return parts


class Compiler:
    def __init__(self, template: str, escape: bool):
        self.parts, self.at, self.escape = blocks(template), 0, escape

    def body(self, names: dict[str, Value], *ends: str) -> tuple[Column, str]:
        """What stands up to one of the tags `ends`, and that tag."""
        out = []
        while self.at < len(self.parts):
            part = self.parts[self.at]
            self.at += 1
            if self.at % 2:
                out += [F.lit(part)] if part else []
            elif part[:2] == "{{":
                out.append(Expression(part[2:-2], names).whole().shown(self.escape))
            elif part[:2] == "{%":
                tag = part[2:-2].strip(" \t\n-")
                word = tag.split(None, 1)[0] if tag else ""
                if word in ends:
                    return F.concat(*out) if out else F.lit(""), tag
                out.append(self.loop(tag, names) if word == "for" else self.choice(tag, names) if word == "if" else self.unknown(tag))
        if ends:
            raise ValueError(f"no {' or '.join(ends)}")
        return F.concat(*out) if out else F.lit(""), ""

    def unknown(self, tag: str):
        raise ValueError(f"unknown tag {tag!r}")

    def loop(self, tag: str, names: dict[str, Value]) -> Column:
        m = re.fullmatch(r"for\s+(\w+)\s+in\s+(.+)", tag, re.S)
        if not m:
            raise ValueError(f"can't read {tag!r}")
        over = Expression(m[2], names).whole()
        if not isinstance(over.kind, T.ArrayType):
            raise ValueError(f"no list in {tag!r}")
        begin, end = self.at, None

        def each(x: Column, i: Column) -> Column:
            nonlocal end
            self.at = begin
            flags = T.StructType([T.StructField("index", T.IntegerType()), T.StructField("first", T.BooleanType()), T.StructField("last", T.BooleanType())])
            loop = Value(F.struct((i + 1).alias("index"), (i == 0).alias("first"), (i + 1 == F.size(over.column)).alias("last")), flags)
            out, _ = self.body(names | {m[1]: Value(x, over.kind.elementType), "loop": loop}, "endfor")
            end = self.at
            return out

        made = F.array_join(F.transform(over.column, each), "")
        self.at = end
        return F.coalesce(made, F.lit(""))

    def choice(self, tag: str, names: dict[str, Value]) -> Column:
        out, left = None, tag
        while left.startswith(("if", "elif")):
            held = Expression(left.split(None, 1)[1], names).whole().true()
            body, left = self.body(names, "elif", "else", "endif")
            out = F.when(held, body) if out is None else out.when(held, body)
        if left.startswith("else"):
            body, _ = self.body(names, "endif")
            return out.otherwise(body)
        return out.otherwise(F.lit(""))


def rendered(df: DataFrame, template: str, escape: bool = False) -> Column:
    """The template over df's columns. Null values, lists and conditions are as empty; with escape, values are escaped for HTML.

    An unknown name, field, filter or tag, a loop over no list and a tag without its end are errors here, before anything runs.
    """
    names = {f.name: Value(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields}
    return Compiler(template, escape).body(names)[0]
