"""Named tools with argument schemas, called by name, and prompts filled from columns."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}


@dataclass
class Tool:
    """A function with a card: parameters are name -> type of JSON schema, `required` names those that must be given."""

    name: str
    description: str
    run: Callable[..., Any]
    parameters: dict[str, str] = field(default_factory=dict)
    required: tuple[str, ...] = ()

    def card(self) -> dict:
        properties = {k: {"type": v} for k, v in self.parameters.items()}
        return {"name": self.name, "description": self.description, "parameters": {"type": "object", "properties": properties, "required": list(self.required)}}

    def problem(self, args: dict) -> str | None:
        for name in self.required:
            if args.get(name) in (None, "", [], {}):
                return f"missing argument: {name}"
        for name, value in args.items():
            kind = self.parameters.get(name)
            if kind is None:
                return f"unknown argument: {name}"
            if value is not None and (not isinstance(value, KINDS[kind]) or (kind in ("integer", "number") and isinstance(value, bool))):
                return f"argument {name} is no {kind}"
        return None


class Toolbox:
    def __init__(self, *tools: Tool):
        self.tools = {t.name: t for t in tools}
        self.log: list[dict] = []

    def call(self, name: str, args: dict) -> dict:
        """result or error, never an exception; the call and its seconds are logged."""
        began, tool = time.monotonic(), self.tools.get(name)
        error = f"unknown tool: {name}" if tool is None else tool.problem(args)
        result = None
        if error is None:
            try:
                result = tool.run(**args)
            except Exception as e:  # a tool's failure is its result
                error = repr(e)
        self.log.append({"tool": name, "seconds": time.monotonic() - began, "error": error})
        return {"tool": name, "result": result, "error": error}


def prompt(template: str, **columns: Column) -> Column:
    """template with each {{ name }} as its column; values are put in once and never read as templates, nulls are empty."""
    parts = re.split(r"\{\{\s*(\w+)\s*\}\}", template)
    missing = set(parts[1::2]) - set(columns)
    if missing:
        raise ValueError(f"no column for {sorted(missing)}")
    shown = [F.coalesce(columns[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)]
    return F.concat(*shown)
