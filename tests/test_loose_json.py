"""The tolerant reader: valid JSON damaged at random places, cut anywhere, and forms of its own."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.functions import loose_json as J
from tessera.operators import replies as R

TEXTS = ["", "a", "it's", "x: y", "a, b", "{no}", "[1]", "é漢🙂", 'say "hi" now', "back\\slash", "tab\there", "line\nend", "// no comment", "# x", "true", "12"]


def made(rng, depth=0):
    k = rng.random()
    if depth > 3 or k < 0.4:
        return rng.choice([None, True, False, 0, -3, 12.5, 1e20, *TEXTS])
    if k < 0.7:
        return [made(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return {rng.choice(["a", "b1", "c_d", "key with space", "é"]): made(rng, depth + 1) for _ in range(rng.randint(0, 4))}


def written(v, rng, style):
    """v as a model may write it."""
    if isinstance(v, (dict, list)):
        inner = [written(x, rng, style) for x in v] if isinstance(v, list) else []
        if isinstance(v, dict):
            for k, x in v.items():
                bare = "bare" in style and k.replace("_", "a").isalnum()
                inner.append((k if bare else json.dumps(k, ensure_ascii=False)) + rng.choice([":", ": ", " : "]) + written(x, rng, style))
        gap = ",\n" if "lines" not in style else "\n"
        body = gap.join(inner) + (rng.choice([",", ", "]) if "trailing" in style and inner else "")
        note = rng.choice(["// a note, with {\n", "/* an aside ] */ ", "# so\n"]) if "comments" in style and rng.random() < 0.4 else ""
        return ("{" if isinstance(v, dict) else "[") + note + body + ("}" if isinstance(v, dict) else "]")
    if isinstance(v, str):
        return json.dumps(v, ensure_ascii="escapes" in style)
    return repr(v) if "python" in style and not isinstance(v, float) else json.dumps(v)


STYLES = ["plain", "bare", "trailing", "lines", "comments", "python", "escapes"]


@pytest.mark.parametrize("style", [*STYLES, "bare trailing comments python", "bare lines python escapes"])
def test_damaged_styles_read_alike(style):
    rng = random.Random(style)
    for _ in range(400):
        v = made(rng)
        if isinstance(v, (dict, list)):
            text = written(v, rng, style)
            for t in (text, f"```json\n{text}\n```", f"Here it is:\n{text}\nDone."):
                got = J.loads(t) if v or t == text else v
                assert got == v, (t, got)


def prefix_of(part, v):
    """Whether part is what a cut may leave of v."""
    if isinstance(part, list) and isinstance(v, list):
        return len(part) <= len(v) and all(prefix_of(a, b) for a, b in zip(part, v, strict=False))
    if isinstance(part, dict) and isinstance(v, dict):
        keys = list(v)
        return all((k in v and prefix_of(x, v[k])) or (x is None and any(y.startswith(k) for y in keys)) for k, x in part.items())
    if isinstance(part, str) and isinstance(v, str):
        return v.startswith(part) or part.endswith("\\") or "\\" in json.dumps(v)
    return part is None or part == v or isinstance(part, (int, float)) and isinstance(v, (int, float))


def test_cut_anywhere():
    rng = random.Random(11)
    for _ in range(300):
        v = made(rng)
        if v and isinstance(v, (dict, list)):
            text = json.dumps(v, ensure_ascii=False)
            for at in range(1, len(text)):
                out = J.mend(text[:at])
                assert out is None or prefix_of(json.loads(out), v), (text[:at], out)


@pytest.mark.parametrize("text,want", [
    ("{a: 1, b: two words, 'c': 'it'}", {"a": 1, "b": "two words", "c": "it"}), ('{"a": "he said "yes" twice", "b": 2}', {"a": 'he said "yes" twice', "b": 2}),
    ('{"a" 1 "b" 2}', {"a": 1, "b": 2}), ('{"a": [1, 2}', {"a": [1, 2]}), ('{"a": {"b": [1, {"c": "d', {"a": {"b": [1, {"c": "d"}]}}), ("[1, 2]] trailing", [1, 2]), ('{"a": tru', {"a": None}),
    ("{“a”: “b”}", {"a": "b"}), ("{'a' => 007}", {"a": 7}), ('{"a":, "b": 1}', {"a": None, "b": 1}), ('["a" "b"]', ["a", "b"]), ('{"u": "\\ud83d\\ude42\\x"}', {"u": "🙂x"}), ('[}1, 2]', [1, 2]),
])
def test_forms(text, want):
    assert J.loads(text) == want


@pytest.mark.parametrize("text", ["", "plain", "[oops", "{", '"{[" in {"k": "]"}'])
def test_no_json(text):
    assert J.mend(text) is None


@pytest.mark.parametrize("unit", ["[", "{", '{"a":', "}", '"', '["', "' ", '" ', "/*", "//", "a:", "\\", "[}", '"a" ', ",", "\n", "[{]"])
def test_linear_in_long_texts(unit):
    began = time.time()
    J.mend("[" + unit * (400_000 // len(unit)))
    J.mend('{"a": ' + unit * (400_000 // len(unit)))
    assert time.time() - began < 20


def test_in_a_column(spark):
    rows = [("Sure:\n```json\n{a: [1, 2,], // x\n b: 'c'}\n```", '{"a": [1, 2], "b": "c"}'), (None, None), ("no", "no")]
    got = spark.createDataFrame(rows, "a string, b string").select("b", R.json_text(F.col("a")).alias("got")).collect()
    assert all(r.got == r.b for r in got)
