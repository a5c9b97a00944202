"""Numbering of headings against a plain loop, sections against their offsets."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import headers as H


def plain_numbers(lines):
    counters, code, formulas, before, out = {}, False, False, 0, []
    for line in lines:
        line = line or ""
        if re.match("^ *```.*$", line):
            code = not code
        elif re.match(r"^ *\$\$ *$", line):
            formulas = not formulas
        elif not (code or formulas or line.startswith(("    ", "\t")) or line.strip().startswith(">")) and (m := re.match(r"^ *(#{1,3}(?!#)) +([0-9.]*) *", line)):
            level = len(m[1])
            if level < before:
                counters |= {k: 0 for k in counters if k > level}
            counters[level], before = counters.get(level, 0) + 1, level
            parts = [str(counters.setdefault(k, 1)) for k in range(1, level + 1)]
            line = f"{m[1]} {'.'.join(parts)}{'.' if level == 1 else ''} {line[m.end() :]}"
        out.append(line)
    return out


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_numbers_against_a_loop(spark, block):
    rng = random.Random(block)
    kinds = ["# A", "## 1.2 B", "### C", "#### D", "```", "``` py", "$$", "> # q", "    # code", "\t## t", "text", "", None, " ## 3. E", "#x", "# 2024 year", "$$ x"]
    docs = {d if d else None: [rng.choice(kinds) for _ in range(rng.randint(1, 40))] for d in range(60)}
    df = spark.createDataFrame([(d, i, s) for d, v in docs.items() for i, s in enumerate(v)], "doc_id long, row int, line string").repartition(4)
    got = {}
    for r in H.numbered_lines(df, block).collect():
        got.setdefault(r.doc_id, {})[r.row] = r.line
    assert got == {d: dict(enumerate(plain_numbers(v))) for d, v in docs.items()}
    assert H.numbered_lines(df.limit(0)).count() == 0


def test_sections_give_the_text_back(spark):
    texts = ["# A\ntext\n# B b \n\nmore\n## no\n#C\n# D", "no heading", "", None, "before\n# É漢🙂\nx", "# A\n# B", "#\n\nodd\nx"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = H.sections_of(docs).collect()
    want = []
    for d, text in enumerate(texts):
        found = list(re.finditer(r"(?m)^#\s+(.+)$", text or ""))
        for k, m in enumerate(found):
            end = found[k + 1].start() if k + 1 < len(found) else len(text)
            want.append((d, k, m[1].strip(), m.end(), end, text[m.end() : end]))
    assert sorted(map(tuple, rows)) == want and len(want) == 7


def test_body_and_references(spark):
    cases = {"a\n## References\n[1] x\n": ("a", "[1] x"), "a": ("a", ""), "正文\n# 3. 参考文章\n[1]": ("正文", "[1]"), "x\n# references\ny\n# References\nz": ("x", "y"), "": ("", ""), None: (None, None)}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: tuple(r.x) for r in df.select("t", H.body_and_references(F.col("t")).alias("x")).collect()} == cases
