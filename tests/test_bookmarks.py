"""Headings from bookmarks against a plain loop over the lines of a page."""

import random
from difflib import SequenceMatcher

from tessera.operators import bookmarks as B
from tessera.plans import catalog, layout_queries
from tests.duck import assert_same


def plain_page(lines, titles, fuzzy):
    out, held, raw, k = [], [], "", 0
    for s in lines:
        if k >= len(titles):
            out.append(s)
            continue
        level, title = titles[k]
        head = "#" * min(level, 6) + " " + title
        like = s.lower() == title.lower() != ""
        if not like and fuzzy and s and title and min(len(s), len(title)) / max(len(s), len(title)) > 0.9:
            like = SequenceMatcher(None, s.lower(), title.lower()).ratio() >= 0.9
        new = (raw + s).lower()
        if like or raw and new == title.lower():
            out.append(head)
            k, raw, held = k + 1, "", []
        elif not raw and len(s) > 8 and title.lower().startswith(s.lower()):
            raw, held = s, [s]
        elif raw and title.lower().startswith(new):
            raw, held = raw + s, [*held, s]
        elif raw:
            out += [*held, s]
            k, raw, held = k + 1, "", []
        else:
            out.append(s)
    return [*out, "#" * min(titles[k][0], 6) + " " + titles[k][1]] if raw else out


def check(lines, marks, got, fuzzy):
    pages, titles = {}, {}
    for r in sorted(lines.collect(), key=lambda r: r.line):
        pages.setdefault((r.doc_id, r.page), []).append((r.text or "").strip(" "))
    for r in sorted(marks.collect(), key=lambda r: r.ord):
        titles.setdefault((r.doc_id, r.page), []).append((r.level + 1, r.title.strip(" ")))
    want = {(*k, i): x for k, v in pages.items() for i, x in enumerate(plain_page(v, titles.get(k, []), fuzzy))}
    assert {(r.doc_id, r.page, r.place): r.text for r in got.collect()} == want
    return sum(x.startswith("#") for x in want.values())


def test_exact_titles_in_sql(spark, sf):
    assert_same(catalog.queries()["recovered_headings"](spark, sf), catalog.oracle_sql()["recovered_headings"], sf)


def test_alike_titles(spark, sf):
    def t(name):
        return spark.read.parquet(f"{sf}/{name}.parquet")

    lines, marks = layout_queries.page_lines(t), layout_queries.page_marks(t, True)
    assert check(lines, marks, layout_queries.alike_headings(t), True) > 100


def test_odd_pages(spark):
    rng, words = random.Random(3), ["Introduction to work", "A longer heading", "A longer", "heading", "methods and results", "Methods and", " results", "", "x", "Introduction to works", "methods  and"]
    lines = [(d if d else None, p, i, rng.choice([*words, None])) for d in range(30) for p in range(3) for i in range(rng.randint(1, 12))]
    marks = [(d if d else None, p, i, rng.randint(0, 8), rng.choice([*words[:5], "A longerheading", "Methods and results", "methods  and results"])) for d in range(30) for p in range(2) for i in range(rng.randint(0, 5))]
    left = spark.createDataFrame(lines, "doc_id long, page long, line long, text string")
    right = spark.createDataFrame(marks, "doc_id long, page long, ord long, level int, title string")
    for fuzzy in (False, True):
        check(left, right, B.headings_recovered(left, right, fuzzy), fuzzy)
    assert B.headings_recovered(left.limit(0), right).count() == 0 and B.headings_recovered(left, right.limit(0)).count() == left.count()


def test_titles_of_several_lines(spark):
    left = spark.createDataFrame([(1, 0, i, s) for i, s in enumerate(["The history of", " all the", " towns", "text", "1 Growth of th", "no more"])], "doc_id long, page long, line long, text string")
    right = spark.createDataFrame([(1, 0, 0, 0, "The history ofall thetowns"), (1, 0, 1, 1, "1 Growth of the town")], "doc_id long, page long, ord long, level int, title string")
    got = [r.text for r in B.headings_recovered(left, right).orderBy("place").collect()]
    assert got == ["# The history ofall thetowns", "text", "1 Growth of th", "no more"]


def test_a_line_is_compared_with_the_next_title_only(spark, monkeypatch):
    pairs = []
    monkeypatch.setattr(B, "ratio_reaches", lambda a, b, bar: pairs.append((a, b)))
    lines, titles = [f"line number {i:04}" for i in range(200)], [{"level": 1, "title": f"some title {i:05}"} for i in range(200)]
    assert B.aligned(lines, titles, True) == lines and len(pairs) == 200
    left = spark.createDataFrame([(1, 0, 0, "x")], "doc_id long, page long, line long, text string")
    right = spark.createDataFrame([(1, 0, 0, 0, "x")], "doc_id long, page long, ord long, level int, title string")
    # and once: explode brings a filter along that would work a deterministic column out again
    assert B.headings_recovered(left, right)._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_null_titles_and_levels(spark):
    left = spark.createDataFrame([(1, 0, i, s) for i, s in enumerate(["One", None, "two", "Three"])] + [(2, 0, 0, "One"), (2, 0, 1, "two")], "doc_id long, page long, line long, text string")
    right = spark.createDataFrame([(1, 0, 0, None, "one"), (1, 0, 1, 9, "Two"), (2, 0, 0, 0, "One"), (2, 0, 1, 0, None), (2, 0, 2, 0, "two")], "doc_id long, page long, ord long, level int, title string")
    got = [r.text for r in B.headings_recovered(left, right).orderBy("doc_id", "place").collect()]
    assert got == ["###### one", "", "###### Two", "Three", "# One", "two"]
