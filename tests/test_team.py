"""Rounds over dependency graphs: cycles, unknown parents, failing stages, empty input; plans of sections with odd replies."""

import json
import random

from pyspark.sql import functions as F

from tessera.operators import team

ITEMS = "g long, id string, parent_ids array<string>"


def rounds(spark, rows, run=None, **kw):
    run = run or (lambda r: r.select("g", "id", F.concat_ws("", F.array_join("background", "+"), F.lit("("), "id", F.lit(")")).alias("result")))
    return {(r.g, r.id): (r.round, r.result) for r in team.ready_rounds(spark.createDataFrame(rows, ITEMS), run, ["g"], **kw).collect()}


def test_ready_rounds(spark):
    rows = [(1, "a", []), (1, "b", ["a"]), (1, "c", ["b", "a", "b"]), (2, "a", None), (2, "b", ["zz"]), (2, "c", ["d"]), (2, "d", ["c"]), (None, "a", []), (None, "b", ["a"])]
    got = rounds(spark, rows)
    assert got[(1, "c")] == (2, "(a)(b)+(a)(c)") and got[(1, "b")] == (1, "(a)(b)") and got[(2, "a")] == (0, "(a)") and got[(None, "b")] == (1, "(a)(b)")
    assert got[(2, "b")] == got[(2, "c")] == got[(2, "d")] == (None, None)
    assert rounds(spark, []) == {} and rounds(spark, [(1, "x", ["y"])]) == {(1, "x"): (None, None)}


def test_items_a_stage_leaves_out_block_what_follows(spark):
    def run(r):
        return r.where("id <> 'b'").select("g", "id", F.lit("r").alias("result"))

    assert rounds(spark, [(1, "a", []), (1, "b", []), (1, "c", ["b"]), (1, "d", ["a"])], run) == {(1, "a"): (0, "r"), (1, "b"): (None, None), (1, "c"): (None, None), (1, "d"): (1, "r")}


def test_rounds_read_their_own_items(spark, monkeypatch):
    """What can't be ready isn't met again in each round, and no round is run for it; large graphs have the same rounds by joins."""
    rng = random.Random(7)
    rows = [(g, str(i), sorted({str(rng.randrange(-1, i + 1 if rng.random() < 0.1 else max(1, i))) for _ in range(rng.randrange(3))})) for g in (1, 2, 3, None) for i in range(40)]
    rows += [(4, "a", []), (4, "b", ["a"]), (4, "c", ["nobody"])]
    want = rounds(spark, rows, most=0)
    assert rounds(spark, rows) == rounds(spark, rows, most=20) == want and max(n for n, _ in want.values() if n is not None) > 2
    asked = []
    plain = team.with_background
    monkeypatch.setattr(team, "with_background", lambda items, *a: asked.append(items.count()) or plain(items, *a))
    assert rounds(spark, [r for r in rows if r[0] == 4])[(4, "c")] == (None, None) and asked == [1, 1]


def test_steps_of_a_plan_are_not_dealt_anew(spark, monkeypatch):
    plans, plain = [], team.levelled

    def levelled(*a):
        out = plain(*a)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(team, "levelled", levelled)
    sections = spark.createDataFrame([(1, "s", "t", [])], "outline_id long, section_id string, title string, background array<string>")
    step = json.dumps({"is_research_completed": False, "steps": [{"id": "a", "title": "x"}]})
    team.section_plans(sections, lambda ps: [step] * len(ps), lambda s: team.collected(s, lambda ps: ['{"info_summary": "i"}'] * len(ps)), most=1)
    assert len(plans) == 1 and "Exchange" not in plans[0]


def test_levels_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(g, str(i), [str(i - 1)] if i else []) for g in range(9) for i in range(g + 1)]
        for most in (0, 5, 100):
            df = team.levelled(spark.createDataFrame(rows, ITEMS), ["g"], False, most)
            got = {(r.g, int(r.id)): r["_level"] for r in df.collect()}
            assert len(got) == len(rows) and all(n in (i, team.LARGE) and (n == i or g >= most) for (g, i), n in got.items())
            large = [{n == team.LARGE for (g, _), n in got.items() if g == k} for k in range(9)]
            assert all(len(x) == 1 for x in large)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_section_plans_end_in_each_way(spark):
    def planner(prompts):
        out = []
        for p in map(json.loads, prompts):
            step = {"id": "s", "title": "x", "parent_ids": ["nobody"] if p["title"] == "blocked" else []}
            out.append({"failed": "[", "completed": '{"is_research_completed": true}'}.get(p["title"]) or json.dumps({"is_research_completed": p["title"] == "later" and p["plan"] == 1, "steps": [] if p["title"] == "none" else [step]}))
        return out

    def raising(prompts):
        raise RuntimeError("no model")

    names = ["failed", "completed", "limit", "blocked", "none", "later"]
    sections = spark.createDataFrame([(1, n, n, []) for n in names], "outline_id long, section_id string, title string, background array<string>")
    own, steps = team.section_plans(sections, planner, lambda s: team.collected(s, lambda ps: ['{"info_summary": "i"}'] * len(ps)))
    assert {r.section_id: (r.status, r.plans, r.results) for r in own.collect()} == {
        "failed": ("failed", 0, []), "completed": ("completed", 0, []), "limit": ("limit", 2, ["i", "i"]), "blocked": ("empty", 2, []), "none": ("empty", 2, []), "later": ("completed", 1, ["i"]),
    }
    assert {(r.section_id, r.plan, r.round) for r in steps.collect()} == {("limit", 0, 0), ("limit", 1, 0), ("blocked", 0, None), ("blocked", 1, None), ("later", 0, 0)}
    own, _ = team.section_plans(sections, raising)
    assert {r.status for r in own.collect()} == {"failed"}
    own, steps = team.section_plans(sections.limit(0), planner)
    assert own.count() == 0 and steps.count() == 0
