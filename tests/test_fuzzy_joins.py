"""The filtered fuzzy joins and numberings against all pairs."""

import random
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest

from tessera.functions import fuzzy, grams
from tessera.operators import nodes as N
from tessera.operators import retrieve
from tessera.plans import graph_queries, section_queries


def made(rng, text, letters="abcdefgh "):
    s = list(text)
    for _ in range(rng.randint(0, 6)):
        i = rng.randrange(len(s) + 1)
        if rng.random() < 0.5 and i < len(s):
            s.pop(i)
        else:
            s.insert(i, rng.choice(letters))
    return "".join(s)


def all_pairs(left, right, threshold, limit):
    by, out = {}, {}
    for g, j, t in right:
        if g is not None and t is not None:
            by.setdefault(g, []).append((j, t))
    for g, i, t in left:
        found = [(100.0 * SequenceMatcher(None, t, u).ratio(), j) for j, u in by.get(g, []) if t is not None]
        best = sorted(((-s, j) for s, j in found if s >= threshold))[:limit]
        out |= {(i, k + 1): (j, round(-s, 9)) for k, (s, j) in enumerate(best)}
    return out


def check(got, want):
    rows = got.collect()
    assert {(r.id, r["rank"]): (r.match_id, round(r.score, 9)) for r in rows} == want and len(rows) == len(want)


@pytest.mark.parametrize("threshold,limit", [(90.0, 1), (80.0, 3), (60.0, 2), (100.0, 1)])
def test_best_fuzzy_against_all_pairs(spark, threshold, limit):
    rng = random.Random(int(threshold))
    seeds = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 60))) for _ in range(12)] + ["", "a"]
    group = lambda: rng.choice([1, 1, 1, 2, 3, None])
    left = [(group(), i, rng.choice([None, made(rng, rng.choice(seeds)), rng.choice(seeds)])) for i in range(120)]
    right = [(group(), 1000 + i, rng.choice([made(rng, rng.choice(seeds)), made(rng, rng.choice(seeds)), rng.choice(seeds), None])) for i in range(160)]
    s = "grp long, id long, text string"
    got = retrieve.best_fuzzy(spark.createDataFrame(left, s), spark.createDataFrame(right, s), threshold, limit)
    check(got, all_pairs(left, right, threshold, limit))


def test_best_fuzzy_of_sentences(spark, sf_small):
    def t(name):
        return spark.read.parquet(f"{sf_small}/{name}.parquet")

    left, right = graph_queries.said_sentences(t)
    want = all_pairs([tuple(r) for r in left.collect()], [tuple(r) for r in right.collect()], 80.0, 1)
    check(graph_queries.fuzzy_best_match(t), want)
    assert len(want) > 500 and sum(s < 100 for _, s in want.values()) > 100


def test_fuzzy_choices(spark, sf):
    def t(name):
        return spark.read.parquet(f"{sf}/{name}.parquet")

    rows = [(r.url.split("://", 1)[1].split("/")[0].split("?")[0].split("#")[0], r.page_id, r.url) for r in t("pages").collect()]
    want = all_pairs([r for r in rows if r[1] % 2 == 0], [r for r in rows if r[1] % 2], 75.0, 3)
    check(graph_queries.fuzzy_choices(t), want)
    assert len(want) > 100


def test_many_copies_are_compared_once(spark):
    left = spark.range(3000).selectExpr("1L AS grp", "id", "'the same old sentence' AS text")
    right = spark.range(3000).selectExpr("1L AS grp", "id + 10000 AS id", "'the same odd sentence' AS text")
    got = retrieve.best_fuzzy(left, right, 90.0, 2)
    assert got.count() == 6000 and {r.match_id for r in got.select("match_id").distinct().collect()} == {10000, 10001}


def test_parts_of_large_groups_meet(spark):
    rng = random.Random(9)
    seeds = ["".join(rng.choice("abcdefgh ") for _ in range(40)) for _ in range(9)]
    sides = [[(rng.choice([1, 1, 1, 2]), at + i, t) for i, t in enumerate(sorted({made(rng, rng.choice(seeds)) for _ in range(90)}))] for at in (0, 1000)]
    left, right = (spark.createDataFrame(rows, "grp long, id long, text string") for rows in sides)
    for limit in (1, 3):
        best = {}
        for r in retrieve.best_alike(left, right, 70.0, limit, most=16).collect():
            best.setdefault(r.lid, []).append((-r.score, r.rid))
        got = {(i, k + 1): (j, round(-s, 9)) for i, found in best.items() for k, (s, j) in enumerate(sorted(found)[:limit])}
        assert got == all_pairs(*sides, 70.0, limit) and len(got) > 50


def test_texts_are_shipped_once(spark):
    """One row a text, not one for each of its sequences of characters."""
    side = spark.range(300).selectExpr("id % 20 AS grp", "id", "concat('a sentence of some length that has the number ', id) AS text")
    plan = retrieve.best_fuzzy(side, side, 80.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "tokens(" not in plan and plan.count("Generate") <= 2


def test_few_texts_are_compared(monkeypatch):
    rng, n, plain = random.Random(2), Counter(), fuzzy.ratio_of

    def counted(a, b):
        n["ratios"] += 1
        return plain(a, b)

    monkeypatch.setattr(fuzzy, "ratio_of", counted)
    url = lambda: f"https://tion.example.net/{rng.choice(['en', 'fr', 'de'])}/{rng.randrange(100000)}{rng.choice(['', '/', '.html', '#top'])}"
    left, right = sorted({url() for _ in range(60)}), sorted({url() for _ in range(600)})
    got = [[(j, round(s, 9)) for s, j in best] for best in fuzzy.best_ratios(left, right, 75.0, 3)]
    assert n["ratios"] < 30 * len(left)
    want = all_pairs([(1, i, t) for i, t in enumerate(left)], [(1, j, t) for j, t in enumerate(right)], 75.0, 3)
    assert {(i, k + 1): x for i, best in enumerate(got) for k, x in enumerate(best)} == want


def test_numbers_are_looked_up(monkeypatch):
    """In a large group the texts of few forms aren't compared by the matrices of all pairs, and none of the best is lost."""
    rng = random.Random(3)
    url = lambda n: f"{rng.choice(['http', 'https'])}://a.net/{rng.choice(['en', 'fr'])}/{rng.randrange(n)}{rng.choice(['', '/', '.html', '?page=2'])}"
    for n, bar, limit in ((3000, 75.0, 3), (3000, 90.0, 1), (10**8, 80.0, 2)):
        left, right = sorted({url(n) for _ in range(60)}), sorted({url(n) for _ in range(900)} | {"", "7", "no number"})
        want = all_pairs([(1, i, t) for i, t in enumerate(left)], [(1, j, t) for j, t in enumerate(right)], bar, limit)
        got = list(fuzzy.best_ratios(left, right, bar, limit, block=200))
        assert {(i, k + 1): (j, round(s, 9)) for i, best in enumerate(got) for k, (s, j) in enumerate(best)} == want
    compared = Counter()
    plain = fuzzy.shared_grams
    monkeypatch.setattr(fuzzy, "shared_grams", lambda a, b, q: compared.update(pairs=len(a) * len(b)) or plain(a, b, q))
    left, right = sorted({url(5000) for _ in range(300)}), sorted({url(5000) for _ in range(3000)})
    assert len(list(fuzzy.best_ratios(left, right, 75.0, 3))) == len(left) and compared["pairs"] < len(left) * len(right) / 10


def test_parts_of_both_sides_meet(spark):
    sides = [spark.range(120).selectExpr("1L AS grp", f"id + {at} AS id", f"concat('https://a.net/', id * {7 + at}) AS text") for at in (0, 1000)]
    got = {(r.lid, r.rid) for r in retrieve.best_alike(*sides, 70.0, 1, most=16, wide=40).groupBy("lid").agg({"score": "max"}).join(retrieve.best_alike(*sides, 70.0, 1, most=16, wide=40), "lid").where("score = `max(score)`").collect()}
    own = [[tuple(r) for r in side.collect()] for side in sides]
    want = all_pairs(*own, 70.0, 1)
    assert {i for i, _ in got} == {i for i, _ in want} and all((i, j) in got for (i, _), (j, _) in want.items())


def test_long_statements_are_not_compared_with_a_conclusion(monkeypatch):
    rng, n, plain = random.Random(12), Counter(), fuzzy.ratio_of

    def counted(a, b):
        n["ratios"] += 1
        return plain(a, b)

    words = ["so", "it", "ends", "with", "many", "words", "A", "B"]
    text = lambda most: " ".join(rng.choice(words) for _ in range(rng.randint(0, most)))
    pairs = [(text(9), text(9)) for _ in range(400)]
    for bar in (40.0, 60.0, 80.0):
        assert [fuzzy.token_set_over(a, b, bar) for a, b in pairs] == [fuzzy.token_set_of(a, b) > bar for a, b in pairs]
    monkeypatch.setattr(fuzzy, "ratio_of", counted)
    at = N.Numbering("so it ends", {})
    at.statement(" ".join(f"word{i}" for i in range(400)))
    assert not n and at.nodes[0]["kind"] == "statement"


def test_shared_grams_are_bounds():
    rng = random.Random(6)
    for q in (1, 2):
        a, b = ([made(rng, "abracadabra ab")[: rng.randint(0, 20)] for _ in range(30)] for _ in range(2))
        grams_of = lambda s, q=q: Counter(s[i : i + q] for i in range(len(s) - q + 1))
        want = np.array([[(grams_of(x) & grams_of(y)).total() for y in b] for x in a])
        assert np.array_equal(fuzzy.shared_grams(a, b, q)(slice(None)), want)
        assert np.all(fuzzy.shared_grams(a, b, q, keep=3)(slice(None)) >= want)


def test_tokens_miss_no_pair():
    rng = random.Random(5)
    for k in range(8000):
        letters = "ab" if k % 3 == 0 else "abcdefgh"
        a = "".join(rng.choice(letters) for _ in range(rng.randint(1, 40)))
        b = made(rng, a, letters)
        score, often = 100 * SequenceMatcher(None, a, b).ratio(), Counter(rng.choice(letters) + rng.choice(letters) for _ in range(9))
        for bar in (50, 75, 80, 90, 100):
            for q in (2, 3):
                assert score < bar or not set(grams.meeting_tokens(a, bar, often, q)).isdisjoint(grams.meeting_tokens(b, bar, often, q))


def test_common_subsequence_of_windows():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row, old = [0] * (len(b) + 1), row
            for j, y in enumerate(b):
                row[j + 1] = old[j] + 1 if x == y else max(old[j + 1], row[j])
        return row[-1]

    rng = random.Random(4)
    for n in (1, 5, 62, 63, 64, 126, 127, 200):
        short, long = ("".join(rng.choice("abcde") for _ in range(m)) for m in (n, n + rng.randint(0, 30)))
        assert fuzzy.common_of_windows(short, long).tolist() == [plain(short, long[i : i + n]) for i in range(len(long) - n + 1)]
        for bar in (40.0, 60.0, 80.0):
            assert fuzzy.partial_over(short, long, bar) == (fuzzy.partial_of(short, long) > bar)
    assert fuzzy.partial_over("", "", 60.0) and not fuzzy.partial_over("", "a", 60.0) and fuzzy.partial_over("abc", "xabcx", 60.0)
    assert np.all(fuzzy.common_of_windows("abc", "abcabc") >= 2)


def plain_numbers(edges, records, conclusion):
    """Every statement against all earlier ones."""
    nodes, keys, labels = [], {}, {}

    def add(key, *node):
        if key not in keys:
            keys[key] = len(nodes)
            nodes.append((len(nodes), *node))
        return keys[key]

    def statement(text):
        text = (text or "").strip()
        best = max(((fuzzy.ratio_of(text, known), -i) for i, known in enumerate(labels)), default=(0.0, 0))
        if best[0] > 90.0:
            return list(labels.values())[-best[1]]
        final = fuzzy.partial_of(text, conclusion or "") > 60 or fuzzy.token_set_of(text, conclusion) > 60
        labels[text] = add(("text", text), text, None, "conclusion" if final else "statement")
        return labels[text]

    out = []
    for e in edges:
        heads = [add(("url", records[h.ref].url), f"《{records[h.ref].title}》", records[h.ref].url, "citation") if h.ref is not None else statement(h.text) for h in e.heads]
        out.append((heads, statement(e.tail)))
    return nodes, out


def check_numbers(rows, got):
    own = {r.inference_id: ([tuple(n) for n in r.nodes], [(e.heads, e.tail) for e in r.edges]) for r in got.collect()}
    want = {r.inference_id: plain_numbers(r.edges, r.records, r.conclusion) for r in rows}
    assert own == want
    return sum(len(e) * 2 - len([n for n in ns if n[3] != "citation"]) for ns, e in want.values())


def test_numbers_of_random_chains(spark):
    rng, rows = random.Random(8), []
    for k in range(12):
        seeds = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 50))) for _ in range(6)]
        edges = [([(None, made(rng, rng.choice(seeds))), (0, None)], "r", made(rng, rng.choice(seeds))) for _ in range(60)]
        rows.append((k, seeds[0], edges, [("t", "u")]))
    s = "inference_id int, conclusion string, edges array<struct<heads:array<struct<ref:int,text:string>>,relation:string,tail:string>>, records array<struct<title:string,url:string>>"
    df = spark.createDataFrame(rows, s)
    assert check_numbers(df.collect(), N.numbered(df)) > 300


def test_numbers_of_whole_turns(spark, sf_small, monkeypatch):
    def t(name):
        return spark.read.parquet(f"{sf_small}/{name}.parquet")

    given = []
    monkeypatch.setattr(N, "numbered", given.append)
    section_queries.number_nodes(t)
    monkeypatch.undo()
    assert check_numbers(given[0].collect(), section_queries.number_nodes(t)) > 10


def test_ratio_reaches():
    rng = random.Random(5)
    for n in [0, 1, 3, 12, 60, 150, 198, 199, 200, 201, 260, 500] * 12:
        letters = rng.choice(["ab", "abcdefgh ", "abcdefghijklmnopqrstuvwxyz0123456789 "])
        a = "".join(rng.choice(letters) for _ in range(n))
        b = rng.choice([a, a[:4] + "#" + a[5:], made(rng, a), made(rng, made(rng, a)), a[::-1], "".join(rng.choice(letters) for _ in range(n)), a[n // 2 :] + a[: n // 2]])
        score = 100.0 * SequenceMatcher(None, a, b).ratio()
        for bar in (60.0, 90.0, score):
            assert fuzzy.ratio_reaches(a, b, bar) == (score >= bar), (a, b, bar)
