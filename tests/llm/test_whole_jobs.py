"""Whole jobs: cases where an operator once did less than its description."""

import numpy as np
import pytest

from tessera.llm import decontaminate, quality, secrets, simhash
from tests.llm.test_operators import components


def chains(seed, n, longest):
    """Distinct fingerprints in chains of 1 to 3 changed bits, shuffled."""
    rng, out = np.random.default_rng(seed), []
    while len(out) < n:
        x = int(rng.integers(0, 1 << 64, dtype=np.uint64))
        for _ in range(int(rng.integers(1, longest))):
            out.append(x)
            for b in rng.choice(64, int(rng.integers(1, 4)), replace=False):
                x ^= 1 << int(b)
    f = np.unique(np.array(out[:n], dtype=np.uint64))
    rng.shuffle(f)
    return f


@pytest.mark.parametrize("longest", [3, 8, 30, 120])
def test_forest_links_trees_that_meet_in_reached_lanes(longest):
    for seed in range(25):
        f = chains(seed, 40 + 12 * seed, longest)
        want = components(len(f), np.argwhere(np.triu(np.bitwise_count(f[:, None] ^ f) <= 3, 1)).tolist())
        assert components(len(f), simhash.forest(f, 3)) == want


def near_copy_groups(texts, similarity=0.8):
    sets = [set(simhash.shingles(t, 5)) for t in texts]
    near = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])]
    return components(len(sets), near)


def edited(rng, words, kind):
    n, w = len(words), list(words)
    if kind == "cut tail":
        return w[: n - int(0.17 * n)]
    if kind == "other tail":
        return w[: n - int(0.1 * n)] + [f"z{x}" for x in rng.integers(0, 10**6, int(0.1 * n))]
    if kind == "added tail":
        return w + [f"y{x}" for x in rng.integers(0, 10**6, int(0.2 * n))]
    for at in rng.choice(n, max(1, n // 60), replace=False):
        w[at] = f"x{rng.integers(0, 10**6)}"
    return w


def test_near_copies_finds_every_kind_of_edit(spark):
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(60):
        words = [f"w{x}" for x in rng.zipf(1.3, int(rng.integers(60, 400))) % 5000]
        texts += [" ".join(words), *(" ".join(edited(rng, words, k)) for k in ("cut tail", "other tail", "added tail", "words"))]
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == near_copy_groups(texts)


def test_near_copies_in_crowded_buckets(spark):
    rng = np.random.default_rng(8)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 200)]
    texts = []
    for _ in range(150):
        w = list(base)
        for at in rng.choice(200, int(rng.integers(2, 7)), replace=False):
            w[at] = f"x{rng.integers(0, 10**6)}"
        texts.append(" ".join(w))
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = near_copy_groups(texts)
    assert 1 < len(set(want)) < len(texts) and [got[i] for i in range(len(texts))] == want


def test_near_forest_links_only_what_is_alike():
    rng = np.random.default_rng(6)
    sketches = []
    for _ in range(6):
        own = rng.choice(1 << 30, 100, replace=False)
        for _ in range(20):
            kept = rng.random(100) > rng.choice([0.02, 0.3])
            sketches.append(np.unique(np.concatenate([own[kept], rng.choice(1 << 30, int((~kept).sum()))])).astype(np.int32))
    sketches = [sketches[i] for i in rng.permutation(len(sketches))]
    fps = np.array([simhash.majority(s.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for s in sketches], np.uint64)
    alike = [(i, j) for i in range(len(fps)) for j in range(i) if simhash.sketch_similarity(sketches[i], sketches[j]) >= 0.8]
    got = simhash.near_forest(fps, sketches, 0.8).tolist()
    assert {(max(e), min(e)) for e in got} <= set(alike) and len(got) < len(fps)
    assert components(len(fps), got) == components(len(fps), alike)


def test_components_in_one_task_and_by_rounds_agree(spark):
    from tessera.llm.common import components as spread

    rng = np.random.default_rng(9)
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 900, (700, 2))] + [(5, 5)], "u long, v long")
    both = [{r.node: r.root for r in spread(edges, in_one_task=n).collect()} for n in (0, 10_000)]
    assert both[0] == both[1] and len(set(both[0].values())) > 20
    none = edges.limit(0)
    assert spread(none).count() == 0 and spread(none, in_one_task=-1).count() == 0


@pytest.mark.parametrize("size", [1, 7, 300, 4000, 90_000])
def test_tallies_lose_no_alike_pair(size):
    """Pairs just above, at and far below the threshold, over sizes where slots stay empty and where they overflow a byte."""
    rng = np.random.default_rng(size)
    for part in (0.0, 0.02, 0.1, 0.111, 0.3, 1.0):
        pool = np.unique(rng.integers(0, 1 << 31, 3 * size + 8))
        rng.shuffle(pool)
        moved = int(part * size)
        a, b = np.sort(pool[:size]), np.sort(np.r_[pool[moved:size], pool[size : size + moved]])
        sizes = np.array([len(a)]), np.array([len(b)])
        rows = [np.frombuffer(simhash.tally(x.astype(np.int32)), np.uint8).reshape(1, -1) for x in (a, b)]
        may = bool(simhash.may_be_alike(*rows, *sizes, 0.8)[0])
        if simhash.sketch_similarity(a, b) >= 0.8:
            assert may
        if part == 1.0 and size in (300, 4000):
            assert not may


@pytest.mark.parametrize("share", [0.02, 0.1, 0.155, 0.5, 0.9, 0.98])
def test_quality_cut_over_all_quantiles(share):
    rng = np.random.default_rng(int(1000 * share))
    for spread in (0.0, 0.5, 3.0):
        y = (rng.random(800) < share).astype(int)
        s = np.round(y + spread * rng.standard_normal(800), 2)
        c = quality.best_cut(s, y)
        best = max(((s >= x) == (y == 1)).mean() for x in [*np.unique(s), s.max() + 1])
        assert ((s >= c) == (y == 1)).mean() == best
    x = np.c_[y.astype(float), np.zeros((800, quality.N_FEATURES - 1))]
    assert ((quality.fit_ranker(x, y).score(x) >= 0.3) == (y == 1)).all()


@pytest.mark.parametrize("period", [1, 2, 7, 10, 13, 400])
def test_windows_of_repeated_words_are_linear(period):
    import time

    item, text = (b" ".join(b"w%d" % (i % period) for i in range(n)).decode() for n in (2_000, 100_000))
    began = time.time()
    index = decontaminate.build_index([("a", item), ("b", "w0 w1 other")], {}, 10)
    ranges, found = decontaminate.hits(decontaminate.words_of("x y " + text + " z"), index)
    assert time.time() - began < 5
    assert decontaminate.merged(ranges) == [(2, 100_002)] and found == {"a"}


def test_windows_of_periodic_texts_against_all_windows():
    rng = np.random.default_rng(6)
    for _ in range(400):
        item, text = (" ".join(f"w{x}" for x in rng.integers(0, int(rng.integers(1, 4)), int(rng.integers(1, n)))) for n in (30, 60))
        a, b = decontaminate.words_of(item), decontaminate.words_of(text)
        size = min(4, len(a))
        windows = {tuple(a[p : p + size]) for p in range(len(a) - size + 1)}
        want = {q for p in range(len(b) - size + 1) if tuple(b[p : p + size]) in windows for q in range(p, p + size)}
        ranges, found = decontaminate.hits(b, decontaminate.build_index([("a", item)], {}, 4))
        assert {q for x, y in ranges for q in range(x, y)} == want and (found == {"a"}) == bool(want)


FORMS = {
    'private_key = "Zk3-Qp9_Lm2+Rt7" + "Yx8/Wv4=Bn6"': ["Zk3-Qp9_Lm2+Rt7", "Yx8/Wv4=Bn6"],
    'pwd2 = str("Zk3-Qp9_Lm2+Rt7")': "Zk3-Qp9_Lm2+Rt7",
    'auth = Secret(\'Zk3-Qp9_Lm2+Rt7\')': "Zk3-Qp9_Lm2+Rt7",
    'pwd = a\nb = 1\na = "Zk3-Qp9_Lm2+Rt7"': "Zk3-Qp9_Lm2+Rt7",
    '{"pwd": {"value": "Zk3-Qp9_Lm2+Rt7", "about": "a note on Zk3"}}': "Zk3-Qp9_Lm2+Rt7",
    '{"credential": {"data": {"value": "Zk3-Qp9_Lm2+Rt7"}}}': None,
    "<pwd>Zk3-Qp9_Lm2+Rt7</pwd>": "Zk3-Qp9_Lm2+Rt7",
    'passphrase = "correct horse battery staple"': "correct horse battery staple",
    'pwd_hint = "Please enter your password here."': None,
    'pwd = get("name")': None,
    'title = "Zk3-Qp9_Lm2+Rt7" + "x"': None,
    "<title>Zk3-Qp9_Lm2+Rt7</title>": None,
    "<pwd>Zk3-Qp9_Lm2+Rt7</title>": None,
    'a = b\nb = a\npwd = a': None,
    '{"pwd": {"length": "Zk3-Qp9_Lm2+Rt7"}}': None,
}


@pytest.mark.parametrize("text,value", FORMS.items())
def test_values_of_parsed_forms(text, value):
    found = [(k, text[s:e]) for k, s, e, _ in secrets.find_secrets(text) if k not in ("assign", "access", "hex")]
    assert [v for _, v in found] == ([] if value is None else value if isinstance(value, list) else [value])


@pytest.mark.parametrize("unit", ['password = "a" + ', "pwd: {", '"', "'", "<pwd>", "token(", 'key = "', "pwd = a\na = pwd\n", '"pwd" "a" ', "\\"])
def test_parsed_forms_are_linear(unit):
    import time

    text = "pwd = x " + unit * (1_000_000 // len(unit))
    began = time.time()
    secrets.redact(text, secrets.find_secrets(text))
    assert time.time() - began < 15
