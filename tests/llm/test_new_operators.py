"""Operators 11 to 13 against brute force, with odd rows."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter
from itertools import pairwise

import pytest

from tessera.llm import conversations, licenses, periods, queries
from tests.duck import assert_same
from tests.llm import fixtures

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- 11


def plain_licenses(text):
    """All rules, without their gates, over words; a detection stays if none before it (priority, length, place, rule) covers it."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))
    base = sorted((i, i + len(p.split()), label) for p, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    joined, found = " " + " ".join(words) + " ", []
    for k, r in enumerate(licenses.rules()):
        for m in re.finditer(r.pattern.pattern.decode(), joined):
            s = joined.count(" ", 0, m.start())
            found.append((-r.priority, s - (s + len(m[0].split())), s, k, s + len(m[0].split())))
    kept = []
    for p, _, s, k, e in sorted(found):
        if not any(a <= s and e <= b for a, b, _ in kept):
            kept.append((s, e, licenses.rules()[k].label))
    return len(words), base, sorted(kept)


def check_licenses(rows, got):
    want = Counter()
    for i, t in rows:
        n, base, kept = plain_licenses(t)
        own, all_labels = {x[2] for x in base}, {x[2] for x in base} | {x[2] for x in kept}
        want[(i, n, len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(own)), ",".join(sorted(all_labels)))] += 1
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in got.collect()) == want
    assert all(0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) for r in got.collect())


NOTICES = {
    "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0",
    "Released under the MIT License.": "mit",
    "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
    "Licensed under the Apache License, Version 2.0 (the \"License\")": "apache-2.0",
    "GNU Lesser General Public License version 2.1": "gpl,lgpl-2.1",
    "SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2.0-or-later",
    "SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause",
    "GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version": "gpl,gpl-3.0-or-later",
    "https://creativecommons.org/licenses/by-sa/3.0/": "cc-by-sa-3.0",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mit",
    "© 2020 ACME. ALL RIGHTS\nRESERVED": "reserved",
    "dual licensed under the Apache License 2.0 or the MIT license": "apache-2.0,mit",
    "mit der Bahn und mit dem Rad": "",
    "we all reserved some rights, by cc": "",
    "cc by. CC-BY; cc/by": "cc-by",
}


@pytest.mark.parametrize("text,labels", NOTICES.items())
def test_license_rules(text, labels):
    base, found = licenses.detections(licenses.words_of(text))
    assert ",".join(sorted({licenses.rules()[i].label for _, _, i in [*base, *found]})) == labels


def test_there_are_hundreds_of_license_rules():
    assert len({r.pattern.pattern for r in licenses.rules()}) > 300


def test_licenses_against_plain_rules(spark, sf_small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    check_licenses(rows, queries.op11_licenses(spark, sf_small))


def test_licenses_odd_rows(spark, tmp_path):
    rng, parts = random.Random(4), [*NOTICES, "word", "of the license", "version 2", "or later", "gnu", "public", "cc0 1.0", "bsd 2-clause", "\n", "é漢"]
    mixed = [(1000 + i, " ".join(rng.choice(parts) for _ in range(rng.randint(1, 12))), "en") for i in range(40)]
    d = fixtures.docs(spark, [*mixed, (2000, "all rights reserved " * 3000, "en")])
    d.write.parquet(f"{tmp_path}/documents.parquet")
    check_licenses([(r.doc_id, r.text) for r in d.collect()], queries.op11_licenses(spark, str(tmp_path)))
    out = licenses.scan_licenses(d.withColumnRenamed("label", "score"))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "score_in", "weight", "n_words", "base", "licenses", "score"]
    assert licenses.scan_licenses(fixtures.empty(spark)).count() == 0


@pytest.mark.parametrize("unit", ["licensed under the ", "cc by ", "general public license ", "reproduced permission no part of this work ", "a", "apache license 2 0 mit "])
def test_licenses_are_linear_in_long_texts(unit):
    import time

    words = licenses.words_of(unit * (1_000_000 // len(unit)))
    began = time.time()
    licenses.detections(words)
    assert time.time() - began < 20


# --- 12


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def follow(state, letter):
    return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, letter))


def plain_repair(turns):
    """Dijkstra over (cost, audit) and the state: the first end taken is the cheapest, then the least."""
    seen, faults = set(), []
    for _, role, text in turns:
        shown = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(turns) and state in ("", "a"):
            break
        for role in ("user", "assistant"):
            if follow(state, role[0]):
                heapq.heappush(heap, (cost + 3, audit + "I", i, role[0], (*out, f"{role}:")))
        if i < len(turns):
            _, role, text = turns[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, out))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                if role and follow(state, role[0]):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[0], (*out, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if follow(state, new[0]):
                        heapq.heappush(heap, (cost + more + 3, audit + "R", i + 1, new[0], (*out, f"{new}:{text}")))
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairwise(turns))
    return gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(out))


def check_repair(rows, got):
    by = {conv: [] for conv, *_ in rows}
    for conv, turn, role, text in damage(rows):
        by[conv].append((turn, role, text))
    want = {c: plain_repair(sorted(v, key=lambda x: (x[0] is not None, x[0] or 0))) for c, v in by.items()}
    own = {r.conv_id: tuple(r)[1:] for r in got.collect()}
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert got.count() == len(own) and own == want


SCHEMA = "conv_id long, turn long, role string, text string, label string"


def random_turns(seed, n_conv, longest, steps=(1, 1, 1, 2)):
    rng, out = random.Random(seed), []
    for c in range(n_conv):
        turn = rng.randint(0, 3)
        for k in range(rng.randint(1, longest)):
            out.append((c if c else None, turn if k or rng.random() > 0.2 else None, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(["a.", "b", "c!", " ", "", None, "d?\n", "long é." + str(turn)])))
            turn += rng.choice(steps)
    return out


def test_repair_of_the_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check_repair(rows, queries.op12_conversations(spark, sf))
    assert_same(queries.op12_conversations(spark, sf), queries.oracle_sql()["op12_conversations"], sf)


@pytest.mark.parametrize("n_conv,longest", [(60, 9), (3, 400), (1, 700)])
def test_repair_over_whole_and_split_conversations(spark, tmp_path, n_conv, longest):
    rows = random_turns(n_conv, n_conv, longest)
    spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        for coalesced, n in (("true", "6"), ("false", "13")):
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
            spark.conf.set("spark.sql.shuffle.partitions", n)
            check_repair(rows, queries.op12_conversations(spark, str(tmp_path)))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_rebuilt_turns_make_the_hash(spark):
    rows = random_turns(9, 25, 60)
    d = queries.damaged(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA))
    summary = {r.conv_id: r for r in conversations.repair_conversations(d).collect()}
    by = {}
    for r in sorted(conversations.rebuilt_turns(d).collect(), key=lambda r: (r.part, r.place)):
        by.setdefault(r.conv_id, []).append(r)
    for c, r in summary.items():
        turns = by.get(c, [])
        assert r.repaired_sha256 == sha("\n".join(f"{t.role}:{t.text}" for t in turns)) and r.audit.replace("D", "") == "".join(t.edit for t in turns)
        assert re.fullmatch("(s?(ua)+)?", "".join(t.role[0] for t in turns))


def test_repair_of_nothing_and_of_copies(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert conversations.repair_conversations(none).count() == 0 and conversations.rebuilt_turns(none).count() == 0
    same = spark.createDataFrame([(1, None, "user", "Hi.", "x")] * 300, SCHEMA).repartition(4)
    r = conversations.repair_conversations(same).collect()
    assert [tuple(x)[:7] for x in r] == [(1, 0, 0, 299, 0, 299, 299 * 4 + 3)] and sorted(r[0].audit) == sorted("D" * 299 + "KI")


# --- 13


def plain_runs(words, least=12):
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            run = words[s : i + q]
            if len(run) >= max(least, 2 * q) and not any(all(a == b for a, b in zip(run, run[p:], strict=False)) for p in range(1, q)):
                out.append((s, len(run), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def check_periods(rows, got):
    want = Counter()
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(w), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if j < a else w[a + (j - a) % p] for j, x in enumerate(w)]
        runs = plain_runs(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        dropped = {j for s, length, q in runs for j in range(s + q, s + length)}
        kept = " ".join(x for j, x in enumerate(w) if j not in dropped)
        want[(i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{x},{q}\n" for s, x, q in runs)), sha(kept))] += 1
    assert Counter(tuple(r) for r in got.collect()) == want


def test_periods_of_the_table(spark, tmp_path, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 6000")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_periods(spark, str(tmp_path))
    check_periods([(r.doc_id, r.text) for r in d.collect()], got)
    assert got.where("n_runs > 0").count() > 50


def test_periods_odd_rows(spark, tmp_path):
    rng = random.Random(7)
    extra = [(100 + i, " ".join(str(rng.randint(1, rng.choice([1, 2, 3, 9]))) for _ in range(rng.randint(0, 120))), "en") for i in range(300)]
    d = fixtures.docs(spark, extra).where("doc_id is null or doc_id <> 7")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    check_periods([(r.doc_id, r.text) for r in d.collect()], queries.op13_periods(spark, str(tmp_path)))
    out = periods.periodic_runs(fixtures.docs(spark).withColumnRenamed("label", "runs"))
    by = {r.doc_id: r for r in out.collect()}
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "runs_in", "weight", "runs", "collapsed"]
    assert [tuple(r) for r in by[7].runs] == [(0, 30000, 1)] and by[7].collapsed == "word" and by[5].text is None and by[5].collapsed == ""
    assert periods.periodic_runs(fixtures.empty(spark)).count() == 0


def test_runs_against_brute_force():
    rng = random.Random(1)
    for k in range(1500):
        n, kinds = rng.randint(0, 90), rng.choice([1, 2, 3, 5, 30])
        w = [b"%d" % rng.randint(1, kinds) for _ in range(n)]
        if n and rng.random() < 0.5:
            a = rng.randrange(n)
            p = 1 + (n - a) // (3 + rng.randrange(8))
            w = w[:a] + [w[a + i % p] for i in range(n - a)]
        least = rng.choice([12, 12, 2, 5, 7])
        assert periods.runs_of(w, least, passes=k % 4) == plain_runs(w, least)


def test_places_keep_order():
    rng, xs = random.Random(2), list(range(5000))
    rng.shuffle(xs)
    s, held = periods.Places(xs[0]), {xs[0]}
    for x in xs[1:]:
        a, b = s.add(x)
        assert (a is None or a in held and a < x) and (b is None or b in held and x < b)
        held.add(x)
    assert list(s) == list(range(5000)) and s.size == 5000


def test_runs_of_long_texts():
    import time

    began = time.time()
    assert periods.runs_of([b"w"] * 300_000) == [(0, 300_000, 1)]
    assert periods.runs_of([b"%d" % (i % 70_000) for i in range(300_000)]) == [(0, 300_000, 70_000)]
    assert time.time() - began < 40
