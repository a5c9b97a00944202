"""Urls near each other against difflib; rows of odd values for masks, redaction and rules."""

from difflib import SequenceMatcher

from pyspark.sql import functions as F

from tessera.functions import urls as U
from tessera.operators import shown
from tessera.plans import shown_queries


def test_near_urls_against_difflib(spark, sf):
    def t(name):
        return spark.read.parquet(f"{sf}/{name}.parquet")

    rows, before, pairs = sorted((r.page_id, r.url) for r in t("pages").collect()), {}, []
    for i, url in rows:
        host = url.split("://", 1)[1].split("/")[0].split("?")[0].split("#")[0]
        pairs += [(i, "before", url, before.get(host)), (i, "last", url, url[:-1] + "~"), (i, "tail", url, url + "/much/further/down/the/tree")]
        before[host] = url
    df = spark.createDataFrame(pairs, "page_id long, k string, a string, b string")
    x, y = U.normal_url(F.col("a")), U.normal_url(F.col("b"))
    want = {}
    for r in df.select("page_id", "k", x.alias("x"), y.alias("y"), U.same_page(F.col("a"), F.col("b")).alias("same")).collect():
        want[(r.page_id, r.k)] = r.y is not None and (r.same or SequenceMatcher(None, r.x, r.y).ratio() >= 0.9)
    got = {(r.page_id, k): r[k] for r in shown_queries.near_urls(t).collect() for k in ("before", "last", "tail")}
    assert got == want and len(got) == 3 * len(rows)
    assert {v for (_, k), v in want.items() if k == "before"} == {True, False} and any(v for (_, k), v in want.items() if k == "last") and not all(v for (_, k), v in want.items() if k == "tail")


def test_masks(spark):
    df = spark.createDataFrame([("abcdefgh",), ("abcd",), ("a",), ("",), (None,)], "k string")
    assert [r[0] for r in df.coalesce(1).select(shown.masked(F.col("k"))).collect()] == ["****efgh", "****", "*", None, None]
    m = F.lit(b"0123456789abcdef0123456789abcdef")
    assert [r[0] for r in df.coalesce(1).select(shown.unsealed(shown.sealed(F.col("k"), m), m)).collect()] == ["abcdefgh", "abcd", "a", "", None]
    assert df.select(shown.unsealed(F.lit("bm90IHNlYWxlZCBhdCBhbGwsIG5vdCBhdCBhbGw="), m)).first()[0] is None


def test_rules_and_redaction(spark):
    df = spark.createDataFrame([({"Key": "x", "b": "y" * 200, "a": None}, " "), ({}, "ok"), (None, None)], "p map<string,string>, f string").coalesce(1)
    got = df.select(shown.logged(F.col("p")).alias("p"), shown.problems([shown.Rule("f", required=True, allowed=("ok",))], ("f",)).alias("e")).collect()
    assert [r.p for r in got] == ["a=, b=" + "y" * 100, "", None] and [len(r.e) for r in got] == [2, 0, 2]
