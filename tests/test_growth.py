"""Work that must not grow faster than its tables: how often a value is worked out, and how many rows a task takes."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import charts as C
from tessera.operators import records
from tessera.operators import sections as S
from tessera.operators.model import model_map
from tessera.plans import flow_queries, record_queries


def test_sentences_are_cut_once(spark):
    plan = spark.range(1).select(S.citation_chunk(F.concat(F.lit("a。"), F.col("id").cast("string"))).alias("c"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(") == 1


@pytest.mark.parametrize("query,key", [(record_queries.value_range, "o_orderkey"), (flow_queries.reference_lines, "doc_id")])
def test_tasks_take_so_many_rows(spark, sf, monkeypatch, query, key):
    monkeypatch.setattr(records, "ROWS", 1000)
    got = query(lambda name: spark.read.parquet(f"{sf}/{name}.parquet"))
    most = got.groupBy(F.spark_partition_id()).agg(F.countDistinct(key).alias("n")).agg(F.max("n")).first()[0]
    assert most < 500


def test_only_prompts_pass_through_python(spark):
    df = spark.range(3).select("id", F.lit("wide").alias("text"), F.col("id").cast("string").alias("p"))
    got = model_map(df, "p", "template", lambda prompts: [p * 2 for p in prompts])
    assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString() and [r.reply for r in got.orderBy("id").collect()] == ["00", "11", "22"]


def test_axis_is_worked_out_once(spark):
    df = spark.createDataFrame([("bar", "u", ["a", "b", "c"], [1.0, 2.0, 4.0])], "kind string, unit string, a array<string>, v array<double>")
    plan = df.select(C.mermaid_xy(F.col("kind"), F.col("unit"), F.col("a"), F.col("v")).alias("c"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("array_min(") == 1
