"""Queries over traces on tables made for their edges."""

from tessera.plans import base, trace_queries
from tests.duck import assert_same


def test_report_table_order_rounds_halves_as_its_sql(spark, tmp_path):
    rows = [(1, 3, 2.0), (2, 3, 2.5), (3, 3, 4.0), (5, 3, 3.5), (6, 3, 1.49), (7, 3, 0.5), (9, 3, 0.0)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").toPandas().to_parquet(tmp_path / "orders.parquet")
    got = trace_queries.report_table_order(lambda name: spark.read.parquet(f"{tmp_path}/{name}.parquet"))
    assert_same(got, base.SQL["report_table_order"], str(tmp_path))
