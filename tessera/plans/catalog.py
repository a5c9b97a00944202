"""The registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import base, batch_queries, check_queries, flow_queries, graph_queries, layout_queries, record_queries, report_flow_queries, report_queries, section_queries, shown_queries, team_queries, text_queries, trace_queries  # noqa: F401  registration


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold each benchmark passage, as numbered references."""
    return base.QUERIES["evidence_references"](spark, sf_dir)


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
