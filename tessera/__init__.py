"""Tessera: a Spark-first engine for evidence-centred research data."""
