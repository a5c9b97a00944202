"""Bounded samples of labelled rows, on which the classifiers of this package are fitted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import held_out

#: Labelled rows that a fit takes at most; the ids of a sample are broadcast, so this bounds the broadcast too.
MAX_ROWS = 9000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """text, label (0/1) and half (boolean) of at most max_rows labelled rows that aren't held out, by a hash of their ids.

    Null ids and labels are left out; an id with several labels has the largest. A sample, not the whole:
    only the fitted parameters depend on it, every row is scored.
    """
    ids = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    ids = ids.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    ids = ids.withColumn("h", F.xxhash64(F.col("doc_id"), F.lit(label))).orderBy("h", "doc_id").limit(max_rows)
    ids = ids.select("doc_id", "label", (F.pmod("h", F.lit(3)) == 0).alias("half"))
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "label", "half")
