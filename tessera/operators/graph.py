"""Dependency graphs: levels, components, reachability, pruning. Recursion in SQL, or rounds with written cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, so that rounds don't grow the plan."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/graph/{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def levels(nodes: DataFrame, edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(id, level): 0 for nodes without parents, else one more than the highest parent. Nodes on a cycle are left out.

    edges: src (parent), dst. Each round takes the nodes all of whose parents are done.
    """
    left, done, level = nodes.select("id").distinct(), None, 0
    edges = settled(edges.select("src", "dst").distinct())
    left = settled(left)
    while True:
        waiting = edges.join(left.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        ready = settled(left.join(waiting, "id", "left_anti"))
        if ready.isEmpty():
            break
        if level == max_rounds:
            raise RuntimeError("levels did not settle")
        now = ready.withColumn("level", F.lit(level))
        done = now if done is None else done.unionByName(now)
        left = settled(left.join(ready, "id", "left_anti"))
        level += 1
    return done if done is not None else left.withColumn("level", F.lit(0)).limit(0)


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(id, component): the smallest id weakly reachable. Labels of neighbours, then labels of labels, until nothing changes."""
    both = settled(edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct())
    label = settled(nodes.select("id").distinct().withColumn("component", F.col("id")))
    for _ in range(max_rounds):
        near = both.join(label.select(F.col("id").alias("src"), F.col("component").alias("c")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("c"))
        low = label.join(near, "id", "left").select("id", F.least("component", F.coalesce("c", "component")).alias("component"), F.col("component").alias("was"))
        jump = low.select(F.col("id").alias("component"), F.col("component").alias("next"))
        after = settled(low.join(jump, "component", "left").select("id", F.least("component", F.coalesce("next", "component")).alias("component"), "was"))
        changed = not after.where("component <> was").isEmpty()
        label = after.select("id", "component")
        if not changed:
            return label
    raise RuntimeError("components did not settle")


def reaches(edges: DataFrame, goals: DataFrame, stops: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """ids from which a goal can be reached backwards over edges; ids in stops are kept and not gone beyond."""
    edges = settled(edges.select("src", "dst").distinct())
    seen = settled(goals.select("id").distinct())
    front = seen
    for _ in range(max_rounds):
        go = front.join(stops.select("id").distinct(), "id", "left_anti")
        found = edges.join(go.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id")).distinct()
        front = settled(found.join(seen, "id", "left_anti"))
        if front.isEmpty():
            return seen
        seen = settled(seen.unionByName(front))
    raise RuntimeError("reachability did not settle")


def edges_of(hyper: DataFrame) -> DataFrame:
    """hyper (edge_id, heads array, relation, tail) as src, relation, dst, without loops."""
    return hyper.select("edge_id", F.explode("heads").alias("src"), "relation", F.col("tail").alias("dst")).where("src <> dst")


def grounded(edges: DataFrame, nodes: DataFrame, citations: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """Nodes left after removing, until nothing changes, those that are no citation and that no kept node leads to."""
    edges, left = settled(edges.select("src", "dst").distinct()), settled(nodes.select("id").distinct())
    for _ in range(max_rounds):
        fed = edges.join(left.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).union(citations.select("id"))
        kept = settled(left.join(fed.distinct(), "id", "left_semi"))
        if kept.count() == left.count():
            return kept
        left = kept
    raise RuntimeError("pruning did not settle")
