"""What the operators of this package share: tables, cuts of lineage, connected components."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: bytes.translate table that lower-cases A-Z and nothing else.
ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: For doc_ids that are null, in hashes.
HELD_OUT_FOLDS = 5
#: Edges whose components one task may work out: some 100 MB.
IN_ONE_TASK = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one only where that is unset and the master local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def slices(batches, rows: int = 256):
    """Arrow batches in slices of a few rows, so that a worker holds few texts as Python objects at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def cut(df: DataFrame, label: str, rows: int | None = None, per_file: int = 200_000) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lost executors then cost no recomputation.

    Where about how many rows it has is known, it is written in files of per_file rows instead of one a partition.
    """
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // per_file)))
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a cut that nothing reads any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def set_aside(docs: DataFrame, core: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """docs with all but the core columns under names that clash with nothing, places unchanged."""
    return docs.toDF(*[c if c in core else f"_own{i}" for i, c in enumerate(docs.columns)])


def named_back(out: DataFrame, docs: DataFrame) -> DataFrame:
    """out, whose first columns are those of set_aside(docs), under docs' names; those that clash with an added one end in _in."""
    n = len(docs.columns)
    added = {c.lower() for c in out.columns[n:]}
    return out.toDF(*[f"{c}_in" if c.lower() in added else c for c in docs.columns], *out.columns[n:])


def held_out(doc_id: str = "doc_id") -> F.Column:
    """True where crc32 of the id as text leaves no remainder by HELD_OUT_FOLDS; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % HELD_OUT_FOLDS == 0, F.lit(True))


def joined_trees(batches, names: tuple[str, str] = ("node", "root")):
    """Union-find over all edges of a task: the smallest node of its component for each other node."""
    above: dict = {}

    def top(x):
        while (up := above.setdefault(x, x)) != x:
            above[x] = above[up]
            x = above[x]
        return x

    kind = None
    for b in batches:
        kind = b.column(0).type
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            a, c = top(u), top(v)
            if a != c:
                above[max(a, c)] = min(a, c)
    if above:
        nodes = [x for x in above if top(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([top(x) for x in nodes], kind)], names=names)


def components(edges: DataFrame, max_rounds: int = 60, rows: int | None = None, in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """Connected components of edges (u, v): by union-find in one task where there are in_one_task edges at most, else by
    alternating large-star and small-star rounds; both give the same.

    Returns (node, root) for each node that isn't the smallest of its component; root is that smallest node. Every round groups with partial aggregation and joins against one row a node, so that a node with
    very many edges is split like any skewed join; each round is written to the shared folder. Null ends
    and loops are ignored. An empty input gives an empty result.
    """
    spark = edges.sparkSession

    def stars(e: DataFrame) -> tuple:
        return e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u") % 1000003)).first()

    canon = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    canon = cut(canon, "edges", rows)
    if canon.count() <= in_one_task:
        kind = canon.schema["u"].dataType.simpleString()
        return cut(canon.coalesce(1).mapInArrow(joined_trees, f"node {kind}, root {kind}"), "roots", 1)
    before = stars(canon)
    if before[0] == 0:
        return canon.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(max_rounds):
        both = canon.union(canon.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = cut(moved.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges", before[0])
        now = stars(after)
        drop_cut(canon)
        canon = after
        if now == before:
            return canon.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
