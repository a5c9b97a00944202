"""Deduplication, merging and set operations on ordered records. Every operator names its order explicitly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key, the first by order; rows that lack a key are dropped."""
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def last_wins(df: DataFrame, keys: list[str], pos: str, tie: str) -> DataFrame:
    """One row for each key: the values of the last, at the first one's place (`first_pos`)."""
    value = F.struct(*[c for c in df.columns if c not in keys])
    out = df.groupBy(*keys).agg(F.max_by(value, F.struct(pos, tie)).alias("_v"), F.min(pos).alias("first_pos"))
    return out.select(*keys, "_v.*", "first_pos")


def new_rows(found: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    return found.join(seen.select(*keys).distinct(), keys, "left_anti")


def selected_rows(rows: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(chosen.select(*keys).distinct(), keys, "left_semi")


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def in_list_order(urls: DataFrame, docs: DataFrame, key: str, pos: str) -> DataFrame:
    """Inner join in the order of the list; of documents with one key, the last by pos."""
    last = docs.groupBy(key).agg(F.max_by(F.struct(*[c for c in docs.columns if c != key]), pos).alias("_d"))
    return urls.join(last, key).select(urls["pos"], key, "_d.*")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of base with the values of changes where the keys meet, then those of changes alone."""
    b, c = base.alias("b"), changes.alias("c")
    on = [F.col(f"b.{k}") == F.col(f"c.{k}") for k in keys]
    hit = F.col(f"c.{keys[0]}").isNotNull()
    return b.join(c, on, "full_outer").select(*[F.coalesce(f"b.{k}", f"c.{k}").alias(k) for k in keys], *[F.when(hit, F.col(f"c.{v}")).otherwise(F.col(f"b.{v}")).alias(v) for v in values])


def patch(base: DataFrame, changes: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Only values that aren't null overwrite; keys that base lacks are ignored."""
    b, c = base.alias("b"), changes.alias("c")
    on = [F.col(f"b.{k}") == F.col(f"c.{k}") for k in keys]
    return b.join(c, on, "left").select(*[F.col(f"b.{k}").alias(k) for k in keys], *[F.coalesce(f"c.{v}", f"b.{v}").alias(v) for v in values])


def insert_absent(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return base.unionByName(rows.join(base.select(*keys), keys, "left_anti").select(*base.columns))


def schema_changes(have, want) -> list[tuple[str, str, str]]:
    """(action, column, type) that bring a schema to another: add what is missing, modify what differs."""
    own = {f.name: f.dataType.simpleString() for f in have}
    out = []
    for f in want:
        kind = f.dataType.simpleString()
        if f.name not in own:
            out.append(("add", f.name, kind))
        elif own[f.name] != kind:
            out.append(("modify", f.name, kind))
    return out


def batch_ids(df: DataFrame, within: list[str], order: list, size: int) -> DataFrame:
    """Batches of `size` rows in each group of `within`, numbered from 0."""
    w = Window.partitionBy(*within).orderBy(*order)
    return df.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def islands(df: DataFrame, within: list[str], order: list, value: str) -> DataFrame:
    """Runs of equal neighbouring values: first and last order value and length."""
    w = Window.partitionBy(*within).orderBy(*order)
    changed = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))) | F.lag(F.lit(1)).over(w).isNull(), F.lit(True))
    numbered = df.withColumn("island", F.sum(changed.cast("int")).over(w))
    return numbered.groupBy(*within, "island", value).agg(F.count("*").alias("n_rows"))


#: Rows that a task takes of a table that is dealt by its size.
ROWS = 1 << 17


def parts_of(df: DataFrame) -> int:
    """Partitions for a table of files: as many as its rows take at ROWS each, so that what a task holds doesn't grow with the table."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS))


def ordered_list(pos: Column | str, value: Column | str) -> Column:
    """Aggregate: values of a group in the order of pos."""
    pos, value = (F.col(c) if isinstance(c, str) else c for c in (pos, value))
    return F.transform(F.array_sort(F.collect_list(F.struct(pos.alias("p"), value.alias("v")))), lambda x: x["v"])
