"""Metrics logs: rotated files read as text, lines parsed by pattern into tables of node runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.replies import literal_dict

#: Fixed value: a line of a node's run time; lines without a section index are none.
NODE = r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}) - \[TIME_STATS\] thread_id: ([a-f0-9\-]+) -+ \[([A-Za-z0-9]+)\[(\d+)\]\.([A-Za-z0-9_]+)\] executed time: (\d+\.\d+) s"
#: Which node runs under which.
TEAM = ("InfoCollectorNode", "ResearchPlanReasoningNode", "SubReporterNode", "SubSourceTracerNode")
COLLECTOR = ("GenerateQueryNode", "InfoRetrievalNode", "SupervisorNode", "SummaryNode", "ProgrammerNode", "GraphEndNode")

#: Lines of a model's and a search tool's call, each with a dict.
MODEL_CALL = r"^[0-9\-:, ]+ - \[TIME_STATS\] thread_id: ([a-f0-9\-]+).*LLM CALL STATISTICS\]: (\{.*\})"
SEARCH_CALL = r"^[0-9\-:, ]+ - \[TIME_STATS\] thread_id: ([a-f0-9\-]+).*SEARCH TOOL STATISTICS\]: (\{.*\})"
MODEL_STATS = "struct<method_name:string,duration:double,input_tokens:long,output_tokens:long,total_tokens:long>"
SEARCH_STATS = "struct<function_name:string,search_engine:string,query:string,duration:double,res_count:long,res_len_list:array<long>>"


def read_logs(spark: SparkSession, pattern: str) -> DataFrame:
    """file_rank, value: lines of all rotations; the highest suffix is the oldest and comes first."""
    lines = spark.read.text(pattern).select("value", F.col("_metadata.file_name").alias("file"))
    return lines.select("value", (-F.coalesce(F.regexp_extract("file", r"\.(\d+)$", 1).try_cast("int"), F.lit(0))).alias("file_rank"))


def node_runs(lines: DataFrame) -> DataFrame:
    """ts, thread_id, node, section_idx, method, duration and parent of each line that tells of a run over 0 s.

    A collector's node has the collector as parent where that runs anywhere in the log, which is read for it, else itself.
    """
    part = lambda i: F.regexp_extract("value", NODE, i)
    out = lines.where(F.col("value").rlike(NODE)).select(
        F.to_timestamp(part(1), "yyyy-MM-dd HH:mm:ss,SSS").alias("ts"), part(2).alias("thread_id"), part(3).alias("node"), part(4).try_cast("int").alias("section_idx"), part(5).alias("method"), part(6).cast("double").alias("duration")
    )
    out = out.where("duration > 0")
    team = out.agg(F.coalesce(F.bool_or(F.col("node") == TEAM[0]), F.lit(False))).scalar()  # a subquery of one row, not a job
    collector = F.when(team, TEAM[0]).otherwise(F.col("node"))
    return out.withColumn("parent", F.when(F.col("node").isin(*TEAM), "EditorTeamNode").when(F.col("node").isin(*COLLECTOR), collector).otherwise("None"))


def report_order(runs: DataFrame) -> list:
    """Section 0 first, then by parent and falling mean and single durations."""
    return [F.col("thread_id"), F.when(F.col("section_idx") == 0, -1).otherwise(1), F.col("parent"), F.desc("mean"), F.desc("duration")]


def mean(name: str, places: int) -> Column:
    """The mean of decimals of 3 places, halves up: it doesn't depend on the order of a sum of doubles."""
    return F.round(F.avg(F.col(name).cast("decimal(18,3)")), places).cast("double")


def summary(runs: DataFrame) -> DataFrame:
    return runs.groupBy("thread_id", "node").agg(mean("duration", 2).alias("mean"), F.count("*").alias("calls"))


def with_summary(runs: DataFrame) -> DataFrame:
    """runs with the mean duration and the number of runs of their thread and node; runs without either get those of the null."""
    means = summary(runs).withColumnsRenamed({"thread_id": "_t", "node": "_n"})
    return runs.join(means, F.col("thread_id").eqNullSafe(F.col("_t")) & F.col("node").eqNullSafe(F.col("_n")), "left").drop("_t", "_n")


def calls(lines: DataFrame, pattern: str, schema: str) -> DataFrame:
    """thread_id and the fields of schema, duration to 3 places, of each line that pattern fits; what is no dict is left out."""
    found = lines.where(F.col("value").rlike(pattern))
    found = found.select(F.regexp_extract("value", pattern, 1).alias("thread_id"), literal_dict(F.regexp_extract("value", pattern, 2), schema).alias("s"))
    return found.where("s is not null").select("thread_id", "s.*").withColumn("duration", F.round(F.coalesce("duration", F.lit(0.0)), 3))


def model_calls(lines: DataFrame) -> DataFrame:
    return calls(lines, MODEL_CALL, MODEL_STATS)


def search_calls(lines: DataFrame) -> DataFrame:
    return calls(lines, SEARCH_CALL, SEARCH_STATS)


def model_summary(runs: DataFrame) -> DataFrame:
    """Calls, mean duration to 2 places and mean tokens to 1 of each thread and method; missing tokens don't count."""
    tokens = [mean(f"{k}_tokens", 1).alias(f"mean_{k}_tokens") for k in ("total", "input", "output")]
    return runs.groupBy("thread_id", "method_name").agg(F.count("duration").alias("calls"), mean("duration", 2).alias("mean"), *tokens)


def search_total(runs: DataFrame) -> DataFrame:
    """One row: all calls and their mean duration to 3 places."""
    return runs.agg(F.count("*").alias("calls"), mean("duration", 3).alias("mean"))


def of_threads(runs: DataFrame, threads: list[str]) -> DataFrame:
    """The runs of the threads; of all where none is named."""
    return runs.where(F.col("thread_id").isin(*threads)) if threads else runs
