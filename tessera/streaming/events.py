"""Event streams: the same functions serve batch and streaming frames where Spark allows it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
MAX_CHARS = 1_000_000


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp_ltz"))


def tumbling(events: DataFrame, width: str) -> DataFrame:
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def suppressed(events: DataFrame, mute: str, resume: str) -> DataFrame:
    """Batch: events of a user after a `mute` event are dropped until the next `resume` event, which is kept."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("event_type").isin(mute, resume), F.col("event_type")), ignorenulls=True).over(w)
    return events.withColumn("_last", last).where(~F.col("_last").eqNullSafe(F.lit(mute)) | (F.col("event_type") == resume)).drop("_last")


def suppressed_stream(events: DataFrame, mute: str, resume: str) -> DataFrame:
    """Stream: the same with one flag of state a user; events of a trigger are taken in time order."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    names = events.columns

    def run(key, frames, state):
        import pandas as pd

        muted = state.get[0] if state.exists else False
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        keep = []
        for kind in rows["event_type"]:
            keep.append(not muted or kind == resume)
            muted = kind == mute or (muted and kind != resume)
        state.update((muted,))
        yield rows[keep][names]

    return events.groupBy("user_id").applyInPandasWithState(run, events.schema, "muted boolean", "append", GroupStateTimeout.NoTimeout)


def framed(messages: DataFrame) -> DataFrame:
    """START, MESSAGE and DONE around each message; only the middle one has the text."""
    phases = F.explode(F.array(*[F.struct(F.lit(p).alias("phase"), (F.col("text") if p == "MESSAGE" else F.lit("")).alias("content")) for p in ("START", "MESSAGE", "DONE")]))
    return messages.select("*", phases.alias("f")).select(*messages.columns, "f.phase", "f.content")


def accumulated(messages: DataFrame) -> DataFrame:
    """A conversation's parts in order as one text of at most MAX_CHARS."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return messages.groupBy("conv_id").agg(F.substr(F.array_join(parts, ""), F.lit(1), F.lit(MAX_CHARS)).alias("content"), F.count("*").alias("parts"))


def tagged(events: DataFrame, section: int) -> DataFrame:
    return events.withColumn("section_idx", F.lit(section))


def results(events: DataFrame, schema: str = "report string, exception_info string") -> DataFrame:
    """The parsed payload of the end agent's messages that aren't markers."""
    end = events.where((F.col("agent") == "end") & ~F.col("content").isin("ALL END", "SECTION END", ""))
    return end.withColumn("result", F.from_json("content", schema))


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append"):
    """Drain what is there into a memory table; restartable from the checkpoint."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
