"""Lives of sessions: a stream with state and timers equals the batch form."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.plans import team_queries
from tessera.streaming import lifecycles as L

HOUR = 3_600_000


def test_steps():
    at = L.Lives(100)
    for k in range(11):
        at.step("start", k, k, k)
    assert at.out[-1] == (0, 10, 10, "evicted") and len(at.live) == 10
    at.out.clear()
    for i, (kind, s) in enumerate([("wait", 5), ("resume", 6), ("resume", 5), ("done", 5), ("cancel", 5), ("wait", 6), ("done", 6), ("start", 7), ("cancel", 7)]):
        at.step(kind, s, 20 + i, 20 + i)
    assert [o for *_, o in at.out] == ["waiting", "ignored", "resumed", "done", "ignored", "waiting", "ignored", "ignored", "cancelled"]
    at.step("resume", 6, 125, 99)
    assert at.out[-2:] == [(6, 125, None, "expired"), (6, 125, 99, "ignored")]


def test_stream_equals_batch(spark, sf_small, tmp_path):
    def t(name):
        return spark.read.parquet(f"{sf_small}/{name}.parquet")

    events = team_queries.lifecycle_events(t).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = events.orderBy("ts", "event_id").toPandas()
    parts = [rows.iloc[i : i + 301] for i in range(0, len(rows), 301)]
    for i, p in enumerate(parts):
        spark.createDataFrame(p, events.schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i:03d}")
    store = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        q = L.lives_stream(stream, 150 * HOUR).writeStream.format("memory").queryName("lives").option("checkpointLocation", f"{tmp_path}/at").outputMode("append").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    finally:
        if store:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", store)
        else:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = Counter(tuple(r) for r in spark.table("lives").collect())
    end = L.session_events(events).agg(F.max("ms").alias("ms"))
    want = Counter(tuple(r) for r in L.lives(events, 150 * HOUR, end).collect())
    assert {"expired", "evicted", "cancelled", "resumed"} <= {k[4] for k in want}, Counter(k[4] for k in want.elements())
    assert got == want


def test_no_events(spark):
    none = spark.createDataFrame([], "space long, session long, kind string, event_id long, ts timestamp")
    assert L.lives(none, 1).count() == 0


@pytest.mark.parametrize("until", [False, True])
def test_what_still_waits_at_the_end(spark, until):
    rows = spark.createDataFrame([(1, 7, "start", 1, 0), (1, 7, "wait", 2, 10)], "space long, session long, kind string, event_id long, at long")
    events = rows.withColumn("ts", F.timestamp_millis("at")).drop("at")
    got = L.lives(events, 100, spark.createDataFrame([(110,)], "ms long") if until else None)
    assert Counter(r.outcome for r in got.collect()) == Counter(["started", "waiting", *["expired"] * until])
