"""Streams over files of evaluations and offers, driven to completion."""

import datetime as dt

from pyspark.sql import functions as F

from shelfwise.operators import watches
from shelfwise.operators.sinks import replace_latest
from shelfwise.streaming import jobs

START = dt.datetime(2024, 1, 1)


def minute(n):
    return START + dt.timedelta(minutes=n)


def run(query):
    query.processAllAvailable()
    query.stop()


def test_crossings_across_batches(spark, tmp_path):
    prices = [8, 7, None, 9, 12, None, 9, 11, 11, 5]
    rows = [(w, i, minute(i), p) for w in (1, 2) for i, p in enumerate(prices)]
    schema = "watch long, id long, ts timestamp, price long"
    for k, part in enumerate((rows[:4] + rows[10:17], rows[4:10] + rows[17:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(jobs.crossings(stream, 10).writeStream.format("memory").queryName("alerts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start())
    got = sorted((r.watch, r.id) for r in spark.table("alerts").collect())
    batch = watches.crossings(spark.createDataFrame(rows, schema), "watch", ["ts", "id"], "price", F.lit(10)).collect()
    assert got == sorted((r.watch, r.id) for r in batch) == [(w, i) for w in (1, 2) for i in (0, 6, 9)]


def test_idempotent_ingest(spark, tmp_path):
    schema = "identity string, week string, price long, v long"
    store = {"t": spark.createDataFrame([], schema)}

    def merge(batch, epoch):
        rows = replace_latest(store["t"], batch, ["identity", "week"], F.desc("v")).collect()
        store["t"] = spark.createDataFrame(rows, schema)

    first = [("a", "w1", 5, 1), ("a", "w2", 6, 1)]
    for k, rows in enumerate((first, first, [("a", "w1", 4, 2)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        jobs.ingest(stream, merge, str(tmp_path / "c")).awaitTermination()
        got = sorted(map(tuple, store["t"].collect()))
        assert got == (first if k < 2 else [("a", "w1", 4, 2), ("a", "w2", 6, 1)])


def test_weekly_facts_and_windows(spark, tmp_path):
    schema = "identity string, ts timestamp, price_cents long, enriched long"
    rows = [("a", dt.datetime(2024, 1, 1, 5), 5, 1), ("a", dt.datetime(2024, 1, 7, 23), 3, 2), ("a", dt.datetime(2024, 1, 8), 9, 3), ("b", dt.datetime(2024, 3, 1), 1, 4)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    run(jobs.weekly_facts(stream, "ts").writeStream.format("memory").queryName("weeks").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start())
    assert sorted(map(tuple, spark.table("weeks").collect())) == [("a", dt.date(2024, 1, 1), 3, 2), ("a", dt.date(2024, 1, 8), 9, 1)]
    batch = spark.read.schema(schema).parquet(str(tmp_path / "in"))
    assert jobs.rolling_rate(batch, "ts").agg(F.max("enriched")).first()[0] == 5
    assert jobs.sessions(batch, "identity", "ts", "25 hours").count() == 3
    late = jobs.silent(batch.groupBy("identity").agg(F.max("ts").alias("last")), F.lit("2024-01-09 07:00:00").cast("timestamp"))
    assert {r.identity: r.status for r in late.collect()} == {"a": "FAIL", "b": "PASS"}
