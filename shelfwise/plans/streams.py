"""Queries that run as streams over the files of a table, to completion."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shelfwise.catalog import query
from shelfwise.plans.history import EVALS
from shelfwise.sources.tables import cents
from shelfwise.streaming import jobs


@query("STREAM-01_crossing_detector", f"SELECT id, watch, price FROM (SELECT *, lag(price <= 3000) OVER (PARTITION BY watch ORDER BY ts, id) AS before FROM ({EVALS}) WHERE price IS NOT NULL) WHERE price <= 3000 AND NOT coalesce(before, FALSE)")
def crossing_stream(t):
    e = jobs.stream_of(t.spark, t.sf_dir, "events")
    price = F.when(F.col("event_type") != "error", cents(F.col("value")))
    rows = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("watch"), "ts", price.alias("price"))
    return jobs.completed(t.spark, jobs.crossings(rows, 3000)).select("id", "watch", "price")


@query("STREAM-02_weekly_facts", "SELECT * FROM (SELECT user_id AS identity, CAST(date_trunc('week', ts) AS DATE) AS week, min(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS price_cents, count(*) AS sightings FROM events GROUP BY 1, 2) WHERE week + 7 <= (SELECT max(ts) - INTERVAL 7 DAY FROM events)")
def weekly_stream(t):
    e = jobs.stream_of(t.spark, t.sf_dir, "events")
    rows = e.select(F.col("user_id").alias("identity"), F.col("ts").cast("timestamp").alias("ts"), cents(F.col("value")).alias("price_cents"))
    return jobs.completed(t.spark, jobs.weekly_facts(rows, "ts"))


@query("STREAM-03_rolling_rate", """SELECT start, start + INTERVAL 24 HOUR AS "end", sum(k)::BIGINT AS enriched FROM (SELECT date_trunc('hour', ts::TIMESTAMP) - to_hours(h::INTEGER) AS start, json_extract_string(props, '$.k')::BIGINT AS k FROM events, range(0, 24) r(h)) GROUP BY 1 HAVING start + INTERVAL 24 HOUR <= (SELECT max(ts)::TIMESTAMP - INTERVAL 1 HOUR FROM events)""")
def rolling_stream(t):
    e = jobs.stream_of(t.spark, t.sf_dir, "events")
    rows = e.select(F.col("ts").cast("timestamp").alias("ts"), F.get_json_object("props", "$.k").cast("bigint").alias("enriched"))
    out = jobs.completed(t.spark, jobs.rolling_rate(rows, "ts"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "enriched")


@query("STREAM-04_product_profile", "SELECT user_id AS product, event_type AS token, count(*) AS count, max(strftime(ts, '%Y-%m-%d')) AS week FROM events GROUP BY 1, 2")
def profile_stream(t):
    e = jobs.stream_of(t.spark, t.sf_dir, "events")
    rows = e.select(F.col("user_id").alias("product"), F.col("event_type").alias("token"), F.date_format("ts", "yyyy-MM-dd").alias("week"))
    return jobs.newest_profiles(jobs.completed(t.spark, jobs.profiles(rows)))


@query("STREAM-05_repeated_ingest", "SELECT user_id AS identity, CAST(ts AS DATE) AS week, min(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS price_cents, count(*) AS sightings FROM events GROUP BY 1, 2")
def repeated_ingest(t):
    """The same files are ingested twice under one checkpoint and once more under another: points are replaced, not added."""
    from shelfwise.operators.sinks import overwrite

    folder = jobs.shared_folder(t.spark)
    path = f"{folder}/ingest-{uuid.uuid4().hex}"
    schema = "identity bigint, week date, price_cents bigint, id bigint"
    table = {"at": overwrite(t.spark.createDataFrame([], schema), f"{path}/points")}

    def merge(batch, epoch):
        # one row an event, whatever is delivered again
        old = batch.sparkSession.read.schema(schema).parquet(table["at"])
        table["at"] = overwrite(old.unionByName(batch).dropDuplicates(["id"]), f"{path}/points")

    for state in ("a", "a", "b"):
        e = jobs.stream_of(t.spark, t.sf_dir, "events")
        rows = e.select(F.col("user_id").alias("identity"), F.to_date("ts").alias("week"), cents(F.col("value")).alias("price_cents"), F.col("event_id").alias("id"))
        jobs.ingest(rows, merge, f"{path}/{state}").awaitTermination()
    points = t.spark.read.schema(schema).parquet(table["at"])
    return points.groupBy("identity", "week").agg(F.min("price_cents").alias("price_cents"), F.count("*").alias("sightings"))


@query("STREAM-06_heartbeat", "SELECT event_type AS action, max(ts)::TIMESTAMP AS last, CASE WHEN max(ts)::TIMESTAMP < TIMESTAMP '2024-01-31 12:00:00' - INTERVAL 30 HOUR THEN 'FAIL' ELSE 'PASS' END AS status FROM events WHERE event_type <> 'error' OR ts < TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1")
def heartbeat(t):
    kept = t.runs.where((F.col("action") != "error") | (F.col("ts").cast("timestamp_ntz") < F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")))
    last = kept.groupBy("action").agg(F.max(F.col("ts").cast("timestamp_ntz")).alias("last"))
    return jobs.silent(last, F.lit("2024-01-31 12:00:00").cast("timestamp_ntz"))
