"""Structured Streaming forms of the scheduled and stateful work: idempotent ingest, late corrections, weekly facts, the
crossing detector and a heartbeat. Windows over event time are extensions of the batch engine."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

CROSSING_STATE = StructType([StructField("below", BooleanType()), StructField("ts", LongType())])
CROSSING_OUT = "watch bigint, id bigint, price bigint"


class Crossings(StatefulProcessor):
    """Per watch: an alert when a price comes to the target or under it and the one before was not; no price, no change.

    Rows of a batch are taken by time; a row older than the newest one seen is late and changes nothing.
    """

    def __init__(self, target: int):
        self.target = target

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("crossing", CROSSING_STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        below, newest = self.state.get() if self.state.exists() else (False, -1)
        batch = pd.concat(list(rows)).sort_values(["micros", "id"])
        out = []
        for r in batch.itertuples():
            if r.micros < newest or pd.isna(r.price):
                continue
            hit = r.price <= self.target
            if hit and not below:
                out.append((key[0], r.id, int(r.price)))
            below, newest = bool(hit), int(r.micros)
        self.state.update((below, newest))
        yield pd.DataFrame(out, columns=["watch", "id", "price"])

    def close(self) -> None:
        pass


def crossings(evaluations: DataFrame, target: int) -> DataFrame:
    """Alerts of a stream of (watch, id, ts, price); state is kept by watch in the state store."""
    own = evaluations.select("watch", "id", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), "price")
    return own.groupBy("watch").transformWithStateInPandas(statefulProcessor=Crossings(target), outputStructType=CROSSING_OUT, outputMode="Append", timeMode="None")


def weekly_facts(offers: DataFrame, ts: str, delay: str = "7 days") -> DataFrame:
    """Lowest price and sightings of an identity by calendar week, closed once the watermark has passed it."""
    # weeks start on Mondays: the epoch was a Thursday
    week = F.window(F.col(ts), "7 days", startTime="4 days")
    return offers.withWatermark(ts, delay).groupBy("identity", week.alias("w")).agg(F.min("price_cents").alias("price_cents"), F.count("*").alias("sightings")).select("identity", F.to_date("w.start").alias("week"), "price_cents", "sightings")


def rolling_rate(runs: DataFrame, ts: str, length: str = "24 hours", slide: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Work done in sliding windows."""
    return runs.withWatermark(ts, delay).groupBy(F.window(F.col(ts), length, slide).alias("w")).agg(F.sum("enriched").alias("enriched")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "enriched")


def sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Runs of a key's events without a pause of ``gap``."""
    return events.withWatermark(ts, delay).groupBy(key, F.session_window(F.col(ts), gap).alias("w")).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


PROFILE_STATE = StructType([StructField("version", LongType()), StructField("tokens", StringType())])
PROFILE_OUT = "product bigint, version bigint, token string, count bigint, week string"


class Profiles(StatefulProcessor):
    """Per product: the tokens that its sightings taught, with count and newest week, the ``cap`` best kept after a batch."""

    def __init__(self, cap: int):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("profile", PROFILE_STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        version, known = self.state.get() if self.state.exists() else (0, "{}")
        tokens = {t: (n, w) for t, (n, w) in json.loads(known).items()}
        # chunk by chunk: what is held is a product's tokens, not its sightings
        for chunk in rows:
            for token, g in chunk.groupby("token"):
                n, w = tokens.get(token, (0, ""))
                tokens[token] = (n + len(g), max(w, g["week"].max()))
        best = sorted(tokens.items(), key=lambda x: (x[1], x[0]), reverse=True)[: self.cap]
        self.state.update((version + 1, json.dumps(dict(best))))
        yield pd.DataFrame([(key[0], version + 1, t, n, w) for t, (n, w) in best], columns=["product", "version", "token", "count", "week"])

    def close(self) -> None:
        pass


def profiles(sightings: DataFrame, cap: int = 24) -> DataFrame:
    """Profiles of a stream of (product, token, week as text): of each product every version, the newest one counts."""
    own = sightings.select("product", "token", "week")
    return own.groupBy("product").transformWithStateInPandas(statefulProcessor=Profiles(cap), outputStructType=PROFILE_OUT, outputMode="Append", timeMode="None")


def newest_profiles(versions: DataFrame) -> DataFrame:
    """The newest version of every product's profile."""
    last = versions.groupBy("product").agg(F.max("version").alias("version"))
    return versions.join(last, ["product", "version"]).drop("version")


def shared_folder(spark: SparkSession) -> str:
    """The folder that a cluster's machines share; a session of one machine that names none, as in tests, gets one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return named or tempfile.mkdtemp(prefix="streams-")


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream, in a session of its own that keeps states of several columns."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    schema = own.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return own.readStream.schema(schema).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")


def completed(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """Runs what a stream holds now into files, exactly once under its checkpoint, and reads them in ``spark``."""
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def ingest(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs the batches that are available through ``merge`` (batch, epoch), exactly once each under its checkpoint.

    A merge that upserts by id and replaces points by (identity, week) makes a repeated file change nothing.
    """
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def silent(last_seen: DataFrame, now, hours: int = 30) -> DataFrame:
    """Schedules without a row for over ``hours``: the batch form of the heartbeat."""
    return last_seen.withColumn("status", F.when(F.col("last") < now - F.expr(f"interval {hours} hours"), "FAIL").otherwise("PASS"))
