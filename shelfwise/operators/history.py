"""Price history: weekly points, identity summaries, latest and lowest prices, trends, change-only series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each group of ``keys`` in a stated order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def weekly_points(offers: DataFrame) -> DataFrame:
    """One price per identity and week: the lowest, of equals the one valid longest, then the smallest id.

    A minimum of structs: it combines before the shuffle, so a week full of one identity does not meet in one task.
    Longest validity comes first by ordering on the days before a far day.
    """
    late = F.datediff(F.lit("9999-12-31").cast("date"), F.coalesce("valid_to", F.lit("0001-01-01").cast("date")))
    best = F.min(F.struct("price_cents", late.alias("late"), F.col("id").alias("offer_id"), "store", "region", "name", "size", "old_cents", "valid_to"))
    g = offers.groupBy("identity", F.col("valid_from").alias("week")).agg(best.alias("b"))
    return g.select("identity", "week", *[F.col(f"b.{c}").alias(c) for c in ("offer_id", "store", "region", "name", "size", "price_cents", "old_cents", "valid_to")])


def changes(points: DataFrame) -> DataFrame:
    """``points`` with ``before``: the price of the identity's observed week before; the series keeps first sightings and changes."""
    return points.withColumn("before", F.lag("price_cents").over(W.partitionBy("identity").orderBy("week")))


def is_change() -> Column:
    return F.col("before").isNull() | (F.col("before") != F.col("price_cents"))


def identity_summary(points: DataFrame) -> DataFrame:
    """First and last week, weeks seen, points kept, lowest, highest and last price of every identity."""
    return (
        changes(points)
        .groupBy("identity")
        .agg(
            *[F.first(c).alias(c) for c in ("store", "region", "name", "size")],
            F.min("week").alias("first_seen"),
            F.max("week").alias("last_seen"),
            F.count("*").alias("weeks_seen"),
            F.sum(is_change().cast("bigint")).alias("points"),
            F.min("price_cents").alias("min_cents"),
            F.max("price_cents").alias("max_cents"),
            F.max_by("price_cents", "week").alias("last_cents"),
            F.max_by("valid_to", "week").alias("last_valid_to"),
        )
    )


def latest_per_store(identities: DataFrame, bucket: list[str], today: Column) -> DataFrame:
    """One identity per bucket and store: still valid first, then seen last, then cheapest, then by key."""
    current = (F.col("last_valid_to") >= today).cast("int")
    return first_by(identities, [*bucket, "store"], F.coalesce(current, F.lit(0)).desc(), F.desc("last_seen"), "last_cents", "identity")


def lowest_ever(points: DataFrame, bucket: list[str]) -> DataFrame:
    """The lowest price of a bucket, of equals the earliest observation."""
    return first_by(points, bucket, "price_cents", "week", "identity")


def trend(points: DataFrame, bucket: list[str]) -> DataFrame:
    """up, down or flat from the lowest price of the last observed week against that of the week before; null for one week."""
    weekly = points.groupBy(*bucket, "week").agg(F.min("price_cents").alias("low"))
    w = W.partitionBy(*bucket).orderBy(F.desc("week"))
    last = weekly.withColumns({"was": F.lead("low").over(w), "_n": F.row_number().over(w)}).where("_n = 1")
    way = F.when(F.col("low") > F.col("was"), "up").when(F.col("low") < F.col("was"), "down").when(F.col("low") == F.col("was"), "flat")
    return last.select(*bucket, F.col("week").alias("last_week"), "low", "was", way.alias("trend"))


def price_summary(points: DataFrame, bucket: list[str]) -> DataFrame:
    """Lowest and highest with their weeks, weeks, stores, observations and trend of each bucket.

    Two aggregations: by bucket and week, then by bucket, whose lists are as long as its weeks and stores.
    """
    weekly = points.groupBy(*bucket, "week").agg(
        F.min(F.struct("price_cents", "week", "store")).alias("lo"),
        F.max("price_cents").alias("hi"),
        F.count("*").alias("n"),
        F.collect_set("store").alias("stores"),
    )
    g = weekly.groupBy(*bucket).agg(
        F.min("lo").alias("lo"),
        F.max("hi").alias("highest_cents"),
        F.count("*").alias("weeks"),
        F.size(F.array_distinct(F.flatten(F.collect_list("stores")))).cast("bigint").alias("stores"),
        F.sum("n").alias("observations"),
        F.slice(F.sort_array(F.collect_list(F.struct("week", F.col("lo.price_cents").alias("low"))), False), 1, 2).alias("last"),
    )
    low, was = F.get("last", 0)["low"], F.get("last", 1)["low"]
    way = F.when(low > was, "up").when(low < was, "down").when(low == was, "flat")
    return g.select(*bucket, F.col("lo.price_cents").alias("lowest_cents"), F.col("lo.week").alias("lowest_week"), F.col("lo.store").alias("lowest_store"), "highest_cents", "weeks", "stores", "observations", way.alias("trend"))
