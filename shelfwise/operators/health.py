"""Operations: store status, confidence, queues, rates, latencies, schedules, confusion metrics."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed order of store statuses and least coverage of a healthy store.
STATUSES = ("FAIL", "NO_FLYER", "STALE", "LOW_COVERAGE", "OK")
COVERAGE_THRESHOLD = 90.0


def tenth(c: Column) -> Column:
    return F.floor(c * 10 + 0.5) / F.lit(10.0)


def percent(part: Column, total: Column) -> Column:
    return tenth(F.try_divide(part.cast("double") * 100, total.cast("double")))


def latest_runs(runs: DataFrame) -> DataFrame:
    """Newest successful and newest failed run of each store, and whether the newest is a failure."""
    g = runs.where("store is not null").groupBy("store").agg(F.max(F.when(F.col("ok"), F.col("id"))).alias("last_ok"), F.max(F.when(~F.col("ok"), F.col("id"))).alias("last_fail"))
    failing = F.col("last_fail").isNotNull() & (F.col("last_ok").isNull() | (F.col("last_fail") > F.col("last_ok")))
    return g.withColumn("failing", failing)


def status(failing: Column, flyers: Column, fresh: Column, coverage: Column) -> Column:
    """The first status that applies."""
    return F.when(failing, "FAIL").when(flyers == 0, "NO_FLYER").when(~fresh, "STALE").when(F.coalesce(coverage < COVERAGE_THRESHOLD, F.lit(False)), "LOW_COVERAGE").otherwise("OK")


def status_rank(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STATUSES]), c)


def store_rows(stores: DataFrame, brochures: DataFrame, runs: DataFrame, today: Column) -> DataFrame:
    """One row a store: current flyers, freshness, page coverage, last runs and status."""
    f = brochures.groupBy("store").agg(F.count("*").alias("flyers"), F.max((F.col("valid_to").isNull() | (F.col("valid_to") >= today)).cast("int")).alias("fresh"), F.sum("pages").alias("pages"), F.sum(F.least(F.col("pages"), F.lit(7))).alias("linked"))
    j = stores.join(f, "store", "left").join(latest_runs(runs), "store", "left")
    j = j.withColumns({"flyers": F.coalesce("flyers", F.lit(0)), "fresh": F.coalesce("fresh", F.lit(0)) == 1, "failing": F.coalesce("failing", F.lit(False))})
    j = j.withColumn("coverage", F.when(F.col("pages") > 0, percent(F.col("linked"), F.col("pages"))))
    return j.withColumn("status", status(F.col("failing"), F.col("flyers"), F.col("fresh"), F.col("coverage")))


def subsystem_grid(runs: DataFrame, stale_hours: int) -> DataFrame:
    """(subsystem, status, ok_percent) of every subsystem and of all as ``health``.

    A subsystem fails while its newest run is a failure, is stale where its last success is over ``stale_hours`` older
    than the newest run of all, and passes else; ``health`` is the worst of them and the share that passes.
    """
    g = runs.groupBy("subsystem").agg(F.max(F.when(F.col("ok"), F.col("id"))).alias("last_ok"), F.max(F.when(~F.col("ok"), F.col("id"))).alias("last_fail"), F.max(F.when(F.col("ok"), F.col("ts"))).alias("ok_at"), F.avg(F.col("ok").cast("int")).alias("share"), F.max("ts").alias("newest"))
    newest = g.agg(F.max("newest").alias("now"))
    # one row
    g = g.join(F.broadcast(newest), F.lit(True))
    failing = F.col("last_fail").isNotNull() & (F.col("last_ok").isNull() | (F.col("last_fail") > F.col("last_ok")))
    old = F.coalesce(F.col("ok_at") < F.col("now") - F.expr(f"interval {stale_hours} hours"), F.lit(False))
    grid = g.select("subsystem", F.when(failing, "FAIL").when(old, "STALE").otherwise("PASS").alias("status"), tenth(F.col("share") * 100).alias("ok_percent"))
    n = F.count("*")
    passing = F.count_if(F.col("status") == "PASS")
    worst = F.when(passing == n, "PASS").when(F.count_if(F.col("status") == "FAIL") > 0, "FAIL").otherwise("STALE")
    return grid.unionByName(grid.agg(F.lit("health").alias("subsystem"), worst.alias("status"), percent(passing, n).alias("ok_percent")))


def silent_schedules(runs: DataFrame, key: str, ts: str, hours: int) -> DataFrame:
    """Of every schedule whether its newest run is over ``hours`` older than the newest of all."""
    last = runs.groupBy(key).agg(F.max(ts).alias("last"))
    newest = last.agg(F.max("last").alias("now"))
    return last.join(F.broadcast(newest), F.lit(True)).select(key, "last", (F.col("last") < F.col("now") - F.expr(f"interval {hours} hours")).alias("silent"))


def weighted_score(scores: list[tuple[Column, float]]) -> Column:
    """Mean of the scores that are known, with the weights renormalised over them."""
    num = sum((F.coalesce(s * w, F.lit(0.0)) for s, w in scores[1:]), F.coalesce(scores[0][0] * scores[0][1], F.lit(0.0)))
    den = sum((F.when(s.isNotNull(), w).otherwise(0.0) for s, w in scores[1:]), F.when(scores[0][0].isNotNull(), scores[0][1]).otherwise(0.0))
    return F.floor(F.try_divide(num, den) + 0.5)


def one_row(numbers: dict[str, DataFrame]) -> DataFrame:
    """Frames of one number each as the columns of one row: a union and one aggregation, no join."""
    rows = [df.toDF("n").select(F.lit(k).alias("k"), F.col("n").cast("bigint").alias("n")) for k, df in numbers.items()]
    both = reduce(DataFrame.unionByName, rows)
    return both.agg(*[F.max(F.when(F.col("k") == k, F.col("n"))).alias(k) for k in numbers])


def cron_next(expression: str, after: dt.datetime, days: int = 28) -> dt.datetime | None:
    """The next minute (UTC) that a five-field schedule names within ``days``; None if there is none.

    Day of month and day of week are alternatives where both are restricted.
    """

    def field(text: str, lo: int, hi: int) -> set[int]:
        out: set[int] = set()
        for part in text.split(","):
            span, _, step = part.partition("/")
            a, _, b = span.partition("-")
            first, last = (lo, hi) if span == "*" else (int(a), int(b or (hi if step else a)))
            out.update(range(first, last + 1, int(step or 1)))
        return out

    minute, hour, dom, month, dow = expression.split()
    minutes, hours, doms, months = field(minute, 0, 59), field(hour, 0, 23), field(dom, 1, 31), field(month, 1, 12)
    dows = {d % 7 for d in field(dow, 0, 7)}
    start = after.replace(second=0, microsecond=0) + dt.timedelta(minutes=1)
    for n in range(days + 1):
        day = (start + dt.timedelta(days=n)).date()
        own = [day.day in doms, (day.weekday() + 1) % 7 in dows]
        if dom != "*" and dow != "*":
            hit = any(own)
        else:
            hit = all(own)
        if day.month not in months or not hit:
            continue
        for h in sorted(hours):
            for m in sorted(minutes):
                at = dt.datetime(day.year, day.month, day.day, h, m, tzinfo=after.tzinfo)
                if at >= start:
                    return at
    return None
