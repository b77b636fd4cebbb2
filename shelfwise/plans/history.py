"""Queries over price history, watches and crossings."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.catalog import query
from shelfwise.operators import history as H
from shelfwise.operators import watches as Wt
from shelfwise.sources.tables import TODAY, cents, day



def now():
    return day(TODAY)



@query("HIS-01_derive_identity", "SELECT id, CASE WHEN len(list_distinct(string_split(search_text, ' '))) >= 2 THEN concat_ws('|', store, region, search_text, size) END AS identity_key FROM offers")
def derive_identity(t):
    enough = F.size(F.array_distinct(F.split("search_text", " "))) >= 2
    return t.offers.select("id", F.when(enough, F.concat_ws("|", "store", "region", "search_text", F.col("size").cast("string"))).alias("identity_key"))


@query("AGG-14_weekly_argmin", "SELECT identity, week, offer_id, price_cents FROM points")
def weekly(t):
    return t.points.select("identity", "week", "offer_id", "price_cents")


@query("WIN-08_change_series", "SELECT identity, week, price_cents, before FROM steps WHERE before IS NULL OR before <> price_cents")
def change_series(t):
    return H.changes(t.points).where(H.is_change()).select("identity", "week", "price_cents", "before")


@query("WIN-09_weeks_seen", "SELECT identity, count(DISTINCT valid_from) AS weeks_seen FROM offers GROUP BY identity")
def weeks_seen(t):
    return t.offers.groupBy("identity").agg(F.countDistinct("valid_from").alias("weeks_seen"))


@query("HIS-02_record_history", "SELECT identity, first_seen, last_seen, weeks_seen, points, min_cents, max_cents, last_cents, last_valid_to FROM identities")
def record(t):
    return t.identities.select("identity", "first_seen", "last_seen", "weeks_seen", "points", "min_cents", "max_cents", "last_cents", "last_valid_to")


@query("AGG-06_history_aggregate", "SELECT identity, min(price_cents) AS lo, max(price_cents) AS hi, count(*) AS n FROM points GROUP BY identity")
def history_aggregate(t):
    return t.points.groupBy("identity").agg(F.min("price_cents").alias("lo"), F.max("price_cents").alias("hi"), F.count("*").alias("n"))


@query("WIN-01_latest_per_store", f"SELECT name, size, store, identity, last_cents FROM identities QUALIFY row_number() OVER (PARTITION BY name, size, store ORDER BY (last_valid_to >= DATE '{TODAY}')::INTEGER DESC, last_seen DESC, last_cents, identity) = 1")
def latest(t):
    return H.latest_per_store(t.identities, ["name", "size"], now()).select("name", "size", "store", "identity", "last_cents")


@query("WIN-02_latest_sighting_per_store", f"SELECT product_id, store, offer_id, price_cents FROM sightings QUALIFY row_number() OVER (PARTITION BY product_id, store ORDER BY (week + 6 >= DATE '{TODAY}')::INTEGER DESC, week DESC, price_cents, offer_id) = 1")
def latest_sighting(t):
    valid = (F.date_add("week", 6) >= now()).cast("int")
    return H.first_by(t.sightings, ["product_id", "store"], valid.desc(), F.desc("week"), "price_cents", "offer_id").select("product_id", "store", "offer_id", "price_cents")


@query("WIN-03_lowest_ever", "SELECT name, size, price_cents, week, store FROM points QUALIFY row_number() OVER (PARTITION BY name, size ORDER BY price_cents, week, identity) = 1")
def lowest(t):
    return H.lowest_ever(t.points, ["name", "size"]).select("name", "size", "price_cents", "week", "store")


TREND = """, weekly AS (SELECT name, size, week, min(price_cents) AS low FROM points GROUP BY ALL),
  ranked AS (SELECT *, lead(low) OVER w AS was, row_number() OVER w AS n FROM weekly WINDOW w AS (PARTITION BY name, size ORDER BY week DESC)),
  trends AS (SELECT name, size, week AS last_week, low, was, CASE WHEN low > was THEN 'up' WHEN low < was THEN 'down' WHEN low = was THEN 'flat' END AS trend FROM ranked WHERE n = 1)"""


@query("WIN-04_trend", f"{TREND} SELECT * FROM trends")
def trend(t):
    return H.trend(t.points, ["name", "size"])


SUMMARY = f"""{TREND}, best AS (SELECT * FROM points QUALIFY row_number() OVER (PARTITION BY name, size ORDER BY price_cents, week, store) = 1),
  totals AS (SELECT name, size, max(price_cents) AS highest_cents, count(DISTINCT week) AS weeks, count(DISTINCT store) AS stores, count(*) AS observations FROM points GROUP BY ALL),
  summary AS (SELECT t.name, t.size, b.price_cents AS lowest_cents, b.week AS lowest_week, b.store AS lowest_store, highest_cents, weeks, stores, observations, r.trend
    FROM totals t JOIN best b ON t.name = b.name AND t.size = b.size JOIN trends r ON t.name = r.name AND t.size = r.size)"""


@query("AGG-13_price_summary", f"{SUMMARY} SELECT * FROM summary")
def price_summary(t):
    return H.price_summary(t.points, ["name", "size"])


@query("HIS-03_query_prices", f"{SUMMARY} SELECT * FROM summary WHERE list_contains(string_split(name, ' '), 'ring') AND list_contains(string_split(name, ' '), 'red')")
def query_prices(t):
    from shelfwise.functions import text as T

    q = T.Query.of("red ring")
    # an identity has one name: parts are filtered before offers are joined and weeks are folded
    named = lambda p: T.with_words(p, "p_name", "_x").where(T.name_relevance(q, F.col("_x_text"), F.col("_x_words")) >= 100).drop("_x_text", "_x_words")
    return H.price_summary(H.weekly_points(t.offers_of(t.read("lineitem"), named(t.read("part")))), ["name", "size"])


@query("RANK-07_variant_order", f"{SUMMARY} SELECT name, size, observations FROM summary")
def variant_order(t):
    return H.price_summary(t.points, ["name", "size"]).orderBy(F.desc("observations"), "size", "name").select("name", "size", "observations")


FOLDED = "SELECT coalesce(p.merged_into, s.product_id) AS product_id, s.week, s.store, s.price_cents, s.offer_id FROM sightings s LEFT JOIN products p ON s.product_id = p.id"


def folded(t):
    p = t.products.select(F.col("id").alias("product_id"), "merged_into")
    return t.sightings.join(p, "product_id", "left").withColumn("product_id", F.coalesce("merged_into", "product_id"))


@query("HIS-04_registry_prices", f"SELECT product_id, min(price_cents) AS lowest_cents, max(price_cents) AS highest_cents, count(DISTINCT week) AS weeks, count(DISTINCT store) AS stores, count(*) AS observations FROM ({FOLDED}) GROUP BY product_id")
def registry_prices(t):
    return folded(t).groupBy("product_id").agg(F.min("price_cents").alias("lowest_cents"), F.max("price_cents").alias("highest_cents"), F.countDistinct("week").alias("weeks"), F.countDistinct("store").alias("stores"), F.count("*").alias("observations"))


@query("HIS-05_registry_first", f"""SELECT name, coalesce(r.low, i.low) AS low, r.low IS NOT NULL AS from_registry FROM (SELECT name, min(min_cents) AS low FROM identities GROUP BY name) i
  LEFT JOIN (SELECT p.display_name, min(s.price_cents) AS low FROM sightings s JOIN products p ON s.product_id = p.id WHERE p.status = 'active' AND s.match_band = 'auto' GROUP BY 1) r ON i.name = r.display_name""")
def registry_first(t):
    p = t.products.where("status = 'active'").select(F.col("id").alias("product_id"), F.col("display_name").alias("name"))
    r = t.sightings.where("match_band = 'auto'").join(p, "product_id").groupBy("name").agg(F.min("price_cents").alias("r"))
    i = t.identities.groupBy("name").agg(F.min("min_cents").alias("i"))
    return i.join(r, "name", "left").select("name", F.coalesce("r", "i").alias("low"), F.col("r").isNotNull().alias("from_registry"))


@query("JON-10_best_current_price", f"SELECT product_id, offer_id, price_cents FROM ({FOLDED}) WHERE week + 6 >= DATE '{TODAY}' QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY price_cents, offer_id) = 1")
def best_current(t):
    g = folded(t).where(F.date_add("week", 6) >= now()).groupBy("product_id").agg(F.min(F.struct("price_cents", "offer_id")).alias("b"))
    return g.select("product_id", "b.offer_id", "b.price_cents")


@query("JON-19_prior_state", "SELECT p.identity, p.week, p.price_cents, i.last_cents, p.price_cents <> i.last_cents AS moved FROM points p LEFT JOIN (SELECT * FROM identities WHERE weeks_seen > 1) i ON p.identity = i.identity")
def prior_state(t):
    known = t.identities.where("weeks_seen > 1").select("identity", "last_cents")
    return t.points.join(known, "identity", "left").select("identity", "week", "price_cents", "last_cents", (F.col("price_cents") != F.col("last_cents")).alias("moved"))


EVALS = "SELECT event_id AS id, user_id AS watch, ts, CASE WHEN event_type <> 'error' THEN CAST(floor(value * 100 + 0.5) AS BIGINT) END AS price FROM events"


def evaluations(t):
    e = t.read("events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("watch"), "ts", F.when(F.col("event_type") != "error", cents(F.col("value"))).alias("price"))


@query("WIN-10_crossing_detector", f"SELECT id, watch, price FROM (SELECT *, lag(price <= 3000) OVER (PARTITION BY watch ORDER BY ts, id) AS before FROM ({EVALS}) WHERE price IS NOT NULL) WHERE price <= 3000 AND NOT coalesce(before, FALSE)")
def crossing(t):
    return Wt.crossings(evaluations(t), "watch", ["ts", "id"], "price", F.lit(3000)).select("id", "watch", "price")


@query("JON-11_alerts_of_profile", "SELECT event_id, user_id FROM events SEMI JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'HOUSEHOLD') w ON user_id = c_custkey WHERE event_type = 'purchase'")
def alerts_of_profile(t):
    w = t.read("customer").where("c_mktsegment = 'HOUSEHOLD'").select(F.col("c_custkey").alias("user_id"))
    return t.read("events").where("event_type = 'purchase'").join(w, "user_id", "left_semi").select("event_id", "user_id")
