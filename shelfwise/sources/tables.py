"""Domain tables derived from the star schema, column by column the same in Spark and in ``ORACLE_TABLES`` (DuckDB)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The day that queries take as today; never the clock's.
TODAY = "1998-06-17"


def cents(c):
    """Half-up cents of a double, as a long: identical in all engines, and exact to sum."""
    return F.floor(c * 100 + 0.5).cast("bigint")


def day(s: str):
    return F.lit(s).cast("date")


class Tables:
    """The tables of one data folder; each is built from pruned scans when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        # cached properties that fail would end up here
        if name.startswith("_") or name in type(self).__dict__:
            raise AttributeError(name)
        return self.read(name)

    @cached_property
    def stores(self) -> DataFrame:
        supplier, nation, region = self.read("supplier"), self.read("nation"), self.read("region")
        return (
            supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
            .join(region, nation.n_regionkey == region.r_regionkey)
            .select(F.col("s_suppkey").alias("store_id"), F.col("s_name").alias("store"), F.col("r_name").alias("region"))
        )

    @cached_property
    def offers(self) -> DataFrame:
        return self.offers_of(self.read("lineitem"))

    @cached_property
    def current_offers(self) -> DataFrame:
        """Offers valid today or later. Validity ends with the week of the shipping date, so a bound on that date says
        the same, and it reaches the scan."""
        monday = F.date_trunc("week", day(TODAY))
        kind = self.read("lineitem").schema["l_shipdate"].dataType
        return self.offers_of(self.read("lineitem").where(F.col("l_shipdate") >= monday.cast(kind)))

    def offers_of(self, li: DataFrame, part: DataFrame | None = None) -> DataFrame:
        part = self.read("part") if part is None else part
        old = li.l_extendedprice / li.l_quantity
        j = li.join(part, li.l_partkey == part.p_partkey).join(self.stores, li.l_suppkey == F.col("store_id"))
        week = F.date_trunc("week", "l_shipdate").cast("date")
        first = ["store_id", "l_partkey", "l_orderkey", "l_linenumber"]
        base = j.select(
            F.concat_ws(":", *[F.col(c).cast("string") for c in first], F.date_format("l_shipdate", "yyyyMMdd"), cents(F.col("l_extendedprice")).cast("string")).alias("id"),
            "store",
            "region",
            F.concat(F.lit("src-"), "l_returnflag").alias("source"),
            F.col("l_orderkey").alias("flyer_ref"),
            F.col("l_linenumber").alias("line"),
            F.col("p_name").alias("name"),
            F.when(F.col("l_linenumber") != 7, F.col("p_type")).alias("category"),
            F.col("p_brand").alias("brand"),
            F.col("p_size").alias("size"),
            cents(old * (1 - F.col("l_discount"))).alias("price_cents"),
            cents(old).alias("old_cents"),
            week.alias("valid_from"),
            F.when(F.col("l_linestatus").isNotNull(), F.date_add(week, 6)).alias("valid_to"),
            F.to_date("l_shipdate").alias("detected_at"),
            F.col("l_tax").alias("tax"),
            F.col("l_returnflag").alias("flag"),
        )
        return base.withColumns(
            {
                "old_cents": F.when(F.col("old_cents") > F.col("price_cents"), F.col("old_cents")),
                "identity": F.concat_ws("|", "store", "region", "name", F.col("size").cast("string")),
                "product_id": F.concat_ws("|", F.lit("pr"), "name", "brand"),
                "search_text": F.concat_ws(" ", "name", F.lower("brand")),
            }
        )

    @cached_property
    def enrichments(self) -> DataFrame:
        """Readings of some offers: lines 1 to 5; line 4 has no name, corroboration grows with the line."""
        o = self.offers.where("line <= 5")
        return o.select(
            "id",
            F.when(F.col("line") != 4, F.upper("name")).alias("e_name"),
            F.col("brand").alias("e_brand"),
            (F.col("line") * 0.15).alias("corroboration"),
            F.when(F.col("flag") == "A", "minted").when(F.col("flag") == "R", "declined").alias("mint_verdict"),
        )

    @cached_property
    def points(self) -> DataFrame:
        """Prices of an identity by week: the lowest, then the longest validity, then the id."""
        from shelfwise.operators.history import weekly_points

        return weekly_points(self.offers)

    @cached_property
    def identities(self) -> DataFrame:
        from shelfwise.operators.history import identity_summary

        return identity_summary(self.points)

    @cached_property
    def products(self) -> DataFrame:
        g = self.read("part").groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("k"), F.count("*").alias("sightings"), F.min("p_size").alias("size_each"), F.max("p_size").alias("size_max"))
        status = F.when(F.col("k") % 11 == 0, "merged").when(F.col("k") % 5 == 0, "dormant").otherwise("active")
        g = g.withColumn("status", status)
        alive = g.where("status <> 'merged'").groupBy("p_name").agg(F.min("p_brand").alias("b"))
        g = g.join(alive, "p_name", "left")
        into = F.when((F.col("status") == "merged") & F.col("b").isNotNull(), F.concat_ws("|", F.lit("pr"), "p_name", "b"))
        return g.select(
            F.concat_ws("|", F.lit("pr"), "p_name", "p_brand").alias("id"),
            F.col("p_name").alias("display_name"),
            F.col("p_brand").alias("brand_slug"),
            "status",
            into.alias("merged_into"),
            "sightings",
            "size_each",
            "size_max",
            F.when(F.col("k") % 13 == 0, "size-conflict").alias("review_flag"),
            F.array_distinct(F.concat(F.split("p_name", " "), F.array(F.lower("p_brand")))).alias("tokens"),
        )

    @cached_property
    def sightings(self) -> DataFrame:
        band = F.when(F.col("flag") == "A", "auto").when(F.col("flag") == "N", "created").otherwise("review")
        return self.offers.select(F.col("id").alias("offer_id"), "product_id", band.alias("match_band"), "store", "region", F.col("valid_from").alias("week"), "price_cents", "old_cents", "detected_at", "line")

    @cached_property
    def runs(self) -> DataFrame:
        e = self.read("events")
        return e.select(
            F.col("event_id").alias("id"),
            "ts",
            F.col("event_type").alias("action"),
            F.col("user_id").alias("store"),
            (F.col("event_type") != "error").alias("ok"),
            cents(F.col("value")).alias("elapsed_cents"),
            F.get_json_object("props", "$.k").cast("bigint").alias("enriched"),
        )

    @cached_property
    def brochures(self) -> DataFrame:
        o = self.read("orders")
        week = F.date_trunc("week", "o_orderdate").cast("date")
        return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("store"), week.alias("valid_from"), F.date_add(week, 6).alias("valid_to"), F.concat(F.lit("Flyer "), F.substring("o_orderpriority", 1, 1)).alias("title"), F.pmod(F.col("o_orderkey"), F.lit(9)).cast("int").alias("pages"), F.to_date("o_orderdate").alias("detected_at"))


ORACLE_TABLES = f"""
WITH today AS (SELECT DATE '{TODAY}' AS d),
stores AS (SELECT s_suppkey AS store_id, s_name AS store, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
offers0 AS (
  SELECT concat_ws(':', s.store_id, l_partkey, l_orderkey, l_linenumber, strftime(l_shipdate, '%Y%m%d'), CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS id,
    s.store, s.region, 'src-' || l_returnflag AS source, l_orderkey AS flyer_ref, l_linenumber AS line, p_name AS name,
    CASE WHEN l_linenumber <> 7 THEN p_type END AS category, p_brand AS brand, p_size AS size,
    CAST(floor(l_extendedprice / l_quantity * (1 - l_discount) * 100 + 0.5) AS BIGINT) AS price_cents,
    CAST(floor(l_extendedprice / l_quantity * 100 + 0.5) AS BIGINT) AS old0,
    CAST(date_trunc('week', l_shipdate) AS DATE) AS valid_from, CAST(date_trunc('week', l_shipdate) AS DATE) + 6 AS valid_to,
    CAST(l_shipdate AS DATE) AS detected_at, l_tax AS tax, l_returnflag AS flag
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN stores s ON l_suppkey = s.store_id),
offers AS (
  SELECT * EXCLUDE (old0), CASE WHEN old0 > price_cents THEN old0 END AS old_cents,
    concat_ws('|', store, region, name, size) AS identity, concat_ws('|', 'pr', name, brand) AS product_id, concat_ws(' ', name, lower(brand)) AS search_text
  FROM offers0),
enrichments AS (
  SELECT id, CASE WHEN line <> 4 THEN upper(name) END AS e_name, brand AS e_brand, line * 0.15::DOUBLE AS corroboration,
    CASE flag WHEN 'A' THEN 'minted' WHEN 'R' THEN 'declined' END AS mint_verdict
  FROM offers WHERE line <= 5),
points AS (
  SELECT identity, valid_from AS week, id AS offer_id, store, region, name, size, price_cents, old_cents, valid_to FROM offers
  QUALIFY row_number() OVER (PARTITION BY identity, valid_from ORDER BY price_cents, valid_to DESC, id) = 1),
steps AS (SELECT *, lag(price_cents) OVER (PARTITION BY identity ORDER BY week) AS before FROM points),
identities AS (
  SELECT identity, any_value(store) AS store, any_value(region) AS region, any_value(name) AS name, any_value(size) AS size,
    min(week) AS first_seen, max(week) AS last_seen, count(*) AS weeks_seen, sum(CASE WHEN before IS NULL OR before <> price_cents THEN 1 ELSE 0 END)::BIGINT AS points,
    min(price_cents) AS min_cents, max(price_cents) AS max_cents, arg_max(price_cents, week) AS last_cents, arg_max(valid_to, week) AS last_valid_to
  FROM steps GROUP BY identity),
products0 AS (
  SELECT p_name, p_brand, min(p_partkey) AS k, count(*) AS sightings, min(p_size) AS size_each, max(p_size) AS size_max,
    CASE WHEN min(p_partkey) % 11 = 0 THEN 'merged' WHEN min(p_partkey) % 5 = 0 THEN 'dormant' ELSE 'active' END AS status
  FROM part GROUP BY p_name, p_brand),
products AS (
  SELECT concat_ws('|', 'pr', p.p_name, p.p_brand) AS id, p.p_name AS display_name, p.p_brand AS brand_slug, p.status,
    CASE WHEN p.status = 'merged' AND a.b IS NOT NULL THEN concat_ws('|', 'pr', p.p_name, a.b) END AS merged_into,
    p.sightings, p.size_each, p.size_max, CASE WHEN p.k % 13 = 0 THEN 'size-conflict' END AS review_flag,
    list_distinct(list_concat(string_split(p.p_name, ' '), [lower(p.p_brand)])) AS tokens
  FROM products0 p LEFT JOIN (SELECT p_name, min(p_brand) AS b FROM products0 WHERE status <> 'merged' GROUP BY p_name) a ON p.p_name = a.p_name),
product_tokens AS (SELECT DISTINCT id AS product_id, unnest(tokens) AS token FROM products WHERE status <> 'merged'),
sightings AS (
  SELECT id AS offer_id, product_id, CASE flag WHEN 'A' THEN 'auto' WHEN 'N' THEN 'created' ELSE 'review' END AS match_band,
    store, region, valid_from AS week, price_cents, old_cents, detected_at, line FROM offers),
runs AS (
  SELECT event_id AS id, ts, event_type AS action, user_id AS store, event_type <> 'error' AS ok, CAST(floor(value * 100 + 0.5) AS BIGINT) AS elapsed_cents,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS enriched FROM events),
brochures AS (
  SELECT o_orderkey AS id, o_custkey AS store, CAST(date_trunc('week', o_orderdate) AS DATE) AS valid_from, CAST(date_trunc('week', o_orderdate) AS DATE) + 6 AS valid_to,
    'Flyer ' || substr(o_orderpriority, 1, 1) AS title, CAST(o_orderkey % 9 AS INTEGER) AS pages, CAST(o_orderdate AS DATE) AS detected_at FROM orders)
"""
