"""Queries over paged sources, the signed search, the browse summary and late corrections."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.catalog import query
from shelfwise.operators import browse as B
from shelfwise.operators import sinks as S
from shelfwise.plans.browse import AISLES, CURRENT, DEDUPED, FROZEN_SQL, SIGNALS, current, frozen
from shelfwise.plans.rules import searches
from shelfwise.sources import connectors as C
from shelfwise.sources.tables import TODAY, cents, day
from shelfwise.streaming import jobs


@query("SRC-04_signed_search", "SELECT 'B' || n_nationkey AS id, n_name AS name, n_nationkey + 1.5::DOUBLE AS price, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey + 3.0::DOUBLE END AS old_price, 'brand' AS brand FROM nation")
def signed_search(t):
    def fetch(method, address, headers, body):
        # stands for the network, which a caller injects: it answers signed requests alone
        if "Signature=" not in headers["authorization"]:
            raise PermissionError(address)
        key, name = json.loads(body)["Keywords"].split("|")
        basis = float(key) + (3.0 if int(key) % 2 == 0 else 1.0)
        listing = {"Price": {"Amount": float(key) + 1.5, "Currency": "SAR"}, "SavingBasis": {"Amount": basis}}
        item = {"ASIN": f"B{key}", "ItemInfo": {"Title": {"DisplayValue": f" {name} "}, "ByLineInfo": {"Brand": {"DisplayValue": "brand"}}}, "Offers": {"Listings": [listing]}}
        return json.dumps({"SearchResult": {"Items": [item]}})

    ask = C.signed_search(fetch, "search.example", "AKIDEXAMPLE", "not-a-secret", "eu-west-1", "Search", lambda: "19980617T000000Z")
    return C.live_search(t.spark, C.Provider("signed", "Signed", (("api", ask),)), searches(t)).select("id", "name", "price", "old_price", "brand")


@query("SRC-14_offers_source", """, numbered AS (SELECT p_size AS store, 'r' || (p_partkey % 40) AS id, (p_partkey % 5)::INTEGER AS code, p_retailprice AS price, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS n FROM part),
given AS (SELECT *, n // 4 + 1 AS page FROM numbered WHERE NOT (store % 2 = 0 AND n = 9)), sizes AS (SELECT store, page, count(*) AS c FROM given GROUP BY ALL), last AS (SELECT store, min(page) AS last FROM sizes WHERE c < 4 GROUP BY store),
kept AS (SELECT g.*, row_number() OVER (PARTITION BY g.store, page ORDER BY n) - 1 AS at_place FROM given g LEFT JOIN last l ON g.store = l.store WHERE l.last IS NULL OR page <= l.last)
SELECT store, id, CASE arg_min(code, (page, at_place)) WHEN 0 THEN 'zero' WHEN 1 THEN 'one' WHEN 2 THEN 'two' WHEN 3 THEN 'three' END AS category, arg_min(price, (page, at_place)) AS price FROM kept WHERE (page - 1) * 4 + at_place < 30 GROUP BY store, id""")
def offers_source(t):
    p = t.read("part").select(F.col("p_size").alias("store"), F.concat(F.lit("r"), (F.col("p_partkey") % 40).cast("string")).alias("id"), (F.col("p_partkey") % 5).cast("int").alias("category"), F.col("p_retailprice").alias("price"), "p_partkey")
    p = p.withColumn("n", F.row_number().over(W.partitionBy("store").orderBy("p_partkey")) - 1)
    # every second store has a page that isn't full
    p = p.where(~((F.col("store") % 2 == 0) & (F.col("n") == 9))).withColumn("page", (F.floor(F.col("n") / 4) + 1).cast("int"))
    row = F.struct("n", F.struct("id", "category", "price").alias("r"))
    pages = p.groupBy("store", "page").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["r"]).alias("rows"))).alias("body"))
    names = t.spark.createDataFrame(list(enumerate(("zero", "one", "two", "three"))), "code int, slug string")
    return C.offers_source(pages, names, 4, 30)


@query("BRW-01_summary", f""", c AS ({CURRENT}), base AS ({DEDUPED}), s AS ({SIGNALS})
SELECT 'all' AS section, 'all' AS key, count(*) AS n, count(*) FILTER (old_cents > price_cents) AS drops, count(*) FILTER ({FROZEN_SQL}) AS frozen FROM c
UNION ALL SELECT 'brand', brand, count(*), count(*) FILTER (old_cents > price_cents), count(*) FILTER ({FROZEN_SQL}) FROM c GROUP BY brand
UNION ALL SELECT 'aisle', a.aisle, count(*), count(*) FILTER (old_cents > price_cents), count(*) FILTER ({FROZEN_SQL}) FROM c JOIN (VALUES {', '.join(map(str, AISLES))}) a(category, aisle, department, place) ON c.category = a.category GROUP BY a.aisle
UNION ALL (SELECT 'rail-drops', id, price_cents, NULL, NULL FROM s WHERE old_cents > price_cents ORDER BY drop DESC, price_cents, id LIMIT 12)
UNION ALL (SELECT 'rail-lowest-ever', id, price_cents, NULL, NULL FROM s WHERE lowest_ever ORDER BY drop DESC, price_cents, id LIMIT 12)""")
def summary(t):
    # counts of all, of brands and of categories in one pass
    c = current(t).select("brand", "category", B.has_drop().alias("drop"), frozen().alias("cold"))
    g = c.groupingSets([[F.col("brand")], [F.col("category")], []], "brand", "category").agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.count_if("drop").alias("drops"), F.count_if("cold").alias("frozen"))
    counts = ["n", "drops", "frozen"]
    part = lambda section, key, df: df.select(F.lit(section).alias("section"), key.alias("key"), *counts)
    a = t.spark.createDataFrame(AISLES, "category string, aisle string, department string, place int").select("category", "aisle")
    aisles = g.where("g = 2").join(F.broadcast(a), "category").groupBy("aisle").agg(*[F.sum(x).alias(x) for x in counts])
    none = F.lit(None).cast("bigint")
    rails = B.rails(t.current_offers, t.identities, day(TODAY)).select(F.concat(F.lit("rail-"), "rail").alias("section"), F.col("id").alias("key"), F.col("price_cents").alias("n"), none.alias("drops"), none.alias("frozen"))
    return part("all", F.lit("all"), g.where("g = 3")).unionByName(part("brand", F.col("brand"), g.where("g = 1"))).unionByName(part("aisle", F.col("aisle"), aisles)).unionByName(rails)


@query("STREAM-07_late_corrections", "SELECT user_id AS identity, CAST(ts AS DATE) AS day, arg_max(CAST(floor(value * 100 + 0.5) AS BIGINT), event_id) AS price_cents FROM events GROUP BY 1, 2")
def late_corrections(t):
    """A stream of prices by (identity, day): a later one replaces the point that is there."""
    path = f"{jobs.shared_folder(t.spark)}/late-{uuid.uuid4().hex}"
    schema = "identity bigint, day date, price_cents bigint, v bigint"
    table = {"at": S.overwrite(t.spark.createDataFrame([], schema), f"{path}/points")}

    def merge(batch, epoch):
        old = batch.sparkSession.read.schema(schema).parquet(table["at"])
        table["at"] = S.overwrite(S.replace_latest(old, batch, ["identity", "day"], F.desc("v")), f"{path}/points")

    e = jobs.stream_of(t.spark, t.sf_dir, "events")
    rows = e.select(F.col("user_id").alias("identity"), F.to_date("ts").alias("day"), cents(F.col("value")).alias("price_cents"), F.col("event_id").alias("v"))
    jobs.ingest(rows, merge, f"{path}/state").awaitTermination()
    return t.spark.read.schema(schema).parquet(table["at"]).drop("v")
