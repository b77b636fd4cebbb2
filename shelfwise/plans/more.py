"""Queries over connectors, remaining writes, identity evidence and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.catalog import query
from shelfwise.functions import identity, names, sizes
from shelfwise.functions import text as T
from shelfwise.operators import sinks as S
from shelfwise.sources import connectors as C
from shelfwise.sources.tables import TODAY, day


def now():
    return day(TODAY)


def body(t, shape):
    """Parts as pages of JSON, as a fetch would return them."""
    return t.read("part").select(F.to_json(shape).alias("body"))


@query("SRC-02_product_list", "SELECT 'v' || p_partkey AS id, p_name AS name, p_retailprice AS price, CASE WHEN p_size > 25 THEN p_retailprice + 1 END AS old_price FROM part WHERE p_size % 7 <> 0")
def product_list(t):
    s = lambda c: c.cast("string")
    variety = F.struct(F.concat(F.lit("v"), s(F.col("p_partkey"))).alias("id"), F.col("p_retailprice").alias("price"), (F.col("p_retailprice") + F.when(F.col("p_size") > 25, 1).otherwise(-1)).alias("was"))
    product = F.struct(s(F.col("p_partkey")).alias("id"), F.when(F.col("p_size") % 7 != 0, F.col("p_name")).otherwise(" ").alias("name"), F.array(variety).alias("varieties"))
    return C.product_list(body(t, F.struct(F.array(product).alias("products")))).select("id", "name", "price", "old_price")


@query("SRC-05_layout_items", "SELECT p_partkey::VARCHAR AS id, floor((p_retailprice - p_size) * 100 + 0.5) / 100 AS price FROM part")
def layout_items(t):
    item = F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("mrp"), F.col("p_size").cast("double").alias("discount"))
    none = F.struct(F.filter(F.array(item), lambda x: F.lit(False)).alias("items"))
    return C.layout_items(body(t, F.struct(F.array(none, F.struct(F.array(item).alias("items"))).alias("layouts")))).select("id", "price")


@query("SRC-08_flight_text", "SELECT p_partkey::VARCHAR AS id, p_name AS name, p_retailprice AS price FROM part")
def flight(t):
    one = F.to_json(F.struct(F.lit("x").alias("k"), F.struct(F.col("p_partkey").cast("string").alias("sku"), F.col("p_name").alias("title"), F.lit("i").alias("image"), F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price")).alias("item")))
    quoted = F.concat(F.lit('"'), F.replace(one, F.lit('"'), F.lit('\\"')), F.lit('"'))
    html = F.concat(F.lit("<script>self.__next_f.push([1,"), quoted, F.lit("])</script>"))
    return C.flight_products(t.read("part").select(html.alias("html"))).select("id", "name", "price")


@query("SRC-09_cents_items", "SELECT p_partkey::VARCHAR AS id, p_size / 100::DOUBLE AS price FROM part WHERE p_partkey % 3 <> 0")
def cents_items(t):
    item = F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_size").cast("bigint").alias("price"), (F.col("p_partkey") % 3 != 0).alias("available"))
    return C.cents_items(body(t, F.struct(F.array(item).alias("items")))).select("id", "price")


@query("SRC-11_flyer_listing", f"SELECT id, title, valid_to FROM brochures WHERE valid_to >= DATE '{TODAY}' ORDER BY id DESC LIMIT 6")
def flyers(t):
    card = F.concat(F.lit('<article data-offer="'), F.col("id").cast("string"), F.lit('"><h3>'), F.col("title"), F.lit('</h3><time datetime="'), F.col("valid_to").cast("string"), F.lit('"></time></article>'))
    return C.flyer_cards(t.brochures.select(card.alias("html")), now()).select("id", "title", "valid_to")


@query("SNK-02_identity_upsert", "SELECT coalesce(o.identity, n.identity) AS identity, coalesce(o.first_seen, n.first_seen) AS first_seen, coalesce(n.last_cents, o.last_cents) AS last_cents FROM (SELECT * FROM identities WHERE size < 30) o FULL JOIN (SELECT identity, first_seen + 7 AS first_seen, last_cents + 1 AS last_cents FROM identities WHERE size > 20) n ON o.identity = n.identity")
def identity_upsert(t):
    own = t.identities.select("identity", "first_seen", "last_cents", "size")
    old, new = own.where("size < 30").drop("size"), own.where("size > 20")
    return S.upsert(old, new.select("identity", F.date_add("first_seen", 7).alias("first_seen"), (F.col("last_cents") + 1).alias("last_cents")), "identity", keep=("first_seen",))


@query("JON-16_linked_spots", "SELECT flyer_ref, count(*) AS spots, count(*) FILTER (line <= 3) AS linked FROM (SELECT DISTINCT flyer_ref, line FROM offers) GROUP BY flyer_ref")
def linked_spots(t):
    spots = t.offers.select("flyer_ref", F.col("line").alias("offer_id")).distinct()
    return C.linked_spots(spots, t.offers.where("line <= 3").select("flyer_ref", F.col("line").alias("offer_id")))


@query("GEO-01_boxes", "SELECT p_partkey, x, y, w, h FROM (SELECT p_partkey, floor(least(1, p_size / 40::DOUBLE) * 10000 + 0.5) / 10000 AS x, 0.1::DOUBLE AS y, floor((1 - least(1, p_size / 40::DOUBLE)) * 10000 + 0.5) / 10000 AS w, 0.2::DOUBLE AS h FROM part) WHERE w >= 0.005")
def boxes(t):
    point = lambda x, y: F.struct(x.alias("x"), F.lit(y).alias("y"))
    spots = F.array(F.struct(F.lit(0).alias("page"), F.lit("s").alias("id"), F.array(point(F.col("p_size") / F.lit(40.0), 0.1), point(F.lit(1.5), 0.3)).alias("points")))
    return C.hotspots(t.read("part").select("p_partkey", F.to_json(spots).alias("polygons"))).select("p_partkey", "x", "y", "w", F.col("h"))


@query("TXT-06_compound_penalty", "SELECT p_partkey, CASE WHEN p_name LIKE '% ring' AND p_size % 2 = 0 THEN 0.45 ELSE 1.0 END::DOUBLE AS factor FROM part")
def penalty(t):
    df = t.read("part").withColumn("n", F.concat_ws(" ", "p_name", F.when(F.col("p_size") % 2 == 0, F.lit("powder")).otherwise("steel")))
    return T.with_words(df, "n", "x").select("p_partkey", T.compound_penalty(T.Query.of("ring"), F.col("x_words")).alias("factor"))


@query("TXT-08_offer_relevance", "SELECT id, CASE WHEN list_contains(string_split(name, ' '), 'red') THEN 200.0 ELSE 0.0 END::DOUBLE AS score, FALSE AS name_match FROM offers")
def offer_relevance(t):
    df = T.with_words(T.with_words(t.offers, "name", "x"), "search_text", "y")
    q = T.Query.of("red brand")
    score, match = T.offer_relevance(q, F.col("x_text"), F.col("x_words"), F.col("y_text"), F.col("y_words"))
    return df.select("id", score.alias("score"), match.alias("name_match"))


@query("TXT-09_token_presence", "SELECT p_partkey, CASE WHEN p_name LIKE '% ring' THEN CASE WHEN p_size % 2 = 0 THEN 'secondary' ELSE 'primary' END END AS presence FROM part")
def presence(t):
    df = t.read("part").withColumn("n", F.concat_ws(" ", "p_name", F.when(F.col("p_size") % 2 == 0, F.lit("flavoured"))))
    return T.with_words(df, "n", "x").select("p_partkey", T.token_presence(("ring",), F.col("x_words")).alias("presence"))


@query("TXT-12_derive_names", "SELECT p_partkey, p_name || ' ' || p_size || 'ml' AS name FROM part")
def derive_names(t):
    text = F.concat(F.lit("15.00\nSPECIAL OFFER\n"), F.col("p_name"), F.lit(" "), F.col("p_size").cast("string"), F.lit("ml\nwwwww"))
    return t.read("part").select("p_partkey", names.derive_names(text)["name"].alias("name"))


@query("TXT-13_parse_reply", "SELECT p_partkey, p_name AS name, least(1.0::DOUBLE, p_size / 40::DOUBLE) AS confidence FROM part WHERE p_partkey % 5 <> 0")
def parse_reply(t):
    reply = F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit("Here: "), F.to_json(F.struct(F.col("p_name").alias("name"), (F.col("p_size") / F.lit(40.0)).alias("confidence"))))).otherwise("none")
    return t.read("part").select("p_partkey", names.parse_reply(reply).alias("r")).where("r is not null").select("p_partkey", "r.name", "r.confidence")


@query("SIZ-03_read_size", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'g' END AS unit FROM part")
def read_size(t):
    # a range in the field is ambiguous, and the name has none
    label = F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, F.lit(" to 9")).otherwise(""), F.lit(" kg"))
    df = sizes.with_size(t.read("part").withColumn("label", label), "label")
    return df.select("p_partkey", F.when(~F.col("label").rlike(r"(?i)\d\s*(?:to|الي|إلى)\s*\d"), F.col("size_read.unit")).alias("unit"))


@query("SIZ-04_variant_label", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '6 × ' || p_size || ' ml' ELSE p_size || ' L' END AS label FROM part")
def variant_label(t):
    n = F.col("p_size").cast("string")
    df = sizes.with_size(t.read("part").withColumn("label", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("6x"), n, F.lit("ml"))).otherwise(F.concat(n, F.lit(" litre")))), "label")
    return df.select("p_partkey", sizes.variant_label(F.col("size_read")).alias("label"))




@query("CLS-07_core_tokens", "SELECT p_partkey, list_filter(string_split(p_name, ' '), lambda w: NOT list_contains(['new', 'hot', 'large', 'small'], w)) AS core FROM part")
def core(t):
    df = T.with_words(t.read("part").withColumn("n", F.concat_ws(" ", "p_name", F.lit("500ml pack of 6"))), "n", "x")
    return df.select("p_partkey", identity.core_tokens(F.col("x_words")).alias("core"))


@query("CLS-08_or_deal", "SELECT p_partkey, p_size % 2 = 0 AS or_deal, p_size % 3 = 0 AS assorted FROM part")
def or_deal(t):
    n = F.concat(F.lit("red apples"), F.when(F.col("p_size") % 2 == 0, F.lit(" or green pears")).otherwise(""), F.when(F.col("p_size") % 3 == 0, F.lit(" assorted")).otherwise(""))
    return t.read("part").select("p_partkey", names.is_or_deal(n, F.lit(None).cast("string")).alias("or_deal"), names.is_assortment(n).alias("assorted"))


