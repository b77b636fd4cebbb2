"""Queries over current offers: gates, joins, facets, deals and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.catalog import query
from shelfwise.operators import browse as B
from shelfwise.operators.history import first_by
from shelfwise.sources.tables import TODAY, Tables, day



def now():
    return day(TODAY)

COLS = ["id", "store", "name", "price_cents"]
#: Terms of the derived names that stand for the frozen and processed marks.
MARKS = {"frozen": ("cold",), "processed": ("hot",), "guard": ("gear",)}
FROZEN_SQL = "(regexp_matches(coalesce(name, ''), '(?i)cold') OR (regexp_matches(coalesce(name, ''), '(?i)hot') AND NOT regexp_matches(coalesce(name, ''), '(?i)gear')))"
PCT_SQL = "CASE WHEN old_cents > price_cents THEN (old_cents - price_cents)::DOUBLE / old_cents ELSE 0 END"


def frozen():
    return B.is_frozen(F.col("name"), None, **MARKS)


def current(t: Tables):
    return t.current_offers


CURRENT = f"SELECT * FROM offers WHERE valid_to >= DATE '{TODAY}'"


@query("SRC-16_table_scan", "SELECT id, store, price_cents FROM offers")
def table_scan(t):
    return t.offers.select("id", "store", "price_cents")


@query("SRC-17_keyed_reads", "SELECT o.id, o.store, o.flyer_ref FROM offers o SEMI JOIN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') k ON o.flyer_ref = k.o_orderkey")
def keyed_reads(t):
    keys = t.read("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("flyer_ref"))
    return t.offers.join(keys, "flyer_ref", "left_semi").select("id", "store", "flyer_ref")


@query("SRC-18_failed_runs_newest", "SELECT id, store, action, elapsed_cents FROM runs WHERE NOT ok ORDER BY id DESC LIMIT 400")
def failed_runs(t):
    return t.runs.where("not ok").orderBy(F.desc("id")).limit(400).select("id", "store", "action", "elapsed_cents")


@query("SRC-19_offer_projection", "SELECT id, concat_ws(':', store, region) AS place, name AS title, price_cents / 100::DOUBLE AS price, 'SAR' AS currency FROM offers WHERE name IS NOT NULL AND id IS NOT NULL")
def offer_projection(t):
    return t.offers.where("name is not null and id is not null").select("id", F.concat_ws(":", "store", "region").alias("place"), F.col("name").alias("title"), (F.col("price_cents") / F.lit(100.0)).alias("price"), F.lit("SAR").alias("currency"))


@query("FLT-01_currency_gate", f"SELECT id, store, name, price_cents FROM ({CURRENT})")
def currency_gate(t):
    return current(t).select(*COLS)


@query("FLT-02_equality", f"SELECT id, store, name, price_cents FROM ({CURRENT}) WHERE region = 'ASIA' AND brand = 'Brand#3'")
def equality(t):
    return current(t).where("region = 'ASIA' and brand = 'Brand#3'").select(*COLS)


@query("FLT-03_has_drop", "SELECT id, store, name, price_cents FROM offers WHERE old_cents IS NOT NULL AND old_cents > price_cents")
def drops(t):
    return t.offers.where(B.has_drop()).select(*COLS)


GROUPS = [("src-A", ["PROMO", "SMALL"], "none"), ("src-N", ["LARGE"], "exclude"), ("src-R", ["ECONOMY", "MEDIUM"], "only")]


@query("FLT-04_include_groups", f"""SELECT id, store, name, price_cents FROM offers WHERE (source = 'src-A' AND category IN ('PROMO', 'SMALL'))
  OR (source = 'src-N' AND category IN ('LARGE') AND NOT {FROZEN_SQL}) OR (source = 'src-R' AND category IN ('ECONOMY', 'MEDIUM') AND {FROZEN_SQL})""")
def include(t):
    return B.include_groups(t.offers, GROUPS, frozen()).select(*COLS)


@query("FLT-05_exclude_mapped", "SELECT id, store, name, price_cents FROM offers WHERE category IS NULL OR (source || category) NOT IN ('src-APROMO', 'src-NLARGE', 'src-RSMALL')")
def exclude(t):
    mapping = t.spark.createDataFrame([("src-A", "PROMO"), ("src-N", "LARGE"), ("src-R", "SMALL")], "source string, category string")
    return B.exclude_mapped(t.offers, mapping).select(*COLS)


@query("FLT-07_frozen_mark", f"SELECT id, {FROZEN_SQL} AS frozen FROM offers")
def frozen_mark(t):
    return t.offers.select("id", frozen().alias("frozen"))


@query("FLT-08_sanity_gates", """SELECT l_orderkey, l_linenumber, l_partkey, price, CASE WHEN was > price THEN was END AS old_price FROM (
  SELECT *, TRY_CAST(CASE WHEN l_linenumber = 3 THEN 'n/a' WHEN l_linenumber = 5 THEN '0' ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS DOUBLE) AS price, TRY_CAST(CAST(l_partkey % 60 AS VARCHAR) AS DOUBLE) AS was FROM lineitem)
  WHERE price IS NOT NULL AND price > 0 AND l_orderkey IS NOT NULL""")
def sanity(t):
    raw = F.when(F.col("l_linenumber") == 3, "n/a").when(F.col("l_linenumber") == 5, "0").otherwise(F.col("l_quantity").cast("int").cast("string"))
    df = t.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", raw.try_cast("double").alias("price"), (F.col("l_partkey") % 60).cast("string").try_cast("double").alias("was"))
    df = df.where("price is not null and price > 0 and l_orderkey is not null")
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "price", F.when(F.col("was") > F.col("price"), F.col("was")).alias("old_price"))


@query("FLT-09_vision_queue", f"SELECT o.id, o.valid_to FROM ({CURRENT}) o ANTI JOIN enrichments e ON o.id = e.id WHERE o.tax > 0")
def vision_queue(t):
    return current(t).where("tax > 0").join(t.enrichments.select("id"), "id", "left_anti").select("id", "valid_to")


LENSES = {
    "unresolved": "mint_verdict IS NULL",
    "deferred": "mint_verdict = 'declined'",
    "reviewed": "match_band = 'review'",
    "low-confidence": "corroboration < 0.45",
    "missing-product": "match_band IS NULL",
    "ocr-fallback": "NOT servable",
    "vision-enriched": "servable",
    "all": "TRUE",
}
LENS_SQL = " UNION ALL ".join(f"SELECT '{k}' AS lens, count(*) AS n FROM j WHERE {v}" for k, v in LENSES.items())


@query("FLT-10_inspector_lenses", f""", j AS (SELECT o.id, e.mint_verdict, e.corroboration, s.match_band, coalesce(e.e_name IS NOT NULL AND e.corroboration >= 0.3, FALSE) AS servable
  FROM offers o LEFT JOIN enrichments e ON o.id = e.id LEFT JOIN sightings s ON o.id = s.offer_id WHERE contains(lower(o.search_text), 'ring')) {LENS_SQL}""")
def lenses(t):
    j = B.canonical(t.offers, t.enrichments).where(F.lower("search_text").contains("ring")).join(t.sightings.select(F.col("offer_id").alias("id"), "match_band"), "id", "left")
    counts = j.agg(*[F.count_if(F.expr(v)).alias(k) for k, v in LENSES.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("lens"), F.col(f"`{k}`").alias("n")) for k in LENSES])).alias("x")).select("x.*")


@query("FLT-11_product_search", "SELECT id, display_name, brand_slug FROM products WHERE status <> 'merged' AND (display_name ILIKE '%WID%' OR brand_slug ILIKE '%#2%' OR review_flag ILIKE '%size%')")
def product_search(t):
    like = F.col("display_name").ilike("%WID%") | F.col("brand_slug").ilike("%#2%") | F.coalesce(F.col("review_flag").ilike("%size%"), F.lit(False))
    return t.products.where("status <> 'merged'").where(like).select("id", "display_name", "brand_slug")


SERVABLE = "coalesce(e.e_name IS NOT NULL AND e.corroboration >= 0.3, FALSE)"


@query("FLT-12_servable_gate", f"SELECT id FROM enrichments e WHERE {SERVABLE}")
def servable_gate(t):
    return t.enrichments.where(B.servable()).select("id")


@query("FLT-13_canonical_projection", f"SELECT o.id, CASE WHEN {SERVABLE} THEN e.e_name ELSE o.name END AS canon_name FROM offers o LEFT JOIN enrichments e ON o.id = e.id")
def canonical(t):
    return B.canonical(t.offers, t.enrichments).select("id", "canon_name")


@query("FLT-14_watch_validation", """SELECT o_orderkey AS id, CASE WHEN length(trim(coalesce(o_orderpriority, ''))) < 6 THEN 'label-too-short' WHEN o_totalprice <= 0 OR o_totalprice > 400000 THEN 'target-out-of-range'
  WHEN o_orderstatus NOT IN ('O', 'F') THEN 'unknown-kind' ELSE 'ok' END AS verdict FROM orders""")
def watch_validation(t):
    from shelfwise.operators.watches import verdict

    return t.read("orders").select(F.col("o_orderkey").alias("id"), verdict(F.col("o_orderpriority"), F.col("o_totalprice"), F.col("o_orderstatus"), 6, 400000.0, ("O", "F")).alias("verdict"))


@query("FLT-15_card_projection", f"""SELECT o.id, o.name, o.price_cents, coalesce(o.category, 'other') AS aisle, lower(o.brand) AS brand,
  CASE WHEN old_cents > price_cents AND (old_cents - price_cents)::DOUBLE / old_cents >= 0.05 THEN CAST(floor((old_cents - price_cents)::DOUBLE / old_cents * 100 + 0.5) AS BIGINT) END AS badge_drop,
  CASE WHEN valid_to - DATE '{TODAY}' <= 2 THEN CAST(valid_to - DATE '{TODAY}' AS INTEGER) END AS badge_ends FROM ({CURRENT}) o""")
def cards(t):
    d = (F.col("old_cents") - F.col("price_cents")) / F.col("old_cents")
    ends = F.datediff("valid_to", now())
    return current(t).select("id", "name", "price_cents", F.coalesce("category", F.lit("other")).alias("aisle"), F.lower("brand").alias("brand"), F.when(B.has_drop() & (d >= 0.05), F.floor(d * 100 + 0.5)).alias("badge_drop"), F.when(ends <= 2, ends).alias("badge_ends"))


@query("FLT-16_prunable_brochures", f"SELECT id, valid_to FROM brochures WHERE valid_to < DATE '{TODAY}' - 28 AND pages > 0 ORDER BY valid_to, id LIMIT 12")
def prunable(t):
    return t.brochures.where((F.col("valid_to") < F.date_sub(now(), 28)) & (F.col("pages") > 0)).orderBy("valid_to", "id").limit(12).select("id", "valid_to")


@query("FLT-17_dangling_sightings", "SELECT s.offer_id, s.product_id FROM sightings s LEFT JOIN (SELECT id FROM products WHERE status <> 'dormant') p ON s.product_id = p.id WHERE p.id IS NULL")
def dangling(t):
    return t.sightings.join(t.products.where("status <> 'dormant'").select(F.col("id").alias("product_id")), "product_id", "left_anti").select("offer_id", "product_id")


@query("JON-01_offers_enrichments", "SELECT o.id, e.e_name, e.corroboration FROM offers o LEFT JOIN enrichments e ON o.id = e.id")
def offers_enrichments(t):
    return t.offers.join(t.enrichments, "id", "left").select("id", "e_name", "corroboration")


@query("JON-02_offers_history", "SELECT o.id, i.weeks_seen, i.points, i.min_cents, i.max_cents FROM offers o LEFT JOIN identities i ON o.identity = i.identity")
def offers_history(t):
    return B.with_history(t.offers, t.identities).select("id", "weeks_seen", "points", "min_cents", "max_cents")


@query("JON-03_deal_candidates", f"SELECT o.id, i.weeks_seen, i.min_cents FROM ({CURRENT}) o JOIN identities i ON o.identity = i.identity WHERE i.weeks_seen >= 4")
def deal_candidates(t):
    return current(t).join(t.identities.where("weeks_seen >= 4").select("identity", "weeks_seen", "min_cents"), "identity").select("id", "weeks_seen", "min_cents")


@query("JON-12_orphans", "SELECT e.id FROM enrichments e ANTI JOIN (SELECT id FROM offers WHERE tax > 0.02) o ON e.id = o.id")
def orphans(t):
    return t.enrichments.join(t.offers.where("tax > 0.02").select("id"), "id", "left_anti").select("id")


@query("JON-15_offer_edition", "SELECT o.id, b.title, b.valid_from AS edition_from FROM offers o LEFT JOIN (SELECT *, 'https://flyers.example/' || id || '/view' AS url FROM brochures) b ON o.flyer_ref = CAST(regexp_extract(b.url, '/([0-9]+)/view', 1) AS BIGINT)")
def offer_edition(t):
    url = F.concat(F.lit("https://flyers.example/"), F.col("id").cast("string"), F.lit("/view"))
    b = t.brochures.select(F.regexp_extract(url, "/([0-9]+)/view", 1).cast("bigint").alias("flyer_ref"), "title", F.col("valid_from").alias("edition_from"))
    return t.offers.join(b, "flyer_ref", "left").select("id", "title", "edition_from")


@query("JON-18_lexicon_lookup", "SELECT id, CASE split_part(name, ' ', 1) WHEN 'hot' THEN 'warm' WHEN 'cold' THEN 'chilled' WHEN 'red' THEN 'colour' WHEN 'blue' THEN 'colour' END AS family FROM offers")
def lexicon(t):
    pairs = {"hot": "warm", "cold": "chilled", "red": "colour", "blue": "colour"}
    m = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return t.offers.select("id", F.try_element_at(m, F.split("name", " ")[0]).alias("family"))


@query("AGG-01_category_counts", f"SELECT source, category, {FROZEN_SQL} AS frozen, count(*) AS n FROM ({CURRENT}) GROUP BY ALL")
def category_counts(t):
    return current(t).groupBy("source", "category", frozen().alias("frozen")).agg(F.count("*").alias("n"))


@query("AGG-02_brand_counts", f"SELECT brand, count(*) AS n, count(DISTINCT store) AS stores FROM ({CURRENT}) GROUP BY brand")
def brand_counts(t):
    return current(t).groupBy("brand").agg(F.count("*").alias("n"), F.countDistinct("store").alias("stores"))


@query("AGG-03_brand_facets", f"SELECT brand, count(*) AS n FROM ({CURRENT}) WHERE category = 'PROMO' GROUP BY brand")
def brand_facets(t):
    return current(t).where("category = 'PROMO'").groupBy("brand").agg(F.count("*").alias("n"))


@query("AGG-04_conditional_counts", f"SELECT count(*) AS total, count(*) FILTER (valid_to >= DATE '{TODAY}') AS current, count(DISTINCT CASE WHEN valid_to >= DATE '{TODAY}' THEN store END) AS stores FROM offers")
def conditional_counts(t):
    on = B.is_current(now())
    return t.offers.agg(F.count("*").alias("total"), F.count_if(on).alias("current"), F.countDistinct(F.when(on, F.col("store"))).alias("stores"))


@query("AGG-05_store_counts", f"SELECT store, count(*) AS n FROM ({CURRENT}) GROUP BY store")
def store_counts(t):
    return current(t).groupBy("store").agg(F.count("*").alias("n"))


@query("AGG-08_vision_coverage", """SELECT with_crop, attempted, servable, declined, with_crop - attempted AS remaining, CASE WHEN with_crop > 0 THEN floor(attempted::DOUBLE / with_crop * 1000 + 0.5) / 10 END AS coverage FROM (
  SELECT count(*) FILTER (o.tax > 0) AS with_crop, count(*) FILTER (o.tax > 0 AND e.id IS NOT NULL) AS attempted, count(*) FILTER (o.tax > 0 AND e.e_name IS NOT NULL AND e.corroboration >= 0.3) AS servable,
    count(*) FILTER (o.tax > 0 AND e.id IS NOT NULL AND e.e_name IS NULL) AS declined FROM offers o LEFT JOIN enrichments e ON o.id = e.id)""")
def vision_coverage(t):
    j = t.offers.where("tax > 0").join(t.enrichments.withColumn("got", F.lit(True)), "id", "left")
    got = F.coalesce("got", F.lit(False))
    g = j.agg(F.count("*").alias("with_crop"), F.count_if(got).alias("attempted"), F.count_if(B.servable()).alias("servable"), F.count_if(got & F.col("e_name").isNull()).alias("declined"))
    share = F.try_divide(F.col("attempted").cast("double"), F.col("with_crop"))
    return g.select("with_crop", "attempted", "servable", "declined", (F.col("with_crop") - F.col("attempted")).alias("remaining"), (F.floor(share * 1000 + 0.5) / F.lit(10.0)).alias("coverage"))


@query("AGG-09_verdict_counts", "SELECT coalesce(mint_verdict, 'unresolved') AS verdict, count(*) AS n FROM enrichments GROUP BY 1")
def verdict_counts(t):
    return t.enrichments.groupBy(F.coalesce("mint_verdict", F.lit("unresolved")).alias("verdict")).agg(F.count("*").alias("n"))


@query("AGG-11_oldest_waiting", f"SELECT min(o.detected_at) AS oldest, count(*) AS waiting FROM ({CURRENT}) o ANTI JOIN enrichments e ON o.id = e.id")
def oldest_waiting(t):
    return current(t).join(t.enrichments.select("id"), "id", "left_anti").agg(F.min("detected_at").alias("oldest"), F.count("*").alias("waiting"))


AISLES = [("PROMO", "offers", "front", 1), ("SMALL", "snacks", "food", 2), ("MEDIUM", "snacks", "food", 2), ("LARGE", "bulk", "home", 3)]


@query("AGG-12_fold_counts", f"""SELECT a.department, a.aisle, a.place, count(*) AS n FROM ({CURRENT}) o JOIN (VALUES {', '.join(map(str, AISLES))}) a(category, aisle, department, place) ON o.category = a.category GROUP BY ALL HAVING count(*) > 0""")
def fold_counts(t):
    a = t.spark.createDataFrame(AISLES, "category string, aisle string, department string, place int")
    return current(t).join(F.broadcast(a), "category").groupBy("department", "aisle", "place").agg(F.count("*").alias("n"))


@query("CLS-06_canonical_aisle", f"""SELECT id, CASE WHEN {FROZEN_SQL} AND base = 'snacks' THEN 'frozen-snacks' ELSE base END AS aisle FROM (
  SELECT id, name, CASE category WHEN 'PROMO' THEN 'offers' WHEN 'SMALL' THEN 'snacks' WHEN 'MEDIUM' THEN 'snacks' WHEN 'LARGE' THEN 'bulk' ELSE 'other' END AS base FROM offers)""")
def canonical_aisle(t):
    m = F.create_map(*[F.lit(x) for c, aisle, *_ in AISLES for x in (c, aisle)])
    base = F.coalesce(F.try_element_at(m, F.coalesce("category", F.lit("?"))), F.lit("other"))
    return t.offers.select("id", F.when(frozen() & (base == "snacks"), "frozen-snacks").otherwise(base).alias("aisle"))


SIGNALS = f"""SELECT *, lowest_ever AND points >= 3 AS return_low, (CASE WHEN lowest_ever THEN 50 ELSE 0 END + CASE WHEN drop >= 0.4 THEN 30 WHEN drop >= 0.25 THEN 15 ELSE 0 END
    + CASE WHEN rare THEN 20 ELSE 0 END + CASE WHEN lowest_ever AND points >= 3 THEN 15 ELSE 0 END + CASE WHEN multibuy THEN 10 ELSE 0 END)::INTEGER AS score FROM (
  SELECT o.*, i.points, {PCT_SQL} AS drop, coalesce(i.weeks_seen >= 4 AND i.points >= 2 AND o.price_cents <= i.min_cents, FALSE) AS lowest_ever,
    greatest(0, (DATE '{TODAY}' - i.first_seen) // 7) >= 8 AND i.weeks_seen >= 1 AND i.weeks_seen * 4 <= greatest(0, (DATE '{TODAY}' - i.first_seen) // 7) AS rare,
    regexp_matches(coalesce(o.name, ''), '(^|\\s)\\d\\s*\\+\\s*\\d(\\s|$)') AS multibuy, greatest(0, o.valid_to - DATE '{TODAY}')::INTEGER AS ends_in_days
  FROM base o LEFT JOIN identities i ON o.identity = i.identity)"""


@query("DEA-01_deal_signals", f", base AS ({CURRENT}) SELECT id, drop, lowest_ever, return_low, rare, multibuy, ends_in_days, score, score >= 50 AS exceptional FROM ({SIGNALS})")
def deal_signals(t):
    return B.deal_signals(B.with_history(current(t), t.identities), now()).select("id", "drop", "lowest_ever", "return_low", "rare", "multibuy", "ends_in_days", "score", "exceptional")


@query("RANK-04_best_deals", f", base AS ({CURRENT}) SELECT id, score, drop, price_cents FROM ({SIGNALS}) WHERE score >= 15 ORDER BY score DESC, drop DESC, price_cents, id LIMIT 40")
def best_deals(t):
    df = B.deal_signals(B.with_history(current(t), t.identities), now()).where("score >= 15")
    return df.orderBy(F.desc("score"), F.desc("drop"), "price_cents", "id").limit(40).select("id", "score", "drop", "price_cents")


DEDUPED = f"""SELECT * FROM ({CURRENT}) QUALIFY row_number() OVER (PARTITION BY store, coalesce(identity, name, id), price_cents ORDER BY valid_to DESC, {PCT_SQL} DESC, price_cents, id) = 1"""


@query("WIN-05_dedupe_deals", f"SELECT id, store, name, price_cents FROM ({DEDUPED})")
def dedupe(t):
    return B.deduped(current(t)).select(*COLS)


for _sort, _order in {"discount": f"{PCT_SQL} DESC, price_cents, id", "price": "price_cents, id", "newest": "detected_at DESC, id", "ending": "valid_to ASC NULLS LAST, id"}.items():

    @query(f"RANK-01_sort_{_sort}", f"SELECT id, store, name, price_cents FROM ({CURRENT}) ORDER BY {_order} LIMIT 100")
    def sorted_by(t, _sort=_sort):
        return current(t).orderBy(*B.sort_keys(_sort)).limit(100).select(*COLS)


@query("LIM-01_paging", f"SELECT id, store, name, price_cents FROM ({DEDUPED}) ORDER BY {PCT_SQL} DESC, price_cents, id LIMIT 48 OFFSET 96")
def paging(t):
    return B.listing(t.current_offers, now(), offset=96).select(*COLS)


@query("BRW-02_listing", f"SELECT id, store, name, price_cents FROM (SELECT * FROM ({DEDUPED}) WHERE region = 'EUROPE' AND NOT {FROZEN_SQL}) ORDER BY {PCT_SQL} DESC, price_cents, id LIMIT 48")
def listing(t):
    return B.listing(t.current_offers, now(), where=(F.col("region") == "EUROPE") & ~frozen()).select(*COLS)


@query("RANK-11_rails", f""", base AS ({DEDUPED}), s AS ({SIGNALS}) (SELECT 'drops' AS rail, id, store, name, price_cents, old_cents FROM s WHERE old_cents > price_cents ORDER BY drop DESC, price_cents, id LIMIT 12)
  UNION ALL (SELECT 'lowest-ever', id, store, name, price_cents, old_cents FROM s WHERE lowest_ever ORDER BY drop DESC, price_cents, id LIMIT 12)""")
def rails(t):
    return B.rails(t.current_offers, t.identities, now())


@query("MTH-01_drop_percent", f"SELECT id, floor({PCT_SQL} * 100 + 0.5)::BIGINT AS pct, floor({PCT_SQL} * 10000 + 0.5) / 100 AS pct2, least(1.0, greatest(0.0, {PCT_SQL} * 4)) AS clamped FROM offers")
def drop_percent(t):
    p = F.when(B.has_drop(), (F.col("old_cents") - F.col("price_cents")) / F.col("old_cents")).otherwise(0.0)
    return t.offers.select("id", F.floor(p * 100 + 0.5).alias("pct"), (F.floor(p * 10000 + 0.5) / F.lit(100.0)).alias("pct2"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), p * 4)).alias("clamped"))


@query("DAT-01_iso_week", "SELECT id, isoyear(detected_at)::INTEGER AS iso_year, weekofyear(detected_at)::INTEGER AS iso_week, isoyear(detected_at)::VARCHAR || '-W' || lpad(weekofyear(detected_at)::VARCHAR, 2, '0') AS edition, regexp_extract('valid from ' || strftime(detected_at, '%Y-%m-%d') || ' on', '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1) AS first_date FROM offers")
def iso_week(t):
    d = F.col("detected_at")
    year = F.extract(F.lit("YEAROFWEEK"), d)
    return t.offers.select("id", year.cast("int").alias("iso_year"), F.weekofyear(d).alias("iso_week"), F.concat(year.cast("string"), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0")).alias("edition"), F.regexp_extract(F.concat(F.lit("valid from "), d.cast("string"), F.lit(" on")), "([0-9]{4}-[0-9]{2}-[0-9]{2})", 1).alias("first_date"))


@query("DAT-02_day_distances", f"SELECT id, greatest(0, (DATE '{TODAY}' - detected_at) // 7)::INTEGER AS weeks, greatest(0, valid_to - DATE '{TODAY}')::INTEGER AS ends_in, (DATE '{TODAY}' - detected_at)::INTEGER AS days_ago FROM offers")
def day_distances(t):
    ago = F.datediff(now(), "detected_at")
    return t.offers.select("id", F.greatest(F.lit(0), F.floor(ago / 7).cast("int")).alias("weeks"), F.greatest(F.lit(0), F.datediff("valid_to", now())).alias("ends_in"), ago.alias("days_ago"))


@query("SRC-14_dedupe_by_id", "SELECT flyer_ref, id, category FROM offers QUALIFY row_number() OVER (PARTITION BY flyer_ref ORDER BY id) = 1")
def source_dedupe(t):
    return first_by(t.offers, ["flyer_ref"], "id").select("flyer_ref", "id", "category")
