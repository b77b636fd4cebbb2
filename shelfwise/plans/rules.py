"""Queries over sources, words, brands, searches, watches and operations, each calling its operator on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.catalog import query
from shelfwise.functions import families as Fm
from shelfwise.functions import identity as I
from shelfwise.functions import names as N
from shelfwise.functions import text as T
from shelfwise.operators import browse as B
from shelfwise.operators import health as H
from shelfwise.operators import search as Se
from shelfwise.operators import sinks as S
from shelfwise.operators import watches as Wt
from shelfwise.operators.history import first_by, weekly_points
from shelfwise.operators.registry import first_n
from shelfwise.sources import connectors as C
from shelfwise.sources.tables import TODAY, cents, day


def now():
    return day(TODAY)


def listed(items):
    return "[" + ", ".join("NULL" if x is None else "'" + str(x).replace("'", "''") + "'" for x in items) + "]"


def text(c):
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


# sources -----------------------------------------------------------------------------------------------------------


def provider(name: str, odd: bool):
    """Answers by API for every second search, else (that and the page failing) with a static row."""

    def api(q):
        k, n = q.split("|")
        if (int(k) % 2 == 1) != odd:
            raise OSError("down")
        return [(f"a{k}", n, None, float(k) + 0.5, None, "SAR", None, None, None, None)]

    def static(q):
        k, n = q.split("|")
        return [(f"s{k}-{i}", n, None, float(k) + i, float(k) + 9, "SAR", None, None, None, None) for i in (1, 2)]

    return C.Provider(name, name, (("api", api), ("page", lambda q: []), ("static", static)))


def searches(t):
    # the nations are a fixed list of 25
    return [f"{r.n_nationkey}|{r.n_name}" for r in t.read("nation").select("n_nationkey", "n_name").collect()]


ANSWERS = "SELECT CASE WHEN n_nationkey % 2 = {0} THEN 'a' || n_nationkey ELSE 's' || n_nationkey || '-' || i END AS id, n_name AS name, n_nationkey + CASE WHEN n_nationkey % 2 = {0} THEN 0.5 ELSE i END::DOUBLE AS price FROM nation, (VALUES (1), (2)) v(i) WHERE i = 1 OR n_nationkey % 2 <> {0}"


@query("SRC-01_strategy_runner", ANSWERS.format(1))
def strategies(t):
    return C.live_search(t.spark, provider("demo", True), searches(t)).select("id", "name", "price")


@query("SRC-21_live_search", f"SELECT 'one' AS provider, min(price) AS best, count(*) AS results, name FROM ({ANSWERS.format(1)}) GROUP BY name UNION ALL SELECT 'two', min(price), count(*), name FROM ({ANSWERS.format(0)}) GROUP BY name")
def live(t):
    found = [C.live_search(t.spark, provider(n, odd), searches(t)).select(F.lit(n).alias("provider"), "name", "price") for n, odd in (("one", True), ("two", False))]
    return found[0].unionByName(found[1]).groupBy("provider", "name").agg(F.min("price").alias("best"), F.count("*").alias("results"))


@query("SRC-03_search_cards", "SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 2 ELSE 1 END AS attempt, 'B' || p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' & co' ELSE p_name END AS name, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS brand, p_size + 0.5::DOUBLE AS price, CASE WHEN p_size > 10 THEN p_size + 9.25::DOUBLE END AS old_price FROM part WHERE p_partkey % 12 <> 0")
def search_cards(t):
    head = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("<h2><span>"), "p_brand", F.lit("</span></h2><h2><a><span>"), "p_name", F.lit(" &amp; co</span></a></h2>"))).otherwise(F.concat(F.lit("<h2>"), "p_name", F.lit("</h2>")))
    was = F.when(F.col("p_size") > 10, F.concat(F.lit('<span data-a-strike="true"><span class="a-offscreen">SAR '), text(F.col("p_size") + F.lit(9.25)), F.lit("</span></span>"))).otherwise("")
    card = F.concat(F.lit('<div data-asin="">ad</div><div data-asin="B'), text("p_partkey"), F.lit('" class="s-search-result">'), head, F.lit('<span class="a-offscreen">SAR '), text(F.col("p_size") + F.lit(0.5)), F.lit("</span>"), was, F.lit("</div>"))
    # the first attempt of some pages is throttled, of fewer the second too
    tries = t.read("part").select("p_partkey", card.alias("card"), F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt"))
    blocked = ((F.col("attempt") == 1) & (F.col("p_partkey") % 6 == 0)) | (F.col("p_partkey") % 12 == 0)
    pages = tries.select("p_partkey", "attempt", F.when(blocked, 503).otherwise(200).alias("status"), F.rpad("card", 3000, " ").alias("html"))
    return C.search_cards(C.first_good(pages, "p_partkey", "attempt")).select("p_partkey", "attempt", "id", "name", "brand", "price", "old_price")


@query("SRC-03_html_links", "SELECT page_id, len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS links, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, '^https?://([^/?]+)', 1) AS host FROM pages")
def html_links(t):
    return t.read("pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).cast("bigint").alias("links"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("url", "^https?://([^/?]+)", 1).alias("host"))


def bodies(t, *items):
    return F.to_json(F.struct(F.array(*items).alias("products")))


@query("SRC-06_list_items", "SELECT p_partkey::VARCHAR AS id, p_name AS name, p_retailprice AS price, CASE WHEN p_size > 5 THEN p_retailprice + p_size END AS old_price, CASE WHEN p_size > 5 THEN floor((p_retailprice + p_size - p_retailprice) / (p_retailprice + p_size) * 100 + 0.5)::BIGINT || '% OFF' END AS label FROM part")
def list_items(t):
    retail = F.col("p_retailprice") + F.when(F.col("p_size") > 5, F.col("p_size")).otherwise(-1)
    item = F.struct(text("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"), retail.alias("retail"))
    return C.list_items(t.read("part").select(bodies(t, item).alias("body"))).select("id", "name", "price", "old_price", "label")


@query("SRC-07_asked_again", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN CASE WHEN length(split_part(p_name, ' ', 2)) > length(split_part(p_name, ' ', 1)) THEN split_part(p_name, ' ', 2) ELSE split_part(p_name, ' ', 1) END END AS again FROM part")
def asked_again(t):
    status = F.when(F.col("p_size") % 2 == 0, 422).otherwise(200)
    return t.read("part").select("p_partkey", C.asked_again(F.col("p_name"), status).alias("again"))


@query("SRC-07_paged_items", "SELECT p_name AS search, p_brand AS id, arg_min(p_type, (p_size, p_partkey)) AS name FROM part GROUP BY 1, 2")
def paged_items(t):
    # a page holds the items of one size, in the order of their keys
    one = F.struct("p_partkey", F.struct(F.col("p_brand").alias("id"), F.col("p_type").alias("name"), F.lit(1.0).alias("price")).alias("i"))
    pages = t.read("part").groupBy(F.col("p_name").alias("search"), F.col("p_size").alias("page")).agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["i"]).alias("products"))).alias("body"))
    return C.paged_items(pages, ["search"]).select("search", "id", "name")


@query("SRC-10_pdf_index", """SELECT page_id AS store, CASE WHEN link LIKE '/%' THEN regexp_extract(url, '^(https?://[^/]+)', 1) || link ELSE link END AS pdf_url, DATE '1998-06-01' + (page_id % 9)::INTEGER AS published
  FROM (SELECT page_id, url, max(link) AS link FROM (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS link FROM pages) WHERE regexp_matches(link, CASE WHEN page_id % 2 = 0 THEN '^/[a-z]' ELSE '^/[A-Z]' END) GROUP BY 1, 2)""")
def pdf_index(t):
    p = t.read("pages")
    indexes = p.select(F.col("page_id").alias("store"), "url", "html", F.date_add(day("1998-06-01"), (F.col("page_id") % 9).cast("int")).alias("modified"))
    config = p.select(F.col("page_id").alias("store"), F.when(F.col("page_id") % 2 == 0, "^/[a-z]").otherwise("^/[A-Z]").alias("pattern"))
    return C.flyer_pdfs(indexes, config)


RANKED = f"""SELECT *, row_number() OVER (PARTITION BY store ORDER BY (valid_from > DATE '{TODAY}')::INTEGER, pages DESC, valid_to DESC, id DESC) AS n
  FROM (SELECT * FROM brochures WHERE valid_to >= DATE '{TODAY}' AND pages > 0 QUALIFY row_number() OVER (PARTITION BY store, lower(title), valid_from, valid_to ORDER BY pages DESC, id DESC) = 1)"""


def budget_sql(wanted: str) -> str:
    return f""", ranked AS ({RANKED}), held AS (SELECT id, pages - (id % 3 = 0)::INTEGER AS pages FROM brochures WHERE id % 4 <> 0),
wanted AS (SELECT r.*, row_number() OVER (PARTITION BY store ORDER BY n) AS m FROM ({wanted}) r)
SELECT * FROM (WITH RECURSIVE run(store, m, budget, id, pages) AS (SELECT store, 1::BIGINT, 36 - CASE WHEN pages <= 36 THEN pages ELSE 0 END, CASE WHEN pages <= 36 THEN id END, pages FROM wanted WHERE m = 1
  UNION ALL SELECT w.store, w.m, budget - CASE WHEN w.pages <= budget THEN w.pages ELSE 0 END, CASE WHEN w.pages <= budget THEN w.id END, w.pages FROM run JOIN wanted w ON w.store = run.store AND w.m = run.m + 1)
  SELECT id, pages FROM run WHERE id IS NOT NULL)"""


def campaigns(t):
    """Ranked as RANK-05: one flyer a campaign, then valid now, pages, last day and id; flyers without pages aren't collected."""
    own = t.brochures.where((F.col("valid_to") >= now()) & (F.col("pages") > 0)).withColumn("campaign", F.lower("title"))
    return first_by(own, ["store", "campaign", "valid_from", "valid_to"], F.desc("pages"), F.desc("id")).select("store", "id", "pages", "valid_from", "valid_to")


def collected(flyers):
    order = [(F.col("valid_from") > now()).cast("int"), -F.col("pages"), -F.unix_date("valid_to"), -F.col("id")]
    return S.budgeted(flyers, "store", order, "pages", 36).select("id", "pages")


@query("SRC-12_flyer_budget", budget_sql("SELECT * FROM ranked"))
def flyer_budget(t):
    return collected(campaigns(t))


@query("SRC-12_held_flyers", budget_sql("SELECT r.* FROM ranked r LEFT JOIN held h ON r.id = h.id WHERE h.id IS NULL OR h.pages <> r.pages"))
def held_flyers(t):
    # held flyers are taken again only where their pages have changed
    held = t.brochures.where("id % 4 <> 0").select("id", (F.col("pages") - (F.col("id") % 3 == 0).cast("int")).alias("_held"))
    return collected(campaigns(t).join(held, "id", "left").where("_held is null or _held <> pages").drop("_held"))


@query("SRC-13_official_link", f"SELECT store, 'flyer' AS source_type, id, NULL AS link FROM brochures WHERE valid_to >= DATE '{TODAY}' UNION ALL SELECT c_custkey, 'link', NULL, 'https://stores.example/' || c_custkey FROM customer ANTI JOIN (SELECT store FROM brochures WHERE valid_to >= DATE '{TODAY}') b ON c_custkey = b.store")
def official_link(t):
    held = t.brochures.where(F.col("valid_to") >= now()).select("store", F.lit("flyer").alias("source_type"), "id", F.lit(None).cast("string").alias("link"))
    stores = t.read("customer").select(F.col("c_custkey").alias("store"), F.concat(F.lit("https://stores.example/"), text("c_custkey")).alias("link"))
    pointer = stores.join(held.select("store"), "store", "left_anti").select("store", F.lit("link").alias("source_type"), F.lit(None).cast("bigint").alias("id"), "link")
    return held.unionByName(pointer)


@query("SRC-20_store_configuration", "SELECT 'store-' || s_name || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '-' || s_suppkey END AS key, CASE WHEN s_suppkey % 4 = 0 THEN 9000 + s_suppkey WHEN s_suppkey % 3 <> 0 THEN s_suppkey END AS address FROM supplier")
def configuration(t):
    key = F.concat(F.lit("store-"), "s_name", F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.concat(F.lit("-"), text("s_suppkey"))))
    s = t.read("supplier").select(key.alias("key"), "s_suppkey")
    return C.addresses(s, s.where("s_suppkey % 4 = 0").select("key", (F.col("s_suppkey") + 9000).alias("address")))


# words -------------------------------------------------------------------------------------------------------------

ARTICLES = "array_to_string(list_transform(list_filter(string_split({0}, ' '), lambda w: w <> ''), lambda w: CASE WHEN length(regexp_replace(w, '^(وال|ال)', '')) >= 2 THEN regexp_replace(w, '^(وال|ال)', '') ELSE w END), ' ')"
#: Arabic names that the parts have besides their own, by number.
ARABIC_NAMES = ("الحليب الطازج", "والدجاج المجمد", "ال", "بالليمون", "شاي الكبوس", "أرز")


@query("TXT-02_canonical", f"SELECT p_partkey, {ARTICLES.format("lower(p_name) || ' ' || replace((" + listed(ARABIC_NAMES) + ")[p_partkey % 6 + 1], 'أ', 'ا')")} AS canonical FROM part")
def canonical(t):
    arabic = F.get(F.array(*[F.lit(x) for x in ARABIC_NAMES]), (F.col("p_partkey") % 6).cast("int"))
    return t.read("part").select("p_partkey", T.canonical_text(F.concat_ws(" ", F.upper("p_name"), arabic)).alias("canonical"))


@query("TXT-03_query_tokens", "SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN [p_size::VARCHAR, 'ml'] ELSE (string_split(lower(p_name || ' ' || p_type || ' ' || p_name || ' ' || p_type), ' '))[1:6] END AS tokens FROM part")
def query_tokens(t):
    size = F.concat(text("p_size"), F.lit(" ml"))
    asked = F.when(F.col("p_partkey") % 10 == 0, size).otherwise(F.concat_ws(" ", "p_name", "p_type", size, "p_name", "p_type"))
    return t.read("part").select("p_partkey", T.query_tokens(asked).alias("tokens"))


@query("TXT-04_expand_token", f"SELECT p_partkey, coalesce((MAP({listed(T.SYNONYM_INDEX)}, [{', '.join(listed(g) for g in T.SYNONYM_INDEX.values())}]))[w], [w]) AS variants FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN ({listed(T.SYNONYM_INDEX)})[p_partkey % {len(T.SYNONYM_INDEX)} + 1] ELSE split_part(p_name, ' ', 1) END AS w FROM part)")
def expand_token(t):
    known = F.get(F.array(*[F.lit(x) for x in T.SYNONYM_INDEX]), (F.col("p_partkey") % len(T.SYNONYM_INDEX)).cast("int"))
    word = F.when(F.col("p_partkey") % 2 == 0, known).otherwise(F.split_part("p_name", F.lit(" "), F.lit(1)))
    return t.read("part").select("p_partkey", T.expand_token(word).alias("variants"))


@query("TXT-17_identity_hash", """SELECT identity, 'ph_' || lpad(lower(to_hex(list_reduce(list_concat([14695981039346656037::UHUGEINT], list_transform(string_split(identity, ''), lambda c: ascii(c)::UHUGEINT)), lambda h, c: (xor(h, c) * 1099511628211) % 18446744073709551616))), 16, '0') AS hash FROM identities""")
def identity_hash(t):
    return t.identities.select("identity", F.concat(F.lit("ph_"), I.fnv64(F.col("identity"))).alias("hash"))


#: Names of food by number, with their family, form, processing and how they hold strawberries.
FOODS = (
    ("chicken nuggets", "chicken", "nuggets", False, None),
    ("beef burger", "prepared", "burger", False, None),
    ("milk powder strawberry flavour", "powder", None, False, "flavored"),
    ("strawberry milk", "milk", None, False, "product"),
    ("fresh strawberries", "strawberry", None, False, "product"),
    ("frozen strawberries", "strawberry", None, True, "product"),
    ("حليب بنكهة الفراولة", "milk", None, False, "flavored"),
    ("عصير بالفراولة", "juice", None, False, "flavored"),
    ("سمك فيليه", "fish", "fillet", False, None),
    ("lemon substitute", None, None, False, None),
    ("tomato paste", "sauce", None, False, None),
    ("طماطم مجمدة", "tomato", None, True, None),
    ("plain", None, None, False, None),
)


def foods(t):
    k = F.col("p_partkey")
    food = F.get(F.array(*[F.lit(x[0]) for x in FOODS]), (k % len(FOODS)).cast("int"))
    return T.with_words(t.read("part").withColumn("food", F.concat_ws(" ", F.col("p_type"), food)), "food", "x")


def food_sql(i):
    return f"({listed([x[i] for x in FOODS])})[p_partkey % {len(FOODS)} + 1]"


@query("CLS-01_family", f"SELECT p_partkey, {food_sql(1)} AS family FROM part")
def family(t):
    return foods(t).select("p_partkey", Fm.family(F.col("x_words")).alias("family"))


@query("CLS-02_product_type", f"SELECT p_partkey, {food_sql(2)} AS type FROM part")
def product_type(t):
    return foods(t).select("p_partkey", Fm.product_type(F.col("x_words")).alias("type"))


@query("CLS-03_produce", f"SELECT p_partkey, ({food_sql(3)})::BOOLEAN AS processed, {food_sql(4)} AS presence, p_partkey % {len(FOODS)} IN (3, 4, 6, 7, 9, 10, 12, 0, 8, 1) AND {food_sql(2)} IS NULL AND coalesce({food_sql(4)}, '') <> 'flavored' AND NOT ({food_sql(3)})::BOOLEAN AS fresh FROM part")
def produce(t):
    ws = F.col("x_words")
    berries = tuple(Fm.PRODUCE_FAMILIES["strawberry"])
    return foods(t).select("p_partkey", I.is_processed(ws).alias("processed"), I.produce_presence(ws, berries).alias("presence"), I.fresh(ws, Fm.product_type(ws), "strawberry").alias("fresh"))


#: Second names of the parts by number, and the brand that each alone names (in the department ECONOMY only: puck).
SECOND_NAMES = (("عصير الربيع", "alrabie"), ("الوزن الصافي", None), ("زبدة لورباك", "lurpak"), ("puuck cheese", "puck"), ("كيري جولد", None), ("جبنة كيري", "kiri"), ("عصير والصافي", None), ("زهور الربيع", None), ("fine", None))
BRANDS = (
    ("ring", "ringer", ["PROMO"], False, None, None),
    ("hot", "hotline", None, False, None, ["rod"]),
    ("smal", "smalley", None, False, None, None),
    ("Puck", "puck", ["ECONOMY"], False, None, None),
    ("الصافي", "alsafi", None, True, ["الوزن", "وزن"], None),
    ("الربيع", "alrabie", None, False, ["زهور"], None),
    ("لورباك", "lurpak", None, False, None, None),
    ("كيري", "kiri", None, False, None, ["جولد", "gold"]),
    ("fine", "fine", None, False, None, None),
)


@query("CLS-05_detect_brand", f"""SELECT p_partkey, CASE WHEN p_name LIKE 'hot %' AND p_name <> 'hot rod' THEN 'hotline' WHEN p_name LIKE 'small %' THEN 'smalley' WHEN p_name LIKE '% ring' AND p_type = 'PROMO' THEN 'ringer'
  WHEN p_partkey % 9 = 3 AND p_type <> 'ECONOMY' THEN NULL ELSE ({listed([b for _, b in SECOND_NAMES])})[p_partkey % 9 + 1] END AS brand FROM part""")
def brand(t):
    schema = "word string, slug string, departments array<string>, no_strip boolean, veto_before array<string>, veto_after array<string>, place int"
    table = t.spark.createDataFrame([(*b, i) for i, b in enumerate(BRANDS)], schema)
    second = F.get(F.array(*[F.lit(x) for x, _ in SECOND_NAMES]), (F.col("p_partkey") % len(SECOND_NAMES)).cast("int"))
    df = t.read("part").withColumn("second", second)
    return I.detect_brand(df, ["p_name", "second"], table, "p_partkey", "p_type").select("p_partkey", F.col("brand_found").alias("brand"))


SCHEDULES = ("*/20 * * * *", "0 6 * * 3", "0 0 31 2 *", "30 4 1,15 * 5")


@query("DAT-03_cron_next", f"""SELECT event_id, ({listed(SCHEDULES)})[event_id % 4 + 1] AS schedule, CASE event_id % 4 WHEN 0 THEN time_bucket(INTERVAL 20 MINUTE, ts::TIMESTAMP) + INTERVAL 20 MINUTE
  WHEN 1 THEN (SELECT min(d) FROM (SELECT ts::DATE::TIMESTAMP + to_days(i::INTEGER) + INTERVAL 6 HOUR AS d FROM range(0, 9) r(i)) WHERE d > ts::TIMESTAMP AND dayofweek(d) = 3)
  WHEN 3 THEN (SELECT min(d) FROM (SELECT ts::DATE::TIMESTAMP + to_days(i::INTEGER) + INTERVAL 270 MINUTE AS d FROM range(0, 9) r(i)) WHERE d > ts::TIMESTAMP AND (dayofweek(d) = 5 OR day(d) IN (1, 15))) END AS next_at FROM events""")
def cron(t):
    import pyarrow as pa

    def run(batches):
        for b in batches:
            at = [H.cron_next(s, x) for s, x in zip(b.column("schedule").to_pylist(), b.column("ts").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("event_id"), b.column("schedule"), pa.array(at, pa.timestamp("us"))], names=["event_id", "schedule", "next_at"])

    schedule = F.get(F.array(*[F.lit(x) for x in SCHEDULES]), (F.col("event_id") % 4).cast("int"))
    e = t.read("events").select("event_id", schedule.alias("schedule"), F.col("ts").cast("timestamp_ntz").alias("ts"))
    return e.mapInArrow(run, "event_id bigint, schedule string, next_at timestamp_ntz")


# offers ------------------------------------------------------------------------------------------------------------

RAW = "raw AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, p_name, p_size, l_linenumber <> 7 AND l_quantity > 2 AS priced, l_orderkey % 5 <> 0 AS referenced, CAST(floor(l_extendedprice / l_quantity * 100 + 0.5) AS BIGINT) AS price_cents FROM lineitem JOIN part ON l_partkey = p_partkey)"
BUILT = f"{RAW}, built AS (SELECT concat_ws(':', l_suppkey, l_partkey, l_orderkey, l_linenumber, strftime(l_shipdate, '%Y%m%d'), CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS id, lower(p_name) || ' ' || p_size || 'ml' AS name, price_cents, CASE WHEN referenced THEN l_orderkey END AS edition, concat_ws('|', l_suppkey, p_name, p_size) AS identity, CAST(date_trunc('week', l_shipdate) AS DATE) AS valid_from, l_linenumber AS line FROM raw WHERE priced AND price_cents > 0)"


def raw_offers(t):
    """Flyer offers as a source gives them: price and description as text."""
    li, p = t.read("lineitem"), t.read("part")
    j = li.join(p, li.l_partkey == p.p_partkey)
    price = cents(F.col("l_extendedprice") / F.col("l_quantity"))
    first = ["l_suppkey", "l_partkey", "l_orderkey", "l_linenumber"]
    return j.select(
        F.concat_ws(":", *[text(c) for c in first], F.date_format("l_shipdate", "yyyyMMdd"), text(cents(F.col("l_extendedprice")))).alias("id"),
        F.when((F.col("l_linenumber") != 7) & (F.col("l_quantity") > 2), F.concat(F.lit("SAR "), (price / 100).cast("decimal(18,2)").cast("string"))).otherwise("0").alias("price"),
        F.concat(F.lit("NOW ONLY\n"), "p_name", F.lit(" "), text("p_size"), F.lit("ml\n15.00")).alias("description"),
        F.when(F.col("l_orderkey") % 5 != 0, F.col("l_orderkey")).alias("flyer_ref"),
        text("l_suppkey").alias("store"),
        "p_name",
        F.col("p_size").alias("size"),
        F.date_trunc("week", "l_shipdate").cast("date").alias("valid_from"),
        F.col("l_linenumber").alias("line"),
    )


def built_offers(t):
    """Gates, names, the edition that a flyer number names, identity."""
    r = raw_offers(t).withColumn("price_cents", F.floor(C.money(F.col("price")) * 100 + 0.5).cast("bigint")).where("price_cents > 0")
    r = r.withColumn("name", N.derive_names(F.col("description"))["name"]).where("name is not null")
    editions = t.read("orders").select(F.col("o_orderkey").alias("flyer_ref"), F.col("o_orderkey").alias("edition"))
    r = r.join(editions, "flyer_ref", "left")
    return r.select("id", "name", "price_cents", "edition", F.concat_ws("|", "store", "p_name", text("size")).alias("identity"), "valid_from", "line", "store", "size")


@query("OFF-01_offer_build", f", {BUILT} SELECT id, name, price_cents, edition, identity, valid_from FROM built")
def offer_build(t):
    return built_offers(t).select("id", "name", "price_cents", "edition", "identity", "valid_from")


@query("OFF-01_ingest_report", f""", {BUILT}, old_points AS (SELECT identity, valid_from, min(price_cents) AS p FROM built WHERE line <= 3 GROUP BY 1, 2), new_points AS (SELECT identity, valid_from, min(price_cents) AS p FROM built GROUP BY 1, 2)
SELECT (SELECT count(*) FROM raw) AS fetched, (SELECT count(*) FROM built) AS stored, (SELECT count(*) FROM raw) - (SELECT count(*) FROM built) AS dropped, (SELECT count(edition) FROM built) AS linked, (SELECT count(DISTINCT id) FROM built WHERE id NOT IN (SELECT id FROM built WHERE line <= 3)) AS added, (SELECT count(*) FROM new_points n LEFT JOIN old_points o USING (identity, valid_from) WHERE o.p IS NULL OR o.p <> n.p) AS points""")
def ingest_report(t):
    made = built_offers(t)
    ids = lambda df: df.select("id").distinct()
    old = made.where("line <= 3")
    points = lambda df: weekly_points(df.withColumns({"valid_to": F.date_add("valid_from", 6), "region": F.lit("x"), "old_cents": F.lit(None).cast("bigint")})).select("identity", "week", "price_cents")
    fresh = points(made).join(points(old).withColumnRenamed("price_cents", "was"), ["identity", "week"], "left").where("was is null or was <> price_cents")
    return H.one_row({
        "fetched": t.read("lineitem").agg(F.count("*")),
        "stored": made.agg(F.count("*")),
        "dropped": raw_offers(t).select("price").agg(F.count_if(F.coalesce(C.money(F.col("price")), F.lit(0.0)) <= 0)),
        "linked": made.agg(F.count("edition")),
        "added": S.insert_absent(ids(old), ids(made), "id").agg(F.count("*")),
        "points": fresh.agg(F.count("*")),
    })


# searches ----------------------------------------------------------------------------------------------------------


@query("SEA-01_search", f""", hits AS (SELECT id, brand, price_cents FROM offers WHERE valid_to >= DATE '{TODAY}' AND name = 'red ring' ORDER BY price_cents, id LIMIT 40),
own AS (SELECT h.id, h.brand, h.price_cents, s.product_id, s.match_band FROM hits h LEFT JOIN sightings s ON h.id = s.offer_id),
seeds AS (SELECT DISTINCT product_id, brand FROM own WHERE match_band IN ('auto', 'created')),
more AS (SELECT o.id, o.price_cents, s.product_id, s.match_band FROM offers o JOIN sightings s ON o.id = s.offer_id JOIN seeds d ON s.product_id = d.product_id AND o.brand = d.brand WHERE s.match_band IN ('auto', 'created') AND o.valid_to >= DATE '{TODAY}' AND o.id NOT IN (SELECT id FROM hits) ORDER BY o.price_cents, o.id LIMIT 20)
SELECT id, 5 AS stage, 1 AS fam_rank, price_cents, product_id, match_band, FALSE AS sibling FROM own UNION ALL SELECT id, NULL, NULL, price_cents, product_id, match_band, TRUE FROM more""")
def search(t):
    named = B.canonical(t.current_offers, t.enrichments)
    found = Se.search(named, T.Query.of("red ring"), "canon_name", "search_text", "brand", 40, F.col("category"))
    out = Se.with_siblings(found.select("id", "brand", "price_cents", "stage", "fam_rank"), t.current_offers, t.sightings)
    return out.select("id", "stage", "fam_rank", "price_cents", "product_id", "match_band", "sibling")


POOL = """pool AS (SELECT * FROM (SELECT s_suppkey % 20 AS q, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_extendedprice AS id, l_extendedprice AS price, CASE WHEN p_size > 45 THEN 5 WHEN p_size > 10 THEN 4 ELSE 2 END AS stage, CASE WHEN p_type IN ('PROMO', 'LARGE', 'SMALL') THEN 'a' WHEN p_type = 'ECONOMY' THEN 'b' END AS family, CASE WHEN p_brand LIKE 'Brand#1%' THEN 'x' WHEN p_brand LIKE 'Brand#2%' THEN 'y' END AS type, p_size % 3 <> 0 AS fresh
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey) QUALIFY row_number() OVER (PARTITION BY q ORDER BY price, id) <= 300)"""


def ladder_sql(primary: bool, dominant: bool, never_empty: bool) -> str:
    gate = lambda n, out, was: f"CASE WHEN {was} IS NOT NULL THEN {was} WHEN coalesce({out}, FALSE)" + (f" AND count(*) FILTER ({was} IS NULL AND NOT coalesce({out}, FALSE)) OVER (PARTITION BY q) > 0" if never_empty else "") + f" THEN '{n}' END"
    lead = "coalesce(named, max(CASE WHEN e1 IS NULL AND family IS NOT NULL AND same >= 2 AND same * 2 > known THEN family END) OVER (PARTITION BY q))" if dominant else "named"
    band = "CASE WHEN q % 2 = 1 THEN least(stage, 2) ELSE " + ("least(stage, 4)" if primary else "stage") + " END"
    fresh = "fresh_family IS NOT NULL AND (target IS NULL OR target = fresh_family) AND NOT fresh"
    return f""", {POOL}, s0 AS (SELECT *, {band} AS band, CASE WHEN q % 4 = 0 THEN 'a' END AS named, CASE WHEN q % 3 = 0 THEN 'a' END AS fresh_family FROM pool), s AS (SELECT *, CASE WHEN band < max(band) OVER (PARTITION BY q) THEN 'stage' END AS e1 FROM s0),
  f AS (SELECT *, count(*) FILTER (e1 IS NULL AND family IS NOT NULL) OVER (PARTITION BY q) AS known, count(*) FILTER (e1 IS NULL AND family IS NOT NULL) OVER (PARTITION BY q, family) AS same FROM s),
  g AS (SELECT *, {lead} AS target FROM f), h AS (SELECT *, {gate('family', 'family <> target', 'e1')} AS e2 FROM g), i AS (SELECT *, {gate('type', "type <> 'x'", 'e2')} AS e3 FROM h)
  SELECT q, id, target AS target_family, {gate('fresh', fresh, 'e3')} AS excluded FROM i"""


def pooled(t):
    li, p, s = t.read("lineitem"), t.read("part"), t.read("supplier")
    j = li.join(p, li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey)
    pool = j.select(
        (F.col("s_suppkey") % 20).alias("q"),
        F.concat_ws("-", text("l_orderkey"), text("l_linenumber"), text("l_partkey"), text("l_extendedprice")).alias("id"),
        F.col("l_extendedprice").alias("price"),
        F.when(F.col("p_size") > 45, 5).when(F.col("p_size") > 10, 4).otherwise(2).alias("stage"),
        F.when(F.col("p_type").isin("PROMO", "LARGE", "SMALL"), "a").when(F.col("p_type") == "ECONOMY", "b").alias("family"),
        F.when(F.col("p_brand").startswith("Brand#1"), "x").when(F.col("p_brand").startswith("Brand#2"), "y").alias("type"),
        (F.col("p_size") % 3 != 0).alias("fresh"),
    )
    # a journey's pool is what its search retrieved: 300 candidates at most, cut before the shuffle
    return first_n(pool, ["q"], 300, "price", "id")


def laddered(t, policy):
    named, produce = F.when(F.col("q") % 4 == 0, "a"), F.when(F.col("q") % 3 == 0, "a")
    out = Se.ladder(pooled(t), ["q"], Se.POLICIES[policy], F.col("q") % 2 == 1, named, F.lit("x"), None, produce, F.col("fresh"))
    return out.select("q", "id", "target_family", "excluded")


@query("LAD-01_gate_ladder", ladder_sql(False, True, True))
def ladder_summary(t):
    return laddered(t, "summary")


@query("LAD-01_alert", ladder_sql(False, True, False))
def ladder_alert(t):
    return laddered(t, "alert")


@query("LAD-01_history", ladder_sql(True, False, True))
def ladder_history(t):
    return laddered(t, "history")


# watches -----------------------------------------------------------------------------------------------------------

#: What the watches ask for, by number.
ASKED = ("red ring", "ring", "rings red", "gear", "blue gear", "hot rod", "anvil hot")


@query("WAT-01_grocery_watch", f""", watch AS (SELECT c_custkey AS watch, ({listed(ASKED)})[c_custkey % {len(ASKED)} + 1] AS asked, c_custkey % 50 + 1 AS wanted FROM customer),
market AS (SELECT id, store, name, size, price_cents FROM offers WHERE valid_to >= DATE '{TODAY}' UNION ALL SELECT 'on' || p_partkey, 'online', p_name, p_size, CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) FROM part),
met AS (SELECT w.watch, m.*, CASE WHEN asked IN ('ring', 'gear') THEN CASE WHEN m.name = 'new ' || asked THEN 5 ELSE 4 END ELSE 2 END AS band FROM watch w JOIN market m
  ON CASE asked WHEN 'ring' THEN m.name LIKE '% ring' WHEN 'gear' THEN m.name LIKE '% gear' WHEN 'anvil hot' THEN m.name = 'hot anvil' WHEN 'rings red' THEN FALSE ELSE m.name = asked END AND abs(m.size - wanted) * 4 <= greatest(m.size, wanted)),
kept AS (SELECT * FROM met QUALIFY band = max(band) OVER (PARTITION BY watch))
SELECT watch, min(price_cents) AS price_cents, arg_min(id, (price_cents, id)) AS id, arg_min(store, (price_cents, id)) AS store, count(*) AS candidates FROM kept GROUP BY 1""")
def grocery_watch(t):
    asked = F.get(F.array(*[F.lit(x) for x in ASKED]), (F.col("c_custkey") % len(ASKED)).cast("int"))
    w = t.read("customer").select(F.col("c_custkey").alias("watch"), asked.alias("asked"), (F.col("c_custkey") % 50 + 1).alias("wanted"))
    flyers = t.current_offers.select("id", "store", "name", "size", "price_cents")
    online = t.read("part").select(F.concat(F.lit("on"), text("p_partkey")).alias("id"), F.lit("online").alias("store"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), cents(F.col("p_retailprice")).alias("price_cents"))
    return Wt.grocery(w, flyers.unionByName(online), ASKED)


RESULTS = "results AS (SELECT s_suppkey % 4 AS provider, 'id' || (s_suppkey % 50) AS id, '/p/' || (s_suppkey * 3) || '-x' AS link, s_suppkey AS place, CASE WHEN s_suppkey % 5 <> 0 THEN CAST(floor(s_acctbal * 100 + 0.5) AS BIGINT) END AS price_cents FROM supplier)"


@query("WAT-02_product_watch", f""", {RESULTS}, watch AS (SELECT c_custkey AS watch, c_custkey % 4 AS provider, CASE WHEN c_custkey % 2 = 0 THEN 'id' || (c_custkey % 60) ELSE (c_custkey % 400)::VARCHAR END AS product FROM customer),
hits AS (SELECT w.watch, r.*, r.id = w.product AS exact FROM watch w JOIN results r ON w.provider = r.provider AND (r.id = w.product OR regexp_extract(r.link, '/p/([0-9]+)-', 1) = w.product)),
one AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY watch ORDER BY exact DESC, place) = 1) SELECT w.watch, CASE WHEN one.price_cents > 0 THEN one.price_cents END AS price_cents, CASE WHEN one.watch IS NULL THEN 'not found' WHEN one.price_cents > 0 THEN 'priced' ELSE 'no price' END AS note FROM watch w LEFT JOIN one ON w.watch = one.watch""")
def product_watch(t):
    k = F.col("c_custkey")
    w = t.read("customer").select(k.alias("watch"), (k % 4).alias("provider"), F.when(k % 2 == 0, F.concat(F.lit("id"), text(k % 60))).otherwise(text(k % 400)).alias("product"))
    s = F.col("s_suppkey")
    r = t.read("supplier").select((s % 4).alias("provider"), F.concat(F.lit("id"), text(s % 50)).alias("id"), F.concat(F.lit("/p/"), text(s * 3), F.lit("-x")).alias("link"), s.alias("place"), F.when(s % 5 != 0, cents(F.col("s_acctbal"))).alias("price_cents"))
    return Wt.products_found(w, r)


@query("WAT-02_registry_watch", f"""SELECT p.id AS watch, coalesce(v.id, p.id) AS product_id, coalesce(v.display_name, p.display_name) AS name, b.price_cents, b.id FROM products p LEFT JOIN products v ON p.status = 'merged' AND p.merged_into = v.id
JOIN (SELECT product_id, min(price_cents) AS price_cents, arg_min(id, (price_cents, id)) AS id FROM (SELECT coalesce(p.merged_into, s.product_id) AS product_id, o.price_cents, o.id FROM sightings s JOIN offers o ON s.offer_id = o.id LEFT JOIN products p ON s.product_id = p.id AND p.status = 'merged' WHERE o.valid_to >= DATE '{TODAY}') GROUP BY 1) b ON b.product_id = coalesce(v.id, p.id)""")
def registry_watch(t):
    return Wt.registry_best(t.products.select(F.col("id").alias("watch")), t.products, t.sightings, t.current_offers)


@query("WAT-03_alerts", """SELECT id, watch, price, 'Watch ' || watch || ': now SAR ' || (price // 100) || '.' || lpad((price % 100)::VARCHAR, 2, '0') || ' (target SAR 30.00)' AS note FROM (SELECT *, lag(price <= 3000) OVER (PARTITION BY watch ORDER BY ts, id) AS before FROM
  (SELECT event_id AS id, user_id AS watch, ts, CASE WHEN event_type <> 'error' THEN CAST(floor(value * 100 + 0.5) AS BIGINT) END AS price FROM events) WHERE price IS NOT NULL) WHERE price <= 3000 AND NOT coalesce(before, FALSE)""")
def alerts(t):
    from shelfwise.plans.history import evaluations

    found = Wt.crossings(evaluations(t), "watch", ["ts", "id"], "price", F.lit(3000))
    return found.select("id", "watch", "price", Wt.notification(text("watch"), F.col("price"), F.lit(3000)).alias("note"))


# operations --------------------------------------------------------------------------------------------------------


@query("HEA-02_subsystems", """, last AS (SELECT action, max(id) FILTER (ok) AS last_ok, max(id) FILTER (NOT ok) AS last_fail, max(ts) FILTER (ok) AS ok_at, avg(ok::INTEGER) AS share FROM runs GROUP BY action),
grid AS (SELECT action AS subsystem, CASE WHEN last_fail IS NOT NULL AND (last_ok IS NULL OR last_fail > last_ok) THEN 'FAIL' WHEN ok_at < (SELECT max(ts) FROM runs) - INTERVAL 6 HOUR THEN 'STALE' ELSE 'PASS' END AS status, floor(share * 1000 + 0.5) / 10 AS ok_percent FROM last)
SELECT subsystem, status, ok_percent FROM grid UNION ALL SELECT 'health', CASE WHEN bool_and(status = 'PASS') THEN 'PASS' WHEN bool_or(status = 'FAIL') THEN 'FAIL' ELSE 'STALE' END, floor(count(*) FILTER (status = 'PASS') * 1000::DOUBLE / count(*) + 0.5) / 10 FROM grid""")
def subsystems(t):
    return H.subsystem_grid(t.runs.withColumnRenamed("action", "subsystem"), 6)


@query("HEA-03_progress", """, cron AS (SELECT action, max(ts) AS last FROM runs GROUP BY action), numbers AS (
  SELECT 'progress' AS section, 'enriched_percent' AS key, floor((SELECT count(e_name) FROM enrichments) * 1000::DOUBLE / (SELECT count(*) FROM offers) + 0.5) / 10 AS value
  UNION ALL SELECT 'queue', 'unresolved', (SELECT count(*) FROM enrichments WHERE mint_verdict IS NULL AND e_name IS NOT NULL)
  UNION ALL SELECT 'cron', action, (last < (SELECT max(ts) FROM runs) - INTERVAL 2 HOUR)::INTEGER FROM cron
  UNION ALL SELECT 'stage', 'offers', (SELECT count(*) FROM offers) UNION ALL SELECT 'stage', 'read', (SELECT count(*) FROM enrichments) UNION ALL SELECT 'stage', 'minted', (SELECT count(*) FROM enrichments WHERE mint_verdict = 'minted') UNION ALL SELECT 'stage', 'resolved', (SELECT count(*) FROM sightings WHERE match_band <> 'review')
  UNION ALL SELECT 'latency', 'p50_cents', (SELECT floor(quantile_cont(elapsed_cents, 0.5) + 0.5) FROM runs WHERE ok) UNION ALL SELECT 'latency', 'p95_cents', (SELECT floor(quantile_cont(elapsed_cents, 0.95) + 0.5) FROM runs WHERE ok))
SELECT section, key, value::DOUBLE AS value FROM numbers""")
def progress(t):
    count = lambda df: df.agg(F.count("*").cast("double").alias("value"))
    row = lambda section, key, df: df.select(F.lit(section).alias("section"), F.lit(key).alias("key"), F.col("value").cast("double").alias("value"))
    read = H.one_row({"a": t.enrichments.agg(F.count("e_name")), "b": t.offers.agg(F.count("*"))}).select(H.percent(F.col("a"), F.col("b")).alias("value"))
    ok = t.runs.where("ok")
    latency = lambda q: ok.agg(F.floor(F.percentile("elapsed_cents", F.lit(q)) + 0.5).alias("value"))
    rows = [
        row("progress", "enriched_percent", read),
        row("queue", "unresolved", count(t.enrichments.where("mint_verdict is null and e_name is not null"))),
        H.silent_schedules(t.runs, "action", "ts", 2).select(F.lit("cron").alias("section"), F.col("action").alias("key"), F.col("silent").cast("double").alias("value")),
        row("stage", "offers", count(t.offers)),
        row("stage", "read", count(t.enrichments)),
        row("stage", "minted", count(t.enrichments.where("mint_verdict = 'minted'"))),
        row("stage", "resolved", count(t.sightings.where("match_band <> 'review'"))),
        row("latency", "p50_cents", latency(0.5)),
        row("latency", "p95_cents", latency(0.95)),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query("HEA-05_product_detail", "SELECT p.id, p.status, p.merged_into, p.review_flag, count(s.offer_id) AS sightings, count(DISTINCT s.store) AS stores, min(s.price_cents) AS lowest, max(s.week) AS last_week, count(*) FILTER (s.match_band = 'review') AS in_review FROM products p LEFT JOIN sightings s ON p.id = s.product_id GROUP BY ALL")
def product_detail(t):
    s = t.sightings.groupBy(F.col("product_id").alias("id")).agg(F.count("*").alias("n"), F.countDistinct("store").alias("n_stores"), F.min("price_cents").alias("lowest"), F.max("week").alias("last_week"), F.count_if(F.col("match_band") == "review").alias("n_review"))
    zero = lambda c, a: F.coalesce(c, F.lit(0)).alias(a)
    return t.products.select("id", "status", "merged_into", "review_flag").join(s, "id", "left").select("id", "status", "merged_into", "review_flag", zero("n", "sightings"), zero("n_stores", "stores"), "lowest", "last_week", zero("n_review", "in_review"))


@query("HEA-05_heal_report", "SELECT (SELECT count(*) FROM sightings s ANTI JOIN (SELECT id FROM offers WHERE tax > 0.01) o ON s.offer_id = o.id) AS dangling_sightings, (SELECT count(*) FROM enrichments e ANTI JOIN (SELECT id FROM offers WHERE tax > 0.01) o ON e.id = o.id) AS orphan_readings, (SELECT count(*) FROM sightings s ANTI JOIN products p ON s.product_id = p.id) AS without_product, (SELECT count(*) FROM products p JOIN products v ON p.merged_into = v.id WHERE v.status = 'merged') AS chained, (SELECT count(*) FROM products WHERE status = 'merged' AND merged_into IS NULL) AS lost")
def heal_report(t):
    kept = t.offers.where("tax > 0.01").select("id")
    p = t.products
    return H.one_row({
        "dangling_sightings": t.sightings.select(F.col("offer_id").alias("id")).join(kept, "id", "left_anti").agg(F.count("*")),
        "orphan_readings": t.enrichments.select("id").join(kept, "id", "left_anti").agg(F.count("*")),
        "without_product": t.sightings.select(F.col("product_id").alias("id")).join(p.select("id"), "id", "left_anti").agg(F.count("*")),
        "chained": p.select(F.col("merged_into").alias("id")).join(p.where("status = 'merged'").select("id"), "id").agg(F.count("*")),
        "lost": p.where("status = 'merged' and merged_into is null").agg(F.count("*")),
    })


@query("HEA-05_offer_inspector", "SELECT o.id, e.corroboration, e.mint_verdict, s.match_band, s.product_id, p.status AS product_status FROM offers o LEFT JOIN enrichments e ON o.id = e.id LEFT JOIN sightings s ON o.id = s.offer_id LEFT JOIN products p ON s.product_id = p.id WHERE o.line IN (1, 6)")
def offer_inspector(t):
    own = t.offers.where("line in (1, 6)").select("id")
    j = own.join(t.enrichments.select("id", "corroboration", "mint_verdict"), "id", "left").join(t.sightings.select(F.col("offer_id").alias("id"), "match_band", "product_id"), "id", "left")
    return j.join(t.products.select(F.col("id").alias("product_id"), F.col("status").alias("product_status")), "product_id", "left").select("id", "corroboration", "mint_verdict", "match_band", "product_id", "product_status")


@query("ENR-01_enrichment_drain", "SELECT page_id, CASE WHEN page_id % 11 = 3 THEN 'skipped' WHEN page_id % 7 = 2 THEN 'declined' ELSE 'read' END AS outcome, CASE WHEN page_id % 11 <> 3 AND page_id % 7 <> 2 THEN regexp_extract(html, '<title>([^<]*)</title>', 1) END AS name FROM pages")
def enrichment(t):
    def model(key, item, content):
        # stands for the external model, which a caller injects
        if item % 11 == 3:
            raise ValueError("unreadable")
        if key == "dead":
            raise C.Refused("auth")
        if item % 7 == 2:
            return None
        return content.partition("<title>")[2].partition("</title>")[0]

    rows = t.read("pages").select(F.col("page_id").cast("bigint").alias("id"), F.col("html").alias("content"))
    return C.enriched(rows, model, ["dead", "live"]).select(F.col("id").alias("page_id"), "outcome", "name")


@query("SCH-01_fan_out", "SELECT n_name AS store, count(s_suppkey) > 0 AS ok, CASE WHEN count(s_suppkey) > 0 THEN count(s_suppkey) END AS suppliers FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_name")
def fan_out(t):
    # one job a store (the nations are a fixed list of 25); one without suppliers fails, the others go on
    supplier = t.read("supplier")

    def job(key):
        def run():
            n = supplier.where(F.col("s_nationkey") == key).count()
            if not n:
                raise LookupError("no suppliers")
            return n

        return run

    done = C.settled({r.n_name: job(r.n_nationkey) for r in t.read("nation").select("n_nationkey", "n_name").collect()})
    return t.spark.createDataFrame([(k, ok, v if ok else None) for k, (ok, v) in done.items()], "store string, ok boolean, suppliers bigint")
