"""Connectors: strategies tried best first, nested product JSON, search pages, flight text, flyer listings, geometry.

Fetching is a callable that a caller injects; everything after it is DataFrame work over the fetched texts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RESULT = "id string, name string, image string, price double, old_price double, currency string, link string, size string, brand string, discount_label string"


@dataclass(frozen=True)
class Provider:
    """A store with its strategies, best first; each takes a search and returns rows."""

    id: str
    label: str
    strategies: tuple[tuple[str, Callable[[str], list]], ...]


class AllFailed(RuntimeError):
    pass


def run_provider(provider: Provider, search: str) -> tuple[list, str, list[str]]:
    """Rows, strategy used and failures of the first strategy that finds anything; raises if none does."""
    failures: list[str] = []
    for name, strategy in provider.strategies:
        try:
            rows = strategy(search)
        except Exception as error:  # a failing strategy gives way to the next one
            failures.append(f"{name}: {error}")
            continue
        if rows:
            return rows, name, failures
        failures.append(f"{name}: empty")
    raise AllFailed(f"{provider.id}: {'; '.join(failures)}")


class _Reader(DataSourceReader):
    def __init__(self, provider: Provider, searches: list[str]):
        self.provider, self.searches = provider, searches

    def partitions(self):
        return [InputPartition(s) for s in self.searches]

    def read(self, partition) -> Iterator[tuple]:
        try:
            rows, _, _ = run_provider(self.provider, partition.value)
        except AllFailed:
            return
        for r in rows:
            yield tuple(r)


def provider_source(provider: Provider) -> type[DataSource]:
    """A batch data source of a provider: one partition a search, so that searches run side by side."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return f"provider_{provider.id}"

        def schema(self) -> str:
            return RESULT

        def reader(self, schema):
            return _Reader(provider, json.loads(self.options.get("searches", "[]")))

    return Source


def live_search(spark: SparkSession, provider: Provider, searches: Iterable[str]) -> DataFrame:
    source = provider_source(provider)
    spark.dataSource.register(source)
    return spark.read.format(source.name()).option("searches", json.dumps(list(searches))).load()


def signed(method: str, host: str, path: str, headers: dict[str, str], body: str, access: str, secret: str, region: str, service: str, at: str) -> dict[str, str]:
    """``headers`` with the date ``at`` (YYYYMMDDTHHMMSSZ) and an Authorization by the public AWS4-HMAC-SHA256 scheme."""
    import hashlib
    import hmac

    sent = {"host": host, "x-amz-date": at} | {k.lower(): v.strip() for k, v in headers.items()}
    names = ";".join(sorted(sent))
    listed = "".join(f"{k}:{sent[k]}\n" for k in sorted(sent))
    request = "\n".join((method, path, "", listed, names, hashlib.sha256(body.encode()).hexdigest()))
    scope = (at[:8], region, service, "aws4_request")
    key = f"AWS4{secret}".encode()
    for part in scope:
        key = hmac.digest(key, part.encode(), "sha256")
    text = "\n".join(("AWS4-HMAC-SHA256", at, "/".join(scope), hashlib.sha256(request.encode()).hexdigest()))
    mark = hmac.digest(key, text.encode(), "sha256").hex()
    return sent | {"authorization": f"AWS4-HMAC-SHA256 Credential={access}/{'/'.join(scope)}, SignedHeaders={names}, Signature={mark}"}


def signed_search(fetch: Callable[[str, str, dict, str], str], host: str, access: str, secret: str, region: str, service: str, clock: Callable[[], str]) -> Callable[[str], list]:
    """A provider's strategy that asks a signed search API; ``fetch`` (method, address, headers, body) does the request."""

    def run(search: str) -> list:
        body = json.dumps({"Keywords": search, "ItemCount": 10})
        head = signed("POST", host, "/paapi5/searchitems", {"content-type": "application/json; charset=utf-8"}, body, access, secret, region, service, clock())
        return answer_items(fetch("POST", f"https://{host}/paapi5/searchitems", head, body))

    return run


def answer_items(answer: str) -> list:
    """Rows of a search API's answer: title, first listing's price, and its basis of saving where that is higher."""
    rows = []
    for item in (json.loads(answer).get("SearchResult") or {}).get("Items") or []:
        listing = next(iter((item.get("Offers") or {}).get("Listings") or []), {})
        price, basis = (float((listing.get(k) or {}).get("Amount") or 0) for k in ("Price", "SavingBasis"))
        info = item.get("ItemInfo") or {}
        title = ((info.get("Title") or {}).get("DisplayValue") or "").strip()
        brand = ((info.get("ByLineInfo") or {}).get("Brand") or {}).get("DisplayValue")
        rows.append((item["ASIN"], title, None, price or None, basis if basis > price > 0 else None, (listing.get("Price") or {}).get("Currency") or "SAR", item.get("DetailPageURL"), None, brand, None))
    return rows


def offers_source(pages: DataFrame, categories: DataFrame, full: int = 500, most: int = 1500) -> DataFrame:
    """Rows of a paged offers source (store, page, body) of one shape: store, id, category, price.

    A store's pages count up to the first that isn't full, and ``most`` rows in all (the source's own bound); of repeated
    ids the first place counts; ``categories`` (code, slug) names the categories, unknown ones are null.
    """
    p = pages.select("store", "page", F.from_json("body", "struct<rows:array<struct<id:string,category:int,price:double>>>")["rows"].alias("rows"))
    short = p.where(F.size("rows") < full).groupBy("store").agg(F.min("page").alias("_last"))
    p = p.join(short, "store", "left").where(F.col("_last").isNull() | (F.col("page") <= F.col("_last")))
    r = p.select("store", "page", F.posexplode("rows").alias("at", "r")).where((F.col("page") - 1) * full + F.col("at") < most)
    one = r.groupBy("store", F.col("r.id").alias("id")).agg(F.min(F.struct("page", "at", F.col("r.category").alias("code"), F.col("r.price").alias("price"))).alias("b"))
    named = one.select("store", "id", "b.code", "b.price").join(categories.select("code", "slug"), "code", "left")
    return named.select("store", "id", F.col("slug").alias("category"), "price")


def money(c: Column) -> Column:
    """A price from a number or text; null if it isn't one above 0."""
    v = F.regexp_replace(c.cast("string"), "[^0-9.]", "").try_cast("double")
    return F.when(v > 0, v)


def old_if_more(old: Column, price: Column) -> Column:
    return F.when(old > price, old)


PRODUCTS = "struct<products:array<struct<id:string,name:string,brand:string,image:string,varieties:array<struct<id:string,price:double,was:double,size:string>>>>>"


def product_list(pages: DataFrame, body: str = "body") -> DataFrame:
    """Products of nested JSON lists: the first variety's id, price, size; an old price only if higher; nameless ones go."""
    p = pages.select(F.explode_outer(F.from_json(F.col(body), PRODUCTS)["products"]).alias("p")).where("p.name is not null and trim(p.name) <> ''")
    v = F.get("p.varieties", 0)
    price = F.when(v["price"] > 0, v["price"])
    link = F.concat(F.lit("/product/"), F.trim(F.regexp_replace(F.lower("p.name"), "[^a-z0-9]+", "-"), F.lit("-")))
    return p.select(F.coalesce(v["id"], "p.id").alias("id"), F.col("p.name").alias("name"), F.col("p.brand").alias("brand"), price.alias("price"), old_if_more(v["was"], price).alias("old_price"), v["size"].alias("size"), link.alias("link"))


LAYOUTS = "struct<layouts:array<struct<items:array<struct<id:string,name:string,mrp:double,discount:double>>>>>"


def layout_items(pages: DataFrame, body: str = "body") -> DataFrame:
    """Items of the first layout that has any; price is mrp less discount, in whole cents."""
    layouts = F.from_json(F.col(body), LAYOUTS)["layouts"]
    first = F.get(F.filter(layouts, lambda x: F.size(x["items"]) > 0), 0)["items"]
    i = pages.select(F.explode(first).alias("i"))
    price = F.floor((F.col("i.mrp") - F.coalesce("i.discount", F.lit(0.0))) * 100 + 0.5) / F.lit(100.0)
    return i.select("i.id", "i.name", price.alias("price"), old_if_more(F.col("i.mrp"), price).alias("old_price"))


CENTS = "struct<items:array<struct<id:string,name:string,price:bigint,was:bigint,available:boolean>>>"


def cents_items(pages: DataFrame, body: str = "body", most: int = 40) -> DataFrame:
    """Available items priced in hundredths, ``most`` a page at most (the source's page size)."""
    items = F.filter(F.from_json(F.col(body), CENTS)["items"], lambda x: x["available"])
    i = pages.select(F.explode(F.slice(items, 1, most)).alias("i"))
    price = F.col("i.price") / F.lit(100.0)
    return i.select("i.id", "i.name", price.alias("price"), old_if_more(F.col("i.was") / F.lit(100.0), price).alias("old_price"))


LIST = "struct<products:array<struct<id:string,name:string,price:double,retail:double>>>"


def list_items(pages: DataFrame, body: str = "body") -> DataFrame:
    """Items of a JSON list: the retail price is the old one where it is higher, and gives the label of the discount."""
    i = pages.select(F.explode(F.from_json(F.col(body), LIST)["products"]).alias("i"))
    old = old_if_more(F.col("i.retail"), F.col("i.price"))
    label = F.concat(F.floor((old - F.col("i.price")) / old * 100 + 0.5).cast("string"), F.lit("% OFF"))
    return i.select("i.id", "i.name", "i.price", old.alias("old_price"), label.alias("label"))


def asked_again(search: Column, status: Column) -> Column:
    """What a store that refused a search of several words (status 422) is asked: the longest word, the first of equals;
    null where it isn't asked again."""
    ws = F.split(F.trim(search), r"\s+")
    longest = F.reduce(ws, F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    return F.when((status == 422) & (F.size(ws) > 1), longest)


def paged_items(pages: DataFrame, keys: list[str], page: str = "page", body: str = "body") -> DataFrame:
    """Items of a search's JSON pages, each id once: the first page, then the first place counts."""
    i = pages.select(*keys, F.col(page).alias("_p"), F.posexplode(F.from_json(F.col(body), LIST)["products"]).alias("_i", "i"))
    one = i.groupBy(*keys, F.col("i.id").alias("id")).agg(F.min(F.struct("_p", "_i", F.col("i.name").alias("name"), F.col("i.price").alias("price"))).alias("b"))
    return one.select(*keys, "id", "b.name", "b.price")


def first_good(attempts: DataFrame, key: str, attempt: str, status: str = "status", html: str = "html") -> DataFrame:
    """Of each page the first attempt that wasn't blocked; pages of blocked attempts alone are left out."""
    good = attempts.where(block_kind(F.col(status), F.col(html)).isNull())
    return good.groupBy(key).agg(F.min(F.struct(attempt, html)).alias("b")).select(key, f"b.{attempt}", f"b.{html}")


def flyer_pdfs(indexes: DataFrame, config: DataFrame) -> DataFrame:
    """(store, pdf_url, published): the current flyer of each store's index page (store, url, html, modified).

    ``config`` (store, pattern) says what its links look like; of several the one that comes last in the alphabet is
    current (links carry dates). Links within the site are made absolute; ``published`` is the day the index was modified.
    """
    links = indexes.select("store", "url", "modified", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("link")).join(config, "store").where(F.expr("link rlike pattern"))
    g = links.groupBy("store", "url", "modified").agg(F.max("link").alias("link"))
    site = F.regexp_extract("url", "^(https?://[^/]+)", 1)
    return g.select("store", F.when(F.col("link").startswith("/"), F.concat(site, "link")).otherwise(F.col("link")).alias("pdf_url"), F.to_date("modified").alias("published"))


def addresses(stores: DataFrame, config: DataFrame) -> DataFrame:
    """(key, address): the configured address of a store, or else the number that its key ends with."""
    own = F.regexp_extract("key", r"-(\d+)$", 1).try_cast("bigint")
    return stores.join(config.select("key", F.col("address").alias("_a")), "key", "left").select("key", F.coalesce("_a", own).alias("address"))


def longest_token(search: str) -> str:
    """``asked_again`` of a literal: the longest word, the first of equals."""
    return max(search.split(), key=len, default="")


def search_cards(pages: DataFrame, html: str = "html") -> DataFrame:
    """Result cards of a search page: pieces that start at a product id and hold a result marker within 200 characters."""
    pieces = F.slice(F.split(html, 'data-asin="'), 2, 1 << 30)
    c = pages.select(*[x for x in pages.columns if x != html], F.posexplode(pieces).alias("place", "c"))
    c = c.where(F.substring("c", 1, 200).contains("s-search-result"))
    first = lambda p: F.when(F.regexp_extract("c", p, 1) != "", F.regexp_extract("c", p, 1))
    price = money(first(r'class="a-offscreen">([^<]+)<'))
    was = money(first(r'data-a-strike="true"[^>]*><span class="a-offscreen">([^<]+)<'))
    heads = F.regexp_extract_all("c", F.lit(r"<h2[^>]*>(?:<[^>]+>)*([^<]+)"), F.lit(1))
    title = F.when(F.size(heads) > 1, F.get(heads, 1)).otherwise(F.get(heads, 0))
    brand = F.when(F.size(heads) > 1, F.get(heads, 0))
    keep = [x for x in pages.columns if x != html]
    return c.select(*keep, "place", F.regexp_extract("c", r'^([A-Z0-9]*)"', 1).alias("id"), unescape(title).alias("name"), unescape(brand).alias("brand"), price.alias("price"), old_if_more(was, price).alias("old_price")).where("id <> '' and name is not null")


def block_kind(status: Column, html: Column) -> Column:
    """Why a page is no result: throttled, captcha or empty; null for a good page."""
    return F.when(status.isin(429, 503), "throttled").when(F.lower(html).rlike("captcha|robot check"), "captcha").when(F.length(html) < 2000, "empty")


def unescape(c: Column) -> Column:
    """The five named entities and decimal apostrophes of HTML text."""
    for a, b in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.trim(c)


def balanced(text: str, at: int) -> str | None:
    """The innermost object in braces around a place of a text, strings respected; null if it isn't closed."""
    opens: list[int] = []
    quoted = escaped = False
    for i, ch in enumerate(text):
        if quoted:
            escaped = ch == "\\" and not escaped
            if ch == '"' and not escaped:
                quoted = False
            continue
        if ch == '"':
            quoted, escaped = True, False
        elif ch == "{":
            opens.append(i)
        elif ch == "}" and opens:
            start = opens.pop()
            if start <= at < i:
                return text[start : i + 1]
    return None


FLIGHT = "id string, name string, brand string, image string, price double"


def flight_products(pages: DataFrame, html: str = "html", most: int = 30) -> DataFrame:
    """Products embedded in pushed script chunks: reassembled, cut out around each sku, one of each, ``most`` a page."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows: dict[str, list] = {k: [] for k in ("id", "name", "brand", "image", "price")}
            for text in b.column(0).to_pylist():
                chunks = re.findall(r'self\.__next_f\.push\(\[1,("(?:[^"\\]|\\.)*")\]\)', text or "")
                body = "".join(json.loads(c) for c in chunks)
                seen: set[str] = set()
                for m in re.finditer(r'"sku"\s*:', body):
                    try:
                        item = json.loads(balanced(body, m.start()) or "null") or {}
                    except ValueError:
                        continue
                    sku = str(item.get("sku") or "")
                    if not sku or sku in seen or len(seen) >= most or not all(item.get(k) for k in ("title", "image", "brand")):
                        continue
                    seen.add(sku)
                    price = item.get("price")
                    for k, v in (("id", sku), ("name", item["title"]), ("brand", item["brand"]), ("image", item["image"]), ("price", float(price) if isinstance(price, (int, float)) else None)):
                        rows[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows[k], pa.float64() if k == "price" else pa.string()) for k in rows], names=list(rows))

    return pages.select(F.col(html).cast("string")).mapInArrow(run, FLIGHT)


def flyer_cards(pages: DataFrame, today: Column, html: str = "html", most: int = 6) -> DataFrame:
    """Flyers of a listing page: id, title and validity of each card; expired ones go, the newest ids come first."""
    cards = F.regexp_extract_all(html, F.lit(r'(?s)<article data-offer="\d+".*?</article>'), F.lit(0))
    c = pages.select(F.explode(cards).alias("c"))
    got = lambda p: F.regexp_extract("c", p, 1)
    out = c.select(got(r'data-offer="(\d+)"').cast("bigint").alias("id"), unescape(got(r"<h3[^>]*>([^<]*)<")).alias("title"), got(r'datetime="(\d{4}-\d{2}-\d{2})"').try_cast("date").alias("valid_to"), F.size(F.array_distinct(F.regexp_extract_all("c", F.lit(r'data-index="(\d+)"'), F.lit(1)))).alias("pages"))
    return out.where(F.col("valid_to").isNull() | (F.col("valid_to") >= today)).orderBy(F.desc("id")).limit(most)


POLYGONS = "array<struct<page:int,id:string,points:array<struct<x:double,y:double>>>>"


def hotspots(pages: DataFrame, polygons: str = "polygons", least: float = 0.005) -> DataFrame:
    """Boxes of polygons as fractions of the page, clamped to it; boxes under ``least`` in either direction go."""
    p = pages.select(*[c for c in pages.columns if c != polygons], F.explode(F.from_json(F.col(polygons), POLYGONS)).alias("p"))
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    edge = {
        "x0": clamp(F.array_min(F.transform("p.points", lambda q: q["x"]))),
        "x1": clamp(F.array_max(F.transform("p.points", lambda q: q["x"]))),
        "y0": clamp(F.array_min(F.transform("p.points", lambda q: q["y"]))),
        "y1": clamp(F.array_max(F.transform("p.points", lambda q: q["y"]))),
    }
    p = p.withColumns(edge)
    r = lambda c: F.floor(c * 10000 + 0.5) / F.lit(10000.0)
    out = p.select(*[c for c in pages.columns if c != polygons], F.col("p.page").alias("page"), F.col("p.id").alias("offer_id"), r(F.col("x0")).alias("x"), r(F.col("y0")).alias("y"), r(F.col("x1") - F.col("x0")).alias("w"), r(F.col("y1") - F.col("y0")).alias("h"))
    return out.where((F.col("w") >= least) & (F.col("h") >= least))


def linked_spots(spots: DataFrame, offers: DataFrame) -> DataFrame:
    """Spots and how many of them are offers held, by flyer."""
    held = offers.select("flyer_ref", "offer_id").distinct().withColumn("held", F.lit(1))
    return spots.join(held, ["flyer_ref", "offer_id"], "left").groupBy("flyer_ref").agg(F.count("*").alias("spots"), F.sum(F.coalesce("held", F.lit(0))).alias("linked"))


@dataclass
class Keys:
    """Failover over model keys: a key that is refused is dropped, one that is throttled rests; without keys work stops."""

    keys: list[str]
    rest: int = 60
    until: dict[str, float] = field(default_factory=dict)
    dead: set[str] = field(default_factory=set)

    def pick(self, now: float) -> str | None:
        return next((k for k in self.keys if k not in self.dead and self.until.get(k, 0) <= now), None)

    def report(self, key: str, outcome: str, now: float) -> None:
        if outcome == "auth":
            self.dead.add(key)
        elif outcome == "rate":
            self.until[key] = now + self.rest


class Refused(Exception):
    """A model call that failed for its key: ``auth`` (the key is dead), ``rate`` (it rests) or ``transient``."""


def enriched(rows: DataFrame, model: Callable, keys: list[str]) -> DataFrame:
    """(id, outcome, name) of rows (id, content) read by ``model`` (key, id, content).

    A reading is stored, a declined one (None) too; an error of the row skips that row; a refused key hands the row on to
    the next key, and without keys, or where the model is down, the rest of a task's rows are left for the next run.
    """

    def run(batches):
        import time

        import pyarrow as pa

        pool, stopped = Keys(list(keys)), False
        for b in batches:
            out = []
            for item, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                outcome, name = "left", None
                while not stopped:
                    key = pool.pick(time.time())
                    if key is None:
                        stopped = True
                        break
                    try:
                        name = model(key, item, content or "")
                        outcome = "declined" if name is None else "read"
                    except Refused as error:
                        if str(error) in ("auth", "rate"):
                            pool.report(key, str(error), time.time())
                            continue
                        stopped = True
                    except Exception:  # the row's own failure: it is skipped, the others go on
                        outcome = "skipped"
                    break
                out.append((item, outcome, name))
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=["id", "outcome", "name"])

    return rows.select("id", "content").mapInArrow(run, "id bigint, outcome string, name string")


def settled(jobs: dict[str, Callable[[], object]]) -> dict[str, tuple[bool, object]]:
    """Every job's result or error; one failure never blocks the others."""
    out: dict[str, tuple[bool, object]] = {}
    for name, job in jobs.items():
        try:
            out[name] = (True, job())
        except Exception as error:  # settled, not raised: the caller reports it
            out[name] = (False, str(error))
    return out
