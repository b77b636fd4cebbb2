"""Connectors over small fetched texts, names from flyer text, model replies."""

import json

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import names
from shelfwise.sources import connectors as C


def pages(spark, *bodies, name="body"):
    return spark.createDataFrame([(b,) for b in bodies], f"{name} string")


def test_strategies_best_first():
    def broken(q):
        raise OSError("down")

    p = C.Provider("s", "S", (("api", broken), ("page", lambda q: []), ("cache", lambda q: [q])))
    rows, used, failures = C.run_provider(p, "milk")
    assert rows == ["milk"] and used == "cache" and failures == ["api: down", "page: empty"]
    with pytest.raises(C.AllFailed, match="api: down"):
        C.run_provider(C.Provider("s", "S", (("api", broken),)), "milk")


def test_live_search_source(spark):
    rows = {"milk": [("1", "Milk", None, 5.0, None, "SAR", None, "1 L", None, None)], "tea": []}
    p = C.Provider("demo", "Demo", (("static", lambda q: rows[q]),))
    got = C.live_search(spark, p, ["milk", "tea"]).collect()
    assert [(r.id, r.name, r.price) for r in got] == [("1", "Milk", 5.0)]


def test_product_list(spark):
    body = json.dumps({"products": [{"id": "p", "name": "Fresh Milk 2L", "brand": "A", "varieties": [{"id": "v", "price": 9.5, "was": 11, "size": "2 L"}]}, {"id": "q", "name": " "}, {"id": "r", "name": "Tea", "varieties": [{"price": 5, "was": 4}]}]})
    got = {r.id: r for r in C.product_list(pages(spark, body, "broken", None)).collect()}
    assert set(got) == {"v", "r"} and got["v"].old_price == 11 and got["v"].link == "/product/fresh-milk-2l" and got["r"].old_price is None


def test_layouts_and_cents(spark):
    body = json.dumps({"layouts": [{"items": []}, {"items": [{"id": "1", "name": "A", "mrp": 10, "discount": 0.5}, {"id": "2", "name": "B", "mrp": 3}]}, {"items": [{"id": "9"}]}]})
    assert [tuple(r) for r in C.layout_items(pages(spark, body)).collect()] == [("1", "A", 9.5, 10.0), ("2", "B", 3.0, None)]
    body = json.dumps({"items": [{"id": "1", "name": "A", "price": 250, "was": 300, "available": True}, {"id": "2", "available": False}]})
    assert [tuple(r) for r in C.cents_items(pages(spark, body)).collect()] == [("1", "A", 2.5, 3.0)]
    assert C.longest_token("زيت زيتون بكر") == "زيتون" and C.longest_token("") == ""


def test_search_page(spark):
    card = '<div data-asin="{0}" class="s-search-result"><h2>{1}</h2><span class="a-offscreen">SAR 12.50</span><span data-a-strike="true" x><span class="a-offscreen">SAR 15</span>'
    html = "<html>" + card.format("B01", "Milk &amp; honey") + card.format("B02", "Brand</h2><h2>Title") + '<div data-asin="B03" class="ad">' + "x" * 300
    got = [tuple(r) for r in C.search_cards(pages(spark, html, name="html")).select("id", "name", "brand", "price", "old_price").collect()]
    assert got == [("B01", "Milk & honey", None, 12.5, 15.0), ("B02", "Title", "Brand", 12.5, 15.0)]
    kinds = spark.createDataFrame([(503, "x" * 3000), (200, "CAPTCHA" + "x" * 3000), (200, ""), (200, "x" * 3000)], "s int, h string")
    assert [r[0] for r in kinds.select(C.block_kind(F.col("s"), F.col("h"))).collect()] == ["throttled", "captcha", "empty", None]


def test_flight_text(spark):
    body = '{"a":[{"sku":"S1","title":"T {x}","image":"i","brand":"b","price":4.5,"n":{"k":1}},{"sku":"S1","title":"again","image":"i","brand":"b"},{"sku":"S2","title":"","image":"i","brand":"b"}]}'
    half = len(body) // 2
    html = "".join(f"<script>self.__next_f.push([1,{json.dumps(p)}])</script>" for p in (body[:half], body[half:]))
    assert [tuple(r) for r in C.flight_products(pages(spark, html, None, "", name="html")).collect()] == [("S1", "T {x}", "b", "i", 4.5)]
    assert C.balanced('{"a":"}{","b":{"c":1}}', 15) == '{"c":1}' and C.balanced("{", 0) is None


def test_flyers(spark):
    card = '<article data-offer="{0}"><h3 class="t">{1}</h3><time datetime="{2}"></time><img data-index="1"><img data-index="1"><img data-index="2"></article>'
    html = card.format(5, "A &amp; B", "2026-07-10") + card.format(7, "C", "2026-06-01") + card.format(9, "D", "")
    got = [tuple(r) for r in C.flyer_cards(pages(spark, html, name="html"), F.lit("2026-07-01").cast("date")).collect()]
    assert [(r[0], r[1], r[3]) for r in got] == [(9, "D", 2), (5, "A & B", 2)]


def test_hotspots(spark):
    spots = json.dumps([{"page": 0, "id": "1", "points": [{"x": -0.1, "y": 0.2}, {"x": 0.5, "y": 0.4}]}, {"page": 0, "id": "2", "points": [{"x": 0.5, "y": 0.5}, {"x": 0.504, "y": 0.9}]}])
    df = spark.createDataFrame([(7, spots)], "flyer_ref long, polygons string")
    got = C.hotspots(df)
    assert [tuple(r) for r in got.collect()] == [(7, 0, "1", 0.0, 0.2, 0.5, 0.2)]
    held = spark.createDataFrame([(7, "1"), (7, "1"), (8, "2")], "flyer_ref long, offer_id string")
    assert tuple(C.linked_spots(got, held).first()) == (7, 1, 1)


def test_keys_and_settled_jobs():
    k = C.Keys(["a", "b"])
    k.report("a", "rate", 100)
    assert k.pick(120) == "b" and k.pick(161) == "a"
    k.report("a", "auth", 161)
    k.report("b", "auth", 161)
    assert k.pick(1000) is None
    assert C.settled({"x": lambda: 1, "y": lambda: 1 / 0}) == {"x": (True, 1), "y": (False, "division by zero")}


def test_derive_names(spark):
    rows = [
        ("activia kefir 850ml\n15.00\nSPECIAL OFFER", ("activia kefir 850ml", None)),
        ("حليب المراعي\nAlmarai Milk 2L\nwwwww", ("almarai milk 2l", "حليب المراعي")),
        ("tea", (None, None)),
        ("15.00\n12", (None, None)),
        ("日本語 text", (None, None)),
        ("Lulu Hypermarket rice", ("rice", None)),
        (None, (None, None)),
    ]
    df = spark.createDataFrame([(t,) for t, _ in rows], "t string").withColumn("w", F.array(F.lit("LuLu")))
    got = [tuple(r[0]) for r in df.select(names.derive_names(F.col("t"), F.col("w"))).collect()]
    want = [w for _, w in rows]
    want[5] = (None, None)  # a single word of under five letters
    assert got == want


def test_replies(spark):
    rows = ['Sure: {"name":"Milk","brand":" ","confidence":7}', "none", None, '{"name":null}']
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "t string").select(names.parse_reply(F.col("t"))).collect()]
    assert got[0].name == "Milk" and got[0].brand is None and got[0].confidence == 1.0 and got[1:] == [None, None, None]
    df = spark.createDataFrame([("fresh milk or apple juice", None, "12 SAR milk"), ("black or white", "شاي اخضر او قهوه عربيه", "milk"), ("orange", None, None)], "n string, a string, p string")
    assert [r[0] for r in df.select(names.is_or_deal(F.col("n"), F.col("a"))).collect()] == [True, True, False]
    assert [r[0] for r in df.select(names.strip_prices(F.col("p"))).collect()] == ["milk", "milk", ""]
    assert [r[0] for r in df.select(names.is_assortment(F.lit("Assorted"), F.col("a"))).collect()] == [True] * 3
