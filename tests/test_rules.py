"""Rules of identity, search, watches and operations on small tables with known answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import families as Fm
from shelfwise.functions import identity as I
from shelfwise.functions import text as T
from shelfwise.operators import registry as R
from shelfwise.operators import search as Se
from shelfwise.operators import sinks as S
from shelfwise.operators import watches as Wt
from shelfwise.sources import connectors as C

READ = "read_id long, words array<string>, tokens array<string>, size long, brand string, family string, category string, kind string, corroboration double"
PRODUCT = "id string, words array<string>, tokens array<string>, size long, brand string, family string, category string, kind string, status string, merged_into string, stores array<string>, sightings long, first_seen string"


def read(i, name, size=None, brand=None, family=None, category=None, kind="product", corroboration=1.0):
    return (i, name.split(), name.split(), size, brand, family, category, kind, corroboration)


def product(i, name, size=None, brand=None, family=None, category=None, kind="product", status="active", into=None, stores=("s",), sightings=1, first="2026-01-01"):
    return (i, name.split(), name.split(), size, brand, family, category, kind, status, into, list(stores), sightings, first)


def scores(spark, reads, products, incumbents=()):
    r, p = spark.createDataFrame(reads, READ), spark.createDataFrame(products, PRODUCT)
    met = spark.createDataFrame(list(incumbents), "read_id long, product_id string")
    return r, p, met


def test_vetoes_in_their_order(spark):
    pairs = [
        ("chicken nuggets", "chicken breast", "form-conflict"),
        ("chicken breast meat", "chicken fillet meat", None),
        ("chicken nuggets", "chicken", "form-specificity"),
        ("crispy nuggets", "crispy", None),
        ("beef steak", "lamb steak", "species-conflict"),
        ("green tea", "green oil", "family-conflict"),
        ("white cheese", "white cream", None),
        ("blue pen", "red cup", "no-product-core"),
    ]
    families = lambda n: {"tea": "tea", "oil": "oil", "cheese": "cheese", "cream": "cream"}.get(n.split()[-1])
    reads = [read(i, a, family=families(a)) for i, (a, _, _) in enumerate(pairs)]
    products = [product(str(i), b, family=families(b)) for i, (_, b, _) in enumerate(pairs)]
    r, p, _ = scores(spark, reads, products)
    asked = r.select("read_id", F.col("read_id").cast("string").alias("product_id"), F.lit(False).alias("incumbent"))
    got = {x.read_id: x.veto for x in R.pair_scores(asked, r, p, {}).collect()}
    assert got == {i: v for i, (_, _, v) in enumerate(pairs)}


def test_category_conflict_and_semantic_evidence(spark):
    reads = [read(0, "jasmine grain", family="rice", category="rice"), read(1, "jasmine grain", family="rice", category="rice")]
    products = [product("0", "basmati long", family="rice", category="rice"), product("1", "jasmine", family="rice", category="fish")]
    r, p, _ = scores(spark, reads, products)
    asked = r.select("read_id", F.col("read_id").cast("string").alias("product_id"), F.lit(False).alias("incumbent"))
    got = {x.read_id: x for x in R.pair_scores(asked, r, p, {"rice": "rice", "fish": "seafood"}).collect()}
    # the same family and aisle admit a pair without a shared word, and such a pair is never sure
    assert got[0].veto is None and got[0].semantic and got[1].veto == "category-conflict"
    assert R.decide(R.pair_scores(asked, r, p, {"rice": "rice", "fish": "seafood"}), r).where("read_id = 0").first().band in ("review", "created")


def test_resolution_with_incumbent_tombstone_and_one_sided_size(spark):
    reads = [read(0, "almarai laban drink", 500), read(1, "almarai laban drink"), read(2, "nadec juice"), read(3, "unknown thing"), read(4, "rare soap bar", corroboration=0.2)]
    products = [product("a", "almarai laban drink", 500), product("b", "nadec juice", status="merged", into="c"), product("c", "nadec juice mix"), product("d", "rare soap bar")]
    r, p, met = scores(spark, reads, products, [(2, "b")])
    got = {x.read_id: (x.product_id, x.band) for x in R.resolve(r, p, met, {}).collect()}
    assert got == {0: ("a", "auto"), 1: ("a", "review"), 2: ("c", "auto"), 3: (None, "created"), 4: (None, "created")}


def test_merges_once_a_run(spark):
    products = [product("a", "x1 x2 word", 10, sightings=5), product("b", "x1 x2 word", 10, sightings=9), product("c", "x1 x2 word", 10, stores=("t",), sightings=1), product("d", "x1 x2 word", 99), product("e", "x1 x2 word", None, stores=("u",)), product("f", "x1 x2 word", 10, "other", sightings=1), product("g", "x1 x2 word", 10, "brand", sightings=1)]
    p = spark.createDataFrame(products, PRODUCT)
    index = R.token_index(p)
    pairs = R.shared_pairs(index, R.distinctive(index, 7))
    decided = {(x.survivor, x.loser) for x in R.decide_merges(pairs, p, {}).collect()}
    assert ("b", "a") in decided and ("g", "f") not in decided and ("f", "g") not in decided
    # other sizes, and neither a common store nor two sizes, are no twins
    assert not any("d" in x or "e" in x for x in decided)
    taken = R.consolidated(pairs, p, {}).collect()
    ids = [i for x in taken for i in (x.survivor, x.loser)]
    assert len(ids) == len(set(ids)) and taken
    merged = R.merged_fields(R.consolidated(pairs, p, {}), p).where("survivor = 'b'").first()
    assert merged.sightings == 9 + {x[0]: x[11] for x in products}[merged.loser]


def test_all_pairs_of_a_run_are_merged(spark):
    """However many there are: 250 pairs of twins, and each pair's products come once."""
    products = [product(f"{i:03}{k}", f"x{i} y{i} word", 10, sightings=n) for i in range(250) for k, n in (("a", 5), ("b", 9), ("c", 7))]
    p = spark.createDataFrame(products, PRODUCT)
    pairs = spark.createDataFrame([(f"{i:03}{x}", f"{i:03}{y}", n) for i in range(250) for x, y, n in (("a", "b", 2), ("a", "c", 2), ("b", "c", 3))], "a string, b string, shared bigint")
    got = sorted((x.survivor, x.loser, x.shared) for x in R.consolidated(pairs, p, {}).collect())
    assert got == [(f"{i:03}b", f"{i:03}c", 3) for i in range(250)]


def test_learning_adopts_fills_and_flags(spark):
    day = lambda n: dt.date(2026, 1, 5) + dt.timedelta(weeks=n)
    products = [("p", "dormant", "Old", 0.9, day(0), None, None, None), ("q", "active", None, None, None, 10, "b", None), ("r", "dormant", None, None, None, None, None, "kept")]
    p = spark.createDataFrame(products, "id string, status string, display string, display_corroboration double, display_week date, size long, brand string, review_flag string")
    told = [("p", "o1", day(1), "s1", "Weak", 0.4, 5, None), ("p", "o2", day(8), "s2", "Late", 0.3, 6, "x"), ("p", "o3", day(9), "s1", "Later", 0.2, None, "y"), ("q", "o4", day(1), "s", "First", 0.5, 10, "c"), ("q", "o5", day(1), "s", "Same", 0.5, 30, "b")]
    s = spark.createDataFrame(told, "product_id string, offer_id string, week date, store string, name string, corroboration double, size long, brand string")
    got = {x.id: x for x in R.learn(p, s).collect()}
    # "Weak" is no better than "Old"; "Late" comes over six weeks later; "Later" is weaker and soon after
    assert (got["p"].display, got["p"].status, got["p"].size, got["p"].brand, got["p"].review_flag) == ("Late", "active", 5, "x", "size-conflict")
    assert (got["q"].display, got["q"].review_flag, got["q"].sightings) == ("Same", "brand-conflict", 2)
    assert (got["r"].status, got["r"].review_flag, got["r"].sightings) == ("dormant", "kept", 0)


def test_profile_is_capped_by_count_week_token(spark):
    rows = [("p", f"t{i:02d}", 1, f"w{i % 3}") for i in range(30)]
    profile = spark.createDataFrame(rows, "product_id string, token string, count long, week string")
    told = spark.createDataFrame([("p", "t00", "w9")], "product_id string, token string, week string")
    got = {x.token: (x["count"], x.week) for x in R.learned_profile(profile, told).collect()}
    assert len(got) == 24 and got["t00"] == (2, "w9")
    want = sorted(((1, w, t) for _, t, _, w in rows if t != "t00"), reverse=True)[:23]
    assert {t for t in got if t != "t00"} == {t for _, _, t in want}


def test_drain_stops_at_the_fifth_error(spark):
    feed = spark.createDataFrame([(i, i % 3 == 0) for i in range(40)], "id int, bad boolean")
    got = sorted(x.id for x in R.drained(feed, ["id"], F.col("bad")).collect())
    assert got == list(range(13))


def test_families_by_tier(spark):
    names = {"milk chocolate": "chocolate", "حليب فراولة": "milk", "معجون طماطم": "sauce", "fresh tomatoes": "tomato", "strawberry flavoured": None, "بنكهة الفراولة": None, "eggs": "eggs", "thing": None}
    df = T.with_words(spark.createDataFrame([(n,) for n in names], "n string"), "n", "x")
    assert {r.n: r.f for r in df.select("n", Fm.family(F.col("x_words")).alias("f")).collect()} == names


def test_fresh_produce_in_search_and_ladder(spark):
    q = T.Query.of("strawberry")
    assert I.fresh_intent(q) == "strawberry" and I.fresh_intent(T.Query.of("frozen strawberry")) is None and I.fresh_intent(T.Query.of("strawberry jam")) is None
    names = ["strawberries fresh", "frozen strawberries", "strawberry roll", "strawberry milk", "candy بالفراولة", "strawberry"]
    df = T.with_words(spark.createDataFrame(list(enumerate(names)), "id int, n string"), "n", "x")
    ws = F.col("x_words")
    got = {r.id: (r.rank, r.fresh) for r in df.select("id", Se.family_rank(ws, Fm.family(ws), q).alias("rank"), I.fresh(ws, Fm.product_type(ws), "strawberry").alias("fresh")).collect()}
    assert got == {0: (2, True), 1: (1, False), 2: (0, False), 3: (0, True), 4: (0, False), 5: (2, True)}
    pool = spark.createDataFrame([(1, i, 5, None, None, f) for i, f in enumerate([True, False, True])], "q int, id int, stage int, family string, type string, ok boolean")
    for policy, gone in (("summary", [1]), ("alert", [1])):
        out = Se.ladder(pool, ["q"], Se.POLICIES[policy], F.lit(False), F.lit(None).cast("string"), F.lit(None).cast("string"), None, F.lit("strawberry"), F.col("ok"))
        assert [r.id for r in out.where("excluded = 'fresh'").collect()] == gone
    none = pool.withColumn("ok", F.lit(False))
    left = {p: Se.ladder(none, ["q"], Se.POLICIES[p], F.lit(False), F.lit(None).cast("string"), F.lit(None).cast("string"), None, F.lit("strawberry"), F.col("ok")).where("excluded is null").count() for p in ("summary", "alert")}
    assert left == {"summary": 3, "alert": 0}


def test_grocery_watch_means_the_named_product(spark):
    market = [("1", "lulu", "almarai fresh milk", 2000, 800), ("2", "lulu", "almarai fresh milk", 200, 100), ("3", "web", "fresh milk", 2000, 1200), ("4", "lulu", "milk chocolate biscuit", 2000, 300), ("5", "lulu", "fresh laban", 2000, 200)]
    m = spark.createDataFrame(market, "id string, store string, name string, size int, price_cents long")
    w = spark.createDataFrame([(1, "fresh milk", 2000), (2, "nothing here", 2000)], "watch int, asked string, wanted int")
    got = [tuple(r) for r in Wt.grocery(w, m, ("fresh milk", "nothing here")).collect()]
    assert got == [(1, 800, "1", "lulu", 2)]


def test_identity_hash_vectors(spark):
    # published vectors of the 64-bit FNV-1a hash
    want = {"": "cbf29ce484222325", "a": "af63dc4c8601ec8c", "foobar": "85944171f73967e8"}
    df = spark.createDataFrame([(k,) for k in want], "s string")
    assert {r.s: r.h for r in df.select("s", I.fnv64(F.col("s")).alias("h")).collect()} == want


def test_signed_request_vector():
    # the published example of the signing scheme: GET / without headers and body
    out = C.signed("GET", "example.amazonaws.com", "/", {}, "", "AKIDEXAMPLE", "wJalrXUtnFEMI/K7MDENG+bPxRfiCYEXAMPLEKEY", "us-east-1", "service", "20150830T123600Z")
    assert out["authorization"].endswith("Signature=5fa00fa31553b73ebf1942676e86291e8372ff2a2260956d9b8aae1d763fbf31")


def test_model_keys_fail_over(spark):
    def model(key, item, content):
        if key == "dead":
            raise C.Refused("auth")
        if item == 3:
            raise C.Refused("transient")
        return content

    rows = spark.createDataFrame([(i, f"n{i}") for i in range(5)], "id long, content string").coalesce(1)
    got = {r.id: (r.outcome, r.name) for r in C.enriched(rows, model, ["dead", "live"]).collect()}
    # the model goes down at row 3: it and the rows after it are left
    assert got == {0: ("read", "n0"), 1: ("read", "n1"), 2: ("read", "n2"), 3: ("left", None), 4: ("left", None)}
    assert all(r.outcome == "left" for r in C.enriched(rows, model, ["dead"]).collect())


def test_patch_refuses_other_columns(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, v string, w string")
    new = spark.createDataFrame([(2, None), (9, "z")], "id int, v string")
    assert sorted(map(tuple, S.patch(df, new, "id", ("v",)).collect())) == [(1, "a", "x"), (2, None, "y")]
    with pytest.raises(ValueError):
        S.patch(df, new, "id", ("w",))


def test_a_lease_is_taken_once(spark):
    at = dt.datetime(2026, 1, 1, 12)
    jobs = spark.createDataFrame([(1, "running", "old", at - dt.timedelta(hours=1)), (2, "running", "old", at + dt.timedelta(hours=1)), (3, "done", None, None), (4, "running", None, None)], "id long, state string, owner string, lease_until timestamp")
    claims = spark.createDataFrame([(j, w, at) for j in (1, 2, 3, 4) for w in ("w2", "w1")], "job long, worker string, at timestamp")
    got = {r.id: r.owner for r in S.claim(jobs, claims, F.lit(at), "10 minutes").collect()}
    assert got == {1: "w1", 2: "old", 3: None, 4: "w1"}
