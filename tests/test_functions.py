"""Golden cases of the text, size, family, schedule and write functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import families, sizes, text
from shelfwise.operators import browse, health, registry, search, sinks, watches


@pytest.mark.parametrize(
    "raw,normal,canonical",
    [("حليب المراعي الطازج", "حليب المراعي الطازج", "حليب مراعي طازج"), ("أكياس شاي  ١٠٠", "اكياس شاي 100", "اكياس شاي 100"), ("Fresh-Milk, 2L!", "fresh milk 2l", "fresh milk 2l"), (None, "", ""), ("مَدْرَسَة", "مدرسه", "مدرسه"), ("وال", "وال", "وال")],
)
def test_normal_forms(spark, raw, normal, canonical):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(text.normalize_text(F.col("t")), text.canonical_text(F.col("t"))).first()[:] == (normal, canonical)
    assert text.normalized(raw) == normal


SIZES = [
    ("Almarai Milk 2L", ("ml", 2000.0, 1, 2000.0, "measure")),
    ("6 x 200 ml", ("ml", 200.0, 6, 1200.0, "measure")),
    ("200 ml x 6", ("ml", 200.0, 6, 1200.0, "measure")),
    ("9+3 × 200 مل", ("ml", 200.0, 12, 2400.0, "measure")),
    ("24 قطعة × 125مل", ("ml", 125.0, 24, 3000.0, "measure")),
    ("2.85L", ("ml", 2850.0, 1, 2850.0, "measure")),
    ("12 rolls", ("pcs", 1.0, 12, 12.0, "count")),
    ("6's", ("pcs", 1.0, 6, 6.0, "count-weak")),
    ("Omega 3+6+9", (None, None, 1, None, None)),
    ("٥٠٠ مل", ("ml", 500.0, 1, 500.0, "measure")),
    ("8 رول +2 مجانا", ("pcs", 1.0, 10, 10.0, "count")),
    ("water 1 l 10+2", ("ml", 1000.0, 12, 12000.0, "measure")),
    ("501 pcs", (None, None, 1, None, None)),
    ("no size", (None, None, 1, None, None)),
    (None, (None, None, 1, None, None)),
]


def test_sizes(spark):
    df = sizes.with_size(spark.createDataFrame([(s,) for s, _ in SIZES], "t string"), "t")
    assert [(r.t, tuple(r.size_read)) for r in df.collect()] == SIZES
    labels = [r[0] for r in df.select(sizes.variant_label(F.col("size_read"))).collect()]
    assert labels[0] == "2 L" and labels[1] == "6 × 200 ml" and labels[6] == "12 pcs" and labels[-1] is None


STAGES = [
    ("ليمون أصفر", "ليمون", 5),
    ("Fresh Lemon 1kg", "lemon", 5),
    ("كلوروكس ليمون", "ليمون", 4),
    ("حليب بنكهة الليمون", "ليمون", 1),
    ("Milk Chocolate", "milk", 1),
    ("cornflakes box", "flakes", 2),
    ("بيضاء", "بيض", 0),
    ("Almarai fresh milk", "almarai fresh milk", 5),
    ("Almarai fresh milk", "milk almarai", 4),
    ("Almarai fresh milk", "almarai yoghurt", 1),
    ("bread", "almarai milk", 0),
    ("Arwa Water 1.5L", "arwa water 1.5L", 5),
]


@pytest.mark.parametrize("name,q,stage", STAGES)
def test_stages(spark, name, q, stage):
    df = spark.createDataFrame([(name, None)], "n string, b string")
    assert text.with_stage(df, text.Query.of(q), "n", "b").first().stage == stage


def test_query_tokens_drop_sizes():
    assert text.Query.of("Arwa Water 1.5L").tokens == ("arwa", "water") and text.Query.of("500 ml").tokens == ("500", "ml")
    assert "حليب" in text.Query.of("milk").variants[0] and text.Query.of("").tokens == ()


def test_relevance(spark):
    df = text.with_words(spark.createDataFrame([("Milk Chocolate",), ("Fresh milk",), ("Bread",), (None,)], "n string"), "n", "x")
    got = [r[0] for r in df.select(text.name_relevance(text.Query.of("حليب"), F.col("x_text"), F.col("x_words"))).collect()]
    assert got == [45.0, 100.0, 0.0, 0.0]


def test_families(spark):
    df = text.with_words(spark.createDataFrame([("حليب شوكولاته",), ("Chicken Nuggets",), ("table",)], "n string"), "n", "x")
    got = df.select(families.family(F.col("x_words"), derived={"chocolate": ["شوكولاته"]}), families.product_type(F.col("x_words"))).collect()
    assert [tuple(r) for r in got] == [("chocolate", None), ("chicken", "nuggets"), (None, None)]


def test_frozen_marks(spark):
    rows = [("Frozen peas",), ("chicken burger",), ("butcher burger",), ("frozen butcher burger",), (None,), ("دجاج مجمدة",)]
    got = [r[0] for r in spark.createDataFrame(rows, "n string").select(browse.is_frozen(F.col("n"))).collect()]
    assert got == [True, True, False, True, False, True]


def test_ladder_never_empties_unless_declared(spark):
    pool = spark.createDataFrame([(1, 5, "milk", None), (2, 5, "milk", "roll"), (3, 4, "milk", None), (4, 5, "juice", None), (5, 5, None, None)], "id int, stage int, family string, type string").withColumn("q", F.lit(1))
    none = F.lit(None).cast("string")

    def kept(policy, family, kind):
        out = search.ladder(pool, ["q"], search.POLICIES[policy], F.lit(False), family, kind)
        return {r.id: r.excluded for r in out.collect()}

    assert kept("summary", none, F.lit("nuggets")) == {1: None, 2: "type", 3: "stage", 4: "family", 5: None}
    assert kept("history", none, none) == {1: None, 2: None, 3: None, 4: None, 5: None}
    assert set(kept("alert", F.lit("fish"), none).values()) == {"family", "stage", None}
    only = search.ladder(pool.where("id = 2"), ["q"], search.POLICIES["summary"], F.lit(False), none, F.lit("nuggets")).first()
    assert only.excluded is None
    assert search.ladder(pool.where("id = 2"), ["q"], search.POLICIES["alert"], F.lit(False), none, F.lit("nuggets")).first().excluded == "type"


def test_crossings(spark):
    prices = [8, 7, None, 9, 12, None, 9, 11, 11, 5]
    df = spark.createDataFrame([(1, i, p) for i, p in enumerate(prices)], "watch int, at int, price int")
    got = [r["at"] for r in watches.crossings(df, "watch", ["at"], "price", F.lit(10)).orderBy("at").collect()]
    assert got == [0, 6, 9]


def test_cron():
    t = lambda *a: dt.datetime(*a)
    assert health.cron_next("*/20 * * * *", t(2026, 7, 1, 10, 5)) == t(2026, 7, 1, 10, 20)
    assert health.cron_next("0 6 * * 3", t(2026, 7, 1, 6, 0)) == t(2026, 7, 8, 6, 0)
    assert health.cron_next("30 4 15 * 1", t(2026, 7, 7, 0, 0)) == t(2026, 7, 13, 4, 30)
    assert health.cron_next("0 0 31 2 *", t(2026, 2, 1)) is None


def test_upsert_and_budget(spark):
    old = spark.createDataFrame([(1, "a", 1, "x"), (2, "b", 2, "y")], "id int, v string, first int, e string")
    new = spark.createDataFrame([(2, "c", 9, None), (3, "d", 9, "z")], "id int, v string, first int, e string")
    got = sorted(map(tuple, sinks.upsert(old, new, "id", keep=("first",), fill=("e",)).collect()))
    assert got == [(1, "a", 1, "x"), (2, "c", 2, "y"), (3, "d", 9, "z")]
    assert sinks.greedy_budget([("a", 5), ("b", 9), ("c", 4)], 10) == [("a", 5), ("c", 4)]


def test_written_versions(spark, tmp_path):
    path = sinks.overwrite(spark.range(3), str(tmp_path))
    assert spark.read.parquet(path).count() == 3 and path != sinks.overwrite(spark.range(1), str(tmp_path))


def test_scores(spark):
    one = spark.range(1)
    s = registry.score(F.lit(1.0), F.lit(True), F.lit(1.0), F.lit(0.3), incumbent=F.lit(True))
    assert abs(one.select(s).first()[0] - 0.5) < 1e-9
    assert one.select(registry.size_conflict(F.lit(100), F.lit(98))).first()[0] is False
