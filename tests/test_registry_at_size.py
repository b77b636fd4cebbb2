"""Queries of the registry on parts with long numbers, and on more parts of a line than the small tables have, against their statements."""

import duckdb
import pytest

from shelfwise import catalog, registry

from .test_engine import plain

registry._load()


def part_table(folder, keys):
    """Parts of the smallest table, in turn, under other numbers."""
    con = duckdb.connect()
    con.sql(f"""copy (select k as p_partkey, p.* exclude (p_partkey) from (select k, row_number() over (order by k) - 1 as n from ({keys})) join
        (select *, row_number() over (order by p_partkey) - 1 as place, count(*) over () as parts from '/root/testdata/sf0.001/part.parquet') p on n % parts = place) to '{folder}/part.parquet'""")
    return str(folder)


@pytest.fixture(scope="module")
def long_numbers(tmp_path_factory):
    """Numbers of six and seven digits, of which some have the same first six."""
    return part_table(tmp_path_factory.mktemp("long"), "select range as k from range(100000, 100040) union all select range from range(1000000, 1000400)")


@pytest.fixture(scope="module")
def full_lines(tmp_path_factory):
    """Products of lines whose products have one word each, few enough in a line that its word is rare."""
    return part_table(tmp_path_factory.mktemp("lines"), "select range as k from range(0, 17000) where range % 10 = 2 and range % 127 % 10 = 9")


def same(spark, folder, name):
    con = duckdb.connect()
    con.sql(f"create view part as select * from '{folder}/part.parquet'")
    for t in "region nation customer supplier orders lineitem events".split():
        con.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    df = catalog.QUERIES[name](spark, folder)
    want = con.sql(catalog.ORACLES[name])
    at = [want.columns.index(c) for c in df.columns]
    got = sorted((tuple(map(plain, r)) for r in df.collect()), key=repr)
    expected = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert got == expected and got


def test_merges_of_products_of_one_word(spark, full_lines):
    same(spark, full_lines, "REG-07_merge_decisions")


def test_merges_of_products_that_share_an_id(spark, long_numbers):
    same(spark, long_numbers, "REG-07_merge_decisions")


def test_token_frequency_of_long_numbers(spark, long_numbers):
    same(spark, long_numbers, "AGG-10_token_frequency")


def test_shared_tokens_of_long_numbers(spark, long_numbers):
    same(spark, long_numbers, "JON-09_token_self_join")


def test_equal_sets_of_tokens_meet_once(spark):
    from shelfwise.operators import registry as R

    rare = spark.createDataFrame([("m1",), ("v1",)], "token string")
    reads = spark.createDataFrame([(i, t) for i in range(50) for t in ("m1", "v1", "red")], "read_id bigint, token string")
    index = spark.createDataFrame([(f"p{i}", t) for i in range(40) for t in ("m1", "v1")], "product_id string, token string")
    r, p = R.token_sets(reads, rare, "read_id"), R.token_sets(index, rare, "product_id")
    assert [tuple(x) for x in R.sets_meeting(r, p).collect()] == [('["m1","v1"]', '["m1","v1"]', 2)]
    assert R.shared_pairs(index, rare).count() == 40 * 39 // 2


def test_brands_found_are_not_sent_by_the_driver(spark):
    """As many as rows, they would not fit there."""
    df = catalog.QUERIES["CLS-05_detect_brand"](spark, "/root/testdata/sf0.001")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftOuter, BuildRight" not in plan and "Inner, BuildLeft" not in plan


@pytest.mark.parametrize("name", ["REG-04_resolve", "RANK-12_stratified_sample", "REG-10_grid_sweep", "AGG-20_confusion"])
def test_scores_of_long_numbers(spark, long_numbers, name):
    same(spark, long_numbers, name)


def test_scored_pairs_are_not_rows(spark, long_numbers):
    """On 1,200,000 parts they would be billions."""
    plan = catalog.QUERIES["REG-10_grid_sweep"](spark, long_numbers)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan


def test_all_scores_of_long_numbers(spark, long_numbers):
    same(spark, long_numbers, "REG-03_pair_scores")


def test_pairs_of_all_scores_compare_no_texts(spark, long_numbers):
    """On 1,200,000 parts they are 3 billion rows; words, brands and sizes are compared value by value before, and found by number."""
    plan = catalog.QUERIES["REG-03_pair_scores"](spark, long_numbers)._jdf.queryExecution().optimizedPlan().toString()
    # the pairs of incumbents that share no token are few, and are compared as rows: they come last
    pairs = [x for x in plan.split("\n+- ")[0].splitlines() if "read_id#" in x and "product_id#" in x]
    assert pairs and not [x for x in pairs if "Contains(" in x or " r#" in x or "[r#" in x]
