"""Every query against its DuckDB oracle on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from shelfwise import catalog, registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
registry._load()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_oracle(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    want = duck.sql(catalog.ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    at = [want.columns.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_queries_list_without_a_session():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark)
    assert rows.columns == ["rail", "id", "store", "name", "price_cents", "old_cents"] and rows.count() > 0


def test_scan_is_pruned(spark, sf_dir):
    import re

    plan = catalog.QUERIES["AGG-05_store_counts"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    read = " ".join(re.findall(r"ReadSchema: (\S+)", plan))
    assert "l_suppkey" in read and not re.search("l_quantity|l_extendedprice|p_name|s_acctbal", read)


def test_flyer_budget_is_each_stores_own(spark, sf_dir):
    from shelfwise.operators import sinks
    from shelfwise.sources.tables import TODAY, Tables

    groups, want = {}, []
    for r in Tables(spark, sf_dir).brochures.where(f"valid_to >= date '{TODAY}' and pages > 0").collect():
        one = groups.setdefault(r.store, {}).setdefault((r.title.lower(), r.valid_from, r.valid_to), r)
        if (r.pages, r.id) > (one.pages, one.id):
            groups[r.store][r.title.lower(), r.valid_from, r.valid_to] = r
    for own in groups.values():
        ranked = sorted(own.values(), key=lambda r: (r.valid_from.isoformat() <= TODAY, r.pages, r.valid_to, r.id), reverse=True)
        want += sinks.greedy_budget([(r.id, r.pages) for r in ranked], 36)
    got = [tuple(r) for r in catalog.QUERIES["SRC-12_flyer_budget"](spark, sf_dir).collect()]
    assert sorted(got) == sorted(want) and len(want) > 200
