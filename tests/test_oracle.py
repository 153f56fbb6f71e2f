"""Every registered query against its DuckDB restatement on the small tables."""

import hashlib
import math

import duckdb
import pytest

import __spark_entry__ as E
from kipmart import oracle, registry
from kipmart.sources.adapter import RAW_TABLES

from conftest import SF_SMALL

QUERIES = registry.queries()
ORACLE = oracle.oracle_sql()


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha1("\n".join(lines).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in RAW_TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


def test_entry_has_every_shop_query():
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["month", "revenue", "cost", "profit"]
    assert df.count() > 0


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_matches_oracle(spark, con, key):
    sdf = QUERIES[key](spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    res = con.execute(ORACLE[key])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(sdf.columns) == sorted(ocols)
    assert len(srows) == len(orows)
    assert _digest(sdf.columns, srows) == _digest(ocols, orows)


# keys whose output order is part of the answer and total (ties broken by id)
ORDERED = ["sales_monthly", "top_products", "profit_by_product", "profit_by_month", "sales_daily",
           "day_orders", "preorder_by_day", "preorder_by_week", "preorder_by_year",
           "preorder_by_month", "preorder_years", "preorder_lines", "category_product_counts",
           "product_listing", "product_search", "orders_by_status", "orders_with_preorder_count"]


@pytest.mark.parametrize("key", ORDERED)
def test_order_matches_oracle(spark, con, key):
    sdf = QUERIES[key](spark, SF_SMALL)
    cols = sdf.columns
    srows = ["|".join(_norm(v) for v in r) for r in sdf.collect()]
    res = con.execute(ORACLE[key])
    ocols = [d[0] for d in res.description]
    idx = [ocols.index(c) for c in cols]
    orows = ["|".join(_norm(r[i]) for i in idx) for r in res.fetchall()]
    assert srows == orows
