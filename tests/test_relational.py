import datetime as dt

import pytest

from millrace.operators import relational as r

from .conftest import rows_of


def at(text):
    return dt.datetime.fromisoformat(text)


@pytest.fixture(scope="module")
def t(spark):
    make = spark.createDataFrame
    li = "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    rows = [(1, 1, 1, 1.0, 100.0, 0.1, 0.05, "A", "F", at("1996-01-01")), (1, 1, 1, 2.0, 10.0, 0.0, 0.0, "A", "F", at("1996-01-31 23:59:59")), (1, 9, 1, 3.0, 7.0, 0.0, 0.0, "N", "O", at("1996-02-01")), (2, 1, 1, 4.0, 5.0, 0.5, 0.1, "N", "O", at("1996-12-31")), (3, 1, 2, 5.0, 1.0, 0.0, 0.0, "R", "F", at("1997-01-01")), (8, 1, 1, 1.0, 1.0, 0.0, 0.0, "R", "F", at("1996-01-01"))]
    return {
        "lineitem": make(rows, li),
        "orders": make([(1, 1, at("1995-12-31"), "x"), (2, 7, at("1996-01-01"), "y"), (3, 2, at("1990-05-05"), "z")], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_clerk string"),
        "customer": make([(1, "c1", 3), (2, "c2", 5)], "c_custkey long, c_name string, c_nationkey int"),
        "part": make([(1, "p1")], "p_partkey long, p_name string"),
        "supplier": make([(1, "s1")], "s_suppkey long, s_name string"),
        "nation": make([(3, "n3"), (5, "n5")], "n_nationkey int, n_name string"),
    }


@pytest.mark.parametrize("pattern, n", [("1996", 5), ("1996-01", 3), ("1996-01-01", 2), ("01-01", 3), ("-12-", 1), ("96", 5), ("1996-13", 0), ("1996-02-30", 0), ("7-01", 1), ("", 6)])
def test_date_patterns(t, pattern, n):
    assert r.shipped_count(t["lineitem"], pattern).head()[0] == n


def test_one_row_an_order(t):
    assert rows_of(r.shipped_orders(t["lineitem"], t["orders"], "1996-01", "o_clerk")) == [("x", 1)]


def test_unknown_parts_and_suppliers_go(t):
    assert rows_of(r.shipped_parts(t["lineitem"], t["part"], t["supplier"], "199")) == [(1, "p1", "s1"), (1, "p1", "s1"), (2, "p1", "s1"), (8, "p1", "s1")]


def test_every_line_item_counts(t):
    assert rows_of(r.nation_counts(t["lineitem"], t["orders"], t["customer"], t["nation"], "1996")) == [(3, "n3", 3)]
    assert rows_of(r.monthly_counts(t["lineitem"], t["orders"], t["customer"], t["nation"])) == [("1996-01", "n3", 2), ("1996-02", "n3", 1)]


def test_pricing_summary(t):
    got = [x.asDict() for x in r.pricing_summary(t["lineitem"], "1996-01").collect() if x["l_returnflag"] == "A"]
    assert got == [{"l_returnflag": "A", "l_linestatus": "F", "sum_qty": 3.0, "sum_base_price": 110.0, "sum_disc_price": 100.0, "sum_charge": 104.5, "avg_qty": 1.5, "avg_price": 55.0, "avg_disc": 0.05, "count_order": 2.0}]


def test_strict_dates(t):
    got = rows_of(r.unshipped_revenue(t["lineitem"], t["orders"], t["customer"], "1996-01-01", "o_clerk"))
    assert got == [("c1", 1, 17.0, "1995-12-31", "x"), ("c2", 3, 1.0, "1990-05-05", "z")]
    assert rows_of(r.unshipped_revenue(t["lineitem"], t["orders"], t["customer"], "1995-12-31", "o_clerk")) == [("c2", 3, 1.0, "1990-05-05", "z")]
