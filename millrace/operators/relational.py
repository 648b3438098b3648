"""Seven reporting queries over the star schema.

A date pattern is a part of a date's text: `1996`, `1996-01` and `1996-01-01` become ranges that the scan can prune by; any
other, such as `01-01`, is looked for in the text. Prices are summed as decimals, so sums don't depend on their order.
Small dimensions are broadcast by their size (spark.sql.autoBroadcastJoinThreshold, and AQE), never by a hint.
"""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def date_matches(column: str, pattern: str) -> Column:
    """Whether the date's text, yyyy-MM-dd, contains the pattern."""
    if m := re.fullmatch(r"(\d{4})(?:-(\d{2}))?(?:-(\d{2}))?", pattern):
        year, month, day = int(m[1]), int(m[2] or 1), int(m[3] or 1)
        try:
            low = date(year, month, day)
        except ValueError:
            return F.lit(False)
        high = low + timedelta(1) if m[3] else date(year + month // 12, month % 12 + 1, 1) if m[2] else date(year + 1, 1, 1)
        return (F.col(column) >= _midnight(low)) & (F.col(column) < _midnight(high))
    return F.date_format(column, "yyyy-MM-dd").contains(pattern)


def _midnight(d: date) -> Column:
    return F.lit(datetime(d.year, d.month, d.day).isoformat(" ")).cast("timestamp_ntz")


def money(column: str, scale: str = "decimal(12,2)") -> Column:
    return F.col(column).cast(scale)


def _rate(column: str) -> Column:
    return money(column, "decimal(4,2)")


def shipped_count(lineitem: DataFrame, pattern: str) -> DataFrame:
    """q1 (cnt): line items shipped on dates that match."""
    return lineitem.where(date_matches("l_shipdate", pattern)).agg(F.count("*").alias("cnt"))


def shipped_orders(lineitem: DataFrame, orders: DataFrame, pattern: str, attribute: str, n: int = 20) -> DataFrame:
    """q2 (attribute, o_orderkey): the first n orders by key with a matching line item, one row an order."""
    li = lineitem.where(date_matches("l_shipdate", pattern)).select("l_orderkey")
    return orders.select("o_orderkey", attribute).join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select(attribute, "o_orderkey").orderBy("o_orderkey", attribute).limit(n)


def shipped_parts(lineitem: DataFrame, part: DataFrame, supplier: DataFrame, pattern: str, n: int = 20) -> DataFrame:
    """q3 (l_orderkey, p_name, s_name): the first n matching line items by order key, then by the names."""
    li = lineitem.where(date_matches("l_shipdate", pattern)).select("l_orderkey", "l_partkey", "l_suppkey")
    named = li.join(part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).join(supplier.select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    return named.select("l_orderkey", "p_name", "s_name").orderBy("l_orderkey", "p_name", "s_name").limit(n)


def _by_nation(li: DataFrame, orders: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    o = orders.select("o_orderkey", "o_custkey").join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    li = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return li.join(nation.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))


def nation_counts(lineitem: DataFrame, orders: DataFrame, customer: DataFrame, nation: DataFrame, pattern: str) -> DataFrame:
    """q4 (n_nationkey, n_name, cnt): matching line items by the customer's nation, in order of its key."""
    li = lineitem.where(date_matches("l_shipdate", pattern)).select("l_orderkey")
    return _by_nation(li, orders, customer, nation).groupBy("n_nationkey", "n_name").agg(F.count("*").alias("cnt")).orderBy("n_nationkey")


def monthly_counts(lineitem: DataFrame, orders: DataFrame, customer: DataFrame, nation: DataFrame, nations: tuple[int, ...] = (3, 24)) -> DataFrame:
    """q5 (month, n_name, cnt): line items by month of shipment and nation, for customers of the given nations."""
    li = lineitem.select("l_orderkey", F.date_format("l_shipdate", "yyyy-MM").alias("month"))
    c = customer.where(F.col("c_nationkey").isin(*nations))
    return _by_nation(li, orders, c, nation).groupBy("month", "n_name").agg(F.count("*").alias("cnt"))


def pricing_summary(lineitem: DataFrame, pattern: str) -> DataFrame:
    """q6: sums, averages and the count (a double) of matching line items by return flag and line status."""
    price = money("l_extendedprice") * (1 - _rate("l_discount"))
    charge = price * (1 + _rate("l_tax"))
    n = F.count("*").cast("double")
    s = lineitem.where(date_matches("l_shipdate", pattern)).groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(money("l_quantity")).cast("double").alias("sum_qty"), F.sum(money("l_extendedprice")).cast("double").alias("sum_base_price"), F.sum(price).cast("double").alias("sum_disc_price"), F.sum(charge).cast("double").alias("sum_charge"), F.sum(_rate("l_discount")).cast("double").alias("sum_disc"), n.alias("count_order")
    )
    average = lambda c: F.round(F.col(c) / F.col("count_order"), 6)
    return s.select("l_returnflag", "l_linestatus", "sum_qty", "sum_base_price", "sum_disc_price", "sum_charge", average("sum_qty").alias("avg_qty"), average("sum_base_price").alias("avg_price"), average("sum_disc").alias("avg_disc"), "count_order")


def unshipped_revenue(lineitem: DataFrame, orders: DataFrame, customer: DataFrame, day: str, attribute: str, n: int = 10) -> DataFrame:
    """q7 (c_name, o_orderkey, revenue, o_orderdate, attribute): the n highest revenues of orders from before the day with line
    items shipped after it; ties by customer, then order."""
    at = _midnight(date.fromisoformat(day))
    # texts are compared, so a later hour of the day isn't after it
    li = lineitem.where(F.col("l_shipdate") >= at + F.expr("interval 1 day")).select("l_orderkey", (money("l_extendedprice") * (1 - _rate("l_discount"))).alias("r"))
    o = orders.where(F.col("o_orderdate") < at).select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), attribute)
    # an order has one customer: revenue is summed by order before customers are looked up
    sums = o.join(li.groupBy("l_orderkey").agg(F.sum("r").alias("r")), F.col("o_orderkey") == F.col("l_orderkey"))
    named = sums.join(customer.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    per = named.groupBy("c_name", "o_orderkey", "o_orderdate", attribute).agg(F.sum("r").cast("double").alias("revenue"))
    return per.select("c_name", "o_orderkey", "revenue", "o_orderdate", attribute).orderBy(F.desc("revenue"), "c_name", "o_orderkey").limit(n)
