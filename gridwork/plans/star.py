"""The retail star schema as Spark building blocks.

Stand-ins on the driver tables (the lessons use a Superstore sheet):
sales = l_extendedprice * (1 - l_discount); profit = sales - l_quantity *
p_retailprice; region via customer -> nation -> region; state = nation;
category = p_type; sub-category = p_brand; segment = c_mktsegment; ship mode
= o_orderpriority (there is no ship-mode column).

Money is summed as DECIMAL so totals do not depend on summation order.

Scale notes. lineitem, orders, customer and part grow with the data; nation
(25 rows) and region (5 rows) are left to AQE like the others. Measures are aggregated to the join key before each join (per order,
then per customer), so only pre-aggregated rows cross the big shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwork.sources import Tables

MONEY = "decimal(18,2)"


def money(c: str) -> Column:
    return F.col(c).cast(MONEY)


# Line-level money types are sized to the value domains (price below 10^10,
# quantity below 10^4, retail price below 10^9, discount in [0, 1)) so every
# product stays a compact DECIMAL of at most 18 digits (a long inside the
# JVM, not a BigDecimal); sums widen to DECIMAL(28+, 4) and stay exact. A
# value outside a domain fails the cast (ANSI) instead of being wrapped.
def sales_expr() -> Column:
    """Exact line revenue, DECIMAL(17,4)."""
    one_minus = F.lit(1).cast("decimal(3,2)") - F.col("l_discount").cast("decimal(3,2)")
    return F.col("l_extendedprice").cast("decimal(12,2)") * one_minus


def cost_expr() -> Column:
    """Exact line cost, DECIMAL(18,4)."""
    return F.col("l_quantity").cast("decimal(6,2)") * F.col("p_retailprice").cast("decimal(11,2)")


def dims(t: Tables) -> DataFrame:
    """nation joined with region (25 rows); AQE sees their size."""
    nation = t.nation.select("n_nationkey", "n_name", "n_regionkey")
    return nation.join(t.region, nation.n_regionkey == F.col("r_regionkey")).select(
        "n_nationkey", "n_name", "r_regionkey", "r_name")


def lines_with_profit(t: Tables, extra_line_cols=()) -> DataFrame:
    """lineitem with exact ``sales``, ``cost`` and ``profit`` per line.

    part grows with the data, so the join is left to the planner (AQE turns it
    into a broadcast only when the measured part side is small).
    """
    li = t.lineitem.select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice",
                           "l_discount", *extra_line_cols)
    part = t.part.select("p_partkey", "p_retailprice", "p_type", "p_brand")
    j = li.join(part, li.l_partkey == part.p_partkey)
    return j.withColumn("sales", sales_expr()).withColumn("cost", cost_expr()) \
            .withColumn("profit", F.col("sales") - F.col("cost"))


def product_totals(t: Tables) -> DataFrame:
    """One row per product sold: exact ``sales``, ``quantity`` and line count.
    Lines are summed in each task before the shuffle by product, so a product
    holding a third of the lines is a row per task there."""
    li = t.lineitem.select("l_partkey", "l_quantity", "l_extendedprice", "l_discount").where(F.col("l_partkey").isNotNull())
    return li.groupBy("l_partkey").agg(F.sum(sales_expr()).alias("sales"), F.sum(F.col("l_quantity").cast("decimal(6,2)")).alias("quantity"),
                                       F.count(F.lit(1)).alias("n_lines"))


def product_profit(t: Tables) -> DataFrame:
    """``product_totals`` with ``profit``: a product's lines cost its retail
    price times their summed quantity, so part is joined to the totals (which
    are dealt by product already), not to the lines."""
    part = t.part.select("p_partkey", F.col("p_retailprice").cast("decimal(11,2)").alias("price"))
    j = product_totals(t).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return j.select("l_partkey", "sales", "n_lines", (F.col("sales") - F.col("quantity") * F.col("price")).alias("profit"))


def product_line_profit(t: Tables) -> DataFrame:
    """``product_profit`` with ``best_line_profit``. Lines of one product and
    quantity cost the same, so the best of them is the one that sold for most:
    (product, quantity) rows are joined to part, not lines."""
    li = t.lineitem.select("l_partkey", "l_quantity", "l_extendedprice", "l_discount").where(F.col("l_partkey").isNotNull())
    by_quantity = li.groupBy("l_partkey", "l_quantity").agg(F.sum(sales_expr()).alias("sales"), F.count(F.lit(1)).alias("n_lines"), F.max(sales_expr()).alias("best"))
    j = by_quantity.join(t.part.select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    j = j.withColumn("cost", cost_expr())
    return j.groupBy("l_partkey").agg(F.sum("sales").alias("sales"), F.sum(F.col("sales") - F.col("cost") * F.col("n_lines")).alias("profit"),
                                      F.sum("n_lines").alias("n_lines"), F.max(F.col("best") - F.col("cost")).alias("best_line_profit"))


def customer_region(t: Tables) -> DataFrame:
    """customer with its nation and region names."""
    c = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment")
    return c.join(dims(t), c.c_nationkey == F.col("n_nationkey")).drop("n_nationkey")


def order_facts(t: Tables, with_profit: bool = True) -> DataFrame:
    """One row per order: exact sales, quantity, line count and discount sum
    (and cost and profit when ``with_profit``), joined to the order's date,
    customer and priority.

    Lines are reduced to one row per order before the orders join, so the
    big join carries a quarter of the line rows. Without ``with_profit`` the
    part join (a shuffle of all lines by part key) is left out entirely.
    """
    common = [F.sum(money("l_quantity")).alias("quantity"), F.count(F.lit(1)).alias("n_lines"),
              F.sum(F.col("l_discount").cast("decimal(4,2)")).alias("discount_sum")]
    if with_profit:
        lines = lines_with_profit(t)
        per_order = lines.groupBy("l_orderkey").agg(
            F.sum("sales").alias("sales"), F.sum("cost").alias("cost"), F.sum("profit").alias("profit"), *common)
    else:
        li = t.lineitem.select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount")
        per_order = li.groupBy("l_orderkey").agg(F.sum(sales_expr()).alias("sales"), *common)
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    return per_order.join(o, per_order.l_orderkey == o.o_orderkey).drop("l_orderkey")


def customer_dims(t: Tables) -> DataFrame:
    """customer with segment, nation and region names."""
    c = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment")
    return c.join(dims(t), c.c_nationkey == F.col("n_nationkey")).drop("c_nationkey")


def order_places(t: Tables, extra: tuple = ()) -> DataFrame:
    """One row per order with its customer's nation and region (an
    orders-sized table). Joining lines to it on the order key needs one
    shuffle of the lines, by order key, instead of one by order and another
    by customer."""
    o = t.orders.select("o_orderkey", "o_custkey", *extra)
    return o.join(customer_dims(t), o.o_custkey == F.col("c_custkey")).select(
        "o_orderkey", "n_name", "r_name", "c_mktsegment", *extra)


def orders_with_customer(t: Tables, with_profit: bool = True) -> DataFrame:
    """``order_facts`` with the customer's segment, nation and region."""
    of = order_facts(t, with_profit)
    return of.join(customer_dims(t), of.o_custkey == F.col("c_custkey")).drop("c_custkey")
