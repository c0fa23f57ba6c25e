"""The retail analysis questions of the lessons, as Spark jobs on the star
schema (stand-ins described in ``star``).

Each question aggregates at the finest join key first and joins the dimension
rows onto the pre-aggregated result, so the big shuffles carry one row per
order or per customer rather than one per line.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridwork.functions import dates as DT
from gridwork.operators import aggregate as AG
from gridwork.operators import order as O
from gridwork.operators.window import lag_in_group
from gridwork.plans.registry import register
from gridwork.plans.sqlkit import CUST_CTE, LINES_CTE, ORDERS_CTE, SALES, avg_dec
from gridwork.plans.star import (
    customer_dims, dims, lines_with_profit, money, order_facts, order_places, orders_with_customer, product_line_profit, product_profit, product_totals, sales_expr,
)
from gridwork.sources import Tables

# --------------------------------------------------------------------------
# Q3 / A16 / A21: sales by region, share of the total, with a grand-total row.

_SQL_Q03 = f"""
WITH s AS (
  SELECT r_name, SUM({SALES}) AS sales
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  GROUP BY r_name),
t AS (SELECT r_name AS region, sales FROM s
      UNION ALL SELECT 'Grand Total', SUM(sales) FROM s)
SELECT region, CAST(sales AS DOUBLE) AS sales,
       CAST(sales AS DOUBLE) * 100.0 / (SELECT CAST(SUM(sales) AS DOUBLE) FROM s) AS share_pct
FROM t
"""


def sales_by_region_total(spark, sf_dir):
    t = Tables(spark, sf_dir)
    per_order = t.lineitem.groupBy("l_orderkey").agg(F.sum(sales_expr()).alias("sales"))
    o = t.orders.select("o_orderkey", "o_custkey")
    per_cust = (per_order.join(o, per_order.l_orderkey == o.o_orderkey)
                .groupBy("o_custkey").agg(F.sum("sales").alias("sales")))
    c = t.customer.select("c_custkey", "c_nationkey")
    per_nation = (per_cust.join(c, per_cust.o_custkey == c.c_custkey)
                  .groupBy("c_nationkey").agg(F.sum("sales").alias("sales")))
    with_region = per_nation.join(dims(t), per_nation.c_nationkey == F.col("n_nationkey"))
    grouped = with_region.groupingSets([["r_name"], []], "r_name").agg(
        F.sum("sales").alias("sales"), F.grouping_id().alias("gid"))
    # The grouped result has one row per region plus the total row (a fixed
    # handful), so the grand total is read with a window over it.
    total = F.max(F.when(F.col("gid") == 1, F.col("sales"))).over(Window.partitionBy()).cast("double")
    return grouped.select(
        F.when(F.col("gid") == 0, F.col("r_name")).otherwise(F.lit("Grand Total")).alias("region"),
        F.col("sales").cast("double").alias("sales"),
        (F.col("sales").cast("double") * F.lit(100.0) / total).alias("share_pct"))


register("q03_sales_by_region_total", _SQL_Q03)(sales_by_region_total)


# ---------------------------------------------------------------------------
# The remaining questions. Shared SQL building blocks mirror plans.star.

_WITH_ALL = f"WITH {LINES_CTE},\n{CUST_CTE},\n{ORDERS_CTE}\n"


def _d(c):
    """Exact decimal total as DOUBLE."""
    return F.col(c).cast("double")


def _ratio(num, den):
    return (F.col(num).cast("double") / F.col(den).cast("double"))


@register("q01_monthly_sales_profit", _WITH_ALL + """
, m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, sum(sales) AS sales, sum(profit) AS profit
        FROM ofacts GROUP BY 1)
SELECT month, CAST(sales AS DOUBLE) AS sales, CAST(profit AS DOUBLE) AS profit,
       CAST(profit - lag(profit) OVER (ORDER BY month) AS DOUBLE) AS profit_change
FROM m""")
def q01_monthly_sales_profit(spark, sf):
    """Sales and profit per month and the month-over-month profit change
    (Q1, Q2, Q46). The lag runs over the small monthly table."""
    of = order_facts(Tables(spark, sf))
    m = of.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(
        F.sum("sales").alias("sales"), F.sum("profit").alias("profit"))
    prev = F.lag("profit").over(Window.orderBy("month"))
    return m.select("month", _d("sales").alias("sales"), _d("profit").alias("profit"),
                    (F.col("profit") - prev).cast("double").alias("profit_change"))


@register("q02_sales_trend_slope", _WITH_ALL + """
, m AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) AS month_index, CAST(sum(sales) AS DOUBLE) AS sales
        FROM ofacts GROUP BY 1)
SELECT round(regr_slope(sales, month_index), 6) AS slope_per_month, round(corr(sales, month_index), 9) AS corr
FROM m""")
def q02_sales_trend_slope(spark, sf):
    """Is there a trend? Least-squares slope of monthly sales on the month
    index, and their correlation."""
    of = order_facts(Tables(spark, sf), with_profit=False)
    m = of.groupBy((F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("month_index")) \
          .agg(F.sum("sales").cast("double").alias("sales"))
    return m.agg(F.round(F.regr_slope("sales", "month_index"), 6).alias("slope_per_month"),
                 F.round(F.corr("sales", "month_index"), 9).alias("corr"))


@register("q27_seasonality", _WITH_ALL + """
SELECT CAST(month(o_orderdate) AS INT) AS month_of_year, CAST(sum(sales) AS DOUBLE) AS sales,
       count(DISTINCT year(o_orderdate)) AS n_years
FROM ofacts GROUP BY 1""")
def q27_seasonality(spark, sf):
    """Sales per calendar month over all years (seasonality, best months)."""
    of = order_facts(Tables(spark, sf), with_profit=False)
    return of.groupBy(F.month("o_orderdate").alias("month_of_year")).agg(
        F.sum("sales").cast("double").alias("sales"), F.count_distinct(F.year("o_orderdate")).alias("n_years"))


@register("q05_sales_by_nation", _WITH_ALL + """
SELECT n_name, CAST(sum(sales) AS DOUBLE) AS sales, CAST(sum(profit) AS DOUBLE) AS profit,
       CAST(sum(profit) AS DOUBLE) / CAST(sum(sales) AS DOUBLE) AS margin
FROM oc GROUP BY n_name""")
def q05_sales_by_nation(spark, sf):
    """Sales, profit and margin per nation (the state of the lessons)."""
    per_cust = order_facts(Tables(spark, sf)).groupBy("o_custkey").agg(
        F.sum("sales").alias("sales"), F.sum("profit").alias("profit"))
    j = per_cust.join(customer_dims(Tables(spark, sf)), F.col("o_custkey") == F.col("c_custkey"))
    g = j.groupBy("n_name").agg(F.sum("sales").alias("sales"), F.sum("profit").alias("profit"))
    return g.select("n_name", _d("sales").alias("sales"), _d("profit").alias("profit"),
                    _ratio("profit", "sales").alias("margin"))


@register("q06_loss_nations", _WITH_ALL + """
, y AS (SELECT n_name, year(o_orderdate) AS yr, sum(profit) AS profit FROM oc GROUP BY 1, 2)
SELECT n_name, count(*) AS n_years, CAST(count_if(profit < 0) AS BIGINT) AS loss_years,
       CAST(min(profit) AS DOUBLE) AS worst_year_profit, bool_and(profit < 0) AS loses_every_year
FROM y GROUP BY n_name""")
def q06_loss_nations(spark, sf):
    """Which nations make a loss in every year? Every nation with its yearly
    loss count and the flag (an empty filter would hide the measure)."""
    t = Tables(spark, sf)
    per = order_facts(t).groupBy("o_custkey", F.year("o_orderdate").alias("yr")).agg(F.sum("profit").alias("profit"))
    j = per.join(customer_dims(t), F.col("o_custkey") == F.col("c_custkey"))
    y = j.groupBy("n_name", "yr").agg(F.sum("profit").alias("profit"))
    return y.groupBy("n_name").agg(
        F.count(F.lit(1)).alias("n_years"), F.count_if(F.col("profit") < 0).alias("loss_years"),
        F.min("profit").cast("double").alias("worst_year_profit"),
        F.bool_and(F.col("profit") < 0).alias("loses_every_year"))


@register("q10_segment_summary", _WITH_ALL + f"""
SELECT c_mktsegment, CAST(sum(sales) AS DOUBLE) AS sales, CAST(sum(profit) AS DOUBLE) AS profit,
       count(*) AS n_orders, {avg_dec('sales', 4)} AS avg_order_value
FROM oc GROUP BY c_mktsegment""")
def q10_segment_summary(spark, sf):
    """Sales, profit, orders and average order value per customer segment."""
    oc = orders_with_customer(Tables(spark, sf))
    return oc.groupBy("c_mktsegment").agg(
        F.sum("sales").cast("double").alias("sales"), F.sum("profit").cast("double").alias("profit"),
        F.count(F.lit(1)).alias("n_orders"), F.avg("sales").cast("double").alias("avg_order_value"))


@register("q31_high_sales_low_margin", _WITH_ALL + """
, g AS (SELECT n_name, CAST(sum(sales) AS DOUBLE) AS sales,
               CAST(sum(profit) AS DOUBLE) / CAST(sum(sales) AS DOUBLE) AS margin FROM oc GROUP BY n_name)
SELECT n_name, sales, margin,
       sales > (SELECT avg(sales) FROM g) AND margin < (SELECT avg(margin) FROM g) AS high_sales_low_margin
FROM g""")
def q31_high_sales_low_margin(spark, sf):
    """Nations with above-average sales but below-average margin (flag next
    to every nation)."""
    g = q05_sales_by_nation(spark, sf).select("n_name", "sales", "margin")
    # One row per nation (a fixed-size dimension): averages by a window.
    whole = Window.partitionBy()
    flag = (F.col("sales") > F.avg("sales").over(whole)) & (F.col("margin") < F.avg("margin").over(whole))
    return g.withColumn("high_sales_low_margin", flag)


@register("q04_avg_discount_by_group", f"""
WITH {LINES_CTE}, {CUST_CTE}
SELECT 'region' AS dimension, r_name AS grp, {avg_dec('CAST(l_discount AS DECIMAL(4,2))', 2)} AS avg_discount
FROM lines JOIN orders ON l_orderkey = o_orderkey JOIN cust ON o_custkey = c_custkey GROUP BY r_name
UNION ALL
SELECT 'segment', c_mktsegment, {avg_dec('CAST(l_discount AS DECIMAL(4,2))', 2)}
FROM lines JOIN orders ON l_orderkey = o_orderkey JOIN cust ON o_custkey = c_custkey GROUP BY c_mktsegment
UNION ALL
SELECT 'type', p_type, {avg_dec('CAST(l_discount AS DECIMAL(4,2))', 2)} FROM lines GROUP BY p_type""")
def q04_avg_discount_by_group(spark, sf):
    """Average discount per region, per segment and per category (Q4, Q15,
    Q32). Discounts are summed and counted per order first, so the region and
    segment totals need one row per order, not per line."""
    t = Tables(spark, sf)
    oc = orders_with_customer(t, with_profit=False)
    # Region and segment totals come from one grouping-sets aggregate (one
    # pass over the order rows instead of one per dimension).
    g = oc.groupingSets([["r_name"], ["c_mktsegment"]], "r_name", "c_mktsegment").agg(
        F.sum("discount_sum").alias("s"), F.sum("n_lines").alias("n"), F.grouping_id().alias("gid"))
    avg = F.round(F.col("s") / F.col("n").cast("decimal(20,0)"), 6).cast("double")
    by_dim = g.select(F.when(F.col("gid") == 1, F.lit("region")).otherwise(F.lit("segment")).alias("dimension"),
                      F.when(F.col("gid") == 1, F.col("r_name")).otherwise(F.col("c_mktsegment")).alias("grp"),
                      avg.alias("avg_discount"))
    lines = lines_with_profit(t)
    by_type = lines.groupBy("p_type").agg(F.avg(F.col("l_discount").cast("decimal(4,2)")).alias("a")).select(
        F.lit("type").alias("dimension"), F.col("p_type").alias("grp"), F.col("a").cast("double").alias("avg_discount"))
    return by_dim.unionByName(by_type)


@register("q07_margin_by_type", f"""
WITH {LINES_CTE}
SELECT p_type, CAST(sum(sales) AS DOUBLE) AS sales, CAST(sum(profit) AS DOUBLE) AS profit,
       CAST(sum(profit) AS DOUBLE) / CAST(sum(sales) AS DOUBLE) AS margin
FROM lines GROUP BY p_type""")
def q07_margin_by_type(spark, sf):
    """Profit margin per category (``p_type``)."""
    li = lines_with_profit(Tables(spark, sf))
    g = li.groupBy("p_type").agg(F.sum("sales").alias("sales"), F.sum("profit").alias("profit"))
    return g.select("p_type", _d("sales").alias("sales"), _d("profit").alias("profit"),
                    _ratio("profit", "sales").alias("margin"))


@register("q08_discount_correlations", f"""
WITH {LINES_CTE}
SELECT round(corr(l_discount, CAST(profit AS DOUBLE)), 9) AS corr_discount_profit,
       round(corr(l_discount, CAST(sales AS DOUBLE)), 9) AS corr_discount_sales,
       round(corr(l_discount, l_quantity), 9) AS corr_discount_quantity,
       round(corr(l_quantity, CAST(profit AS DOUBLE)), 9) AS corr_quantity_profit,
       round(regr_slope(CAST(profit AS DOUBLE), l_discount), 3) AS slope_profit_per_discount
FROM lines""")
def q08_discount_correlations(spark, sf):
    """Does discount move profit, sales or quantity? (Q8, Q36, Q37, Q39):
    Pearson correlations and the least-squares slope, in one aggregate."""
    li = lines_with_profit(Tables(spark, sf))
    p, s = F.col("profit").cast("double"), F.col("sales").cast("double")
    return li.agg(F.round(F.corr("l_discount", p), 9).alias("corr_discount_profit"),
                  F.round(F.corr("l_discount", s), 9).alias("corr_discount_sales"),
                  F.round(F.corr("l_discount", "l_quantity"), 9).alias("corr_discount_quantity"),
                  F.round(F.corr("l_quantity", p), 9).alias("corr_quantity_profit"),
                  F.round(F.regr_slope(p, "l_discount"), 3).alias("slope_profit_per_discount"))


@register("q39_discount_bands", f"""
WITH {LINES_CTE}
SELECT CASE WHEN l_discount >= 0.08 THEN 'high' WHEN l_discount >= 0.04 THEN 'medium'
            WHEN l_discount > 0 THEN 'low' ELSE 'none' END AS discount_band,
       count(*) AS n_lines, CAST(sum(profit) AS DOUBLE) AS profit, {avg_dec('profit', 4)} AS avg_profit,
       CAST(count_if(profit < 0) AS BIGINT) AS losing_lines
FROM lines GROUP BY 1""")
def q39_discount_bands(spark, sf):
    """Profit per discount band (if / elif / else banding)."""
    li = lines_with_profit(Tables(spark, sf))
    d = F.col("l_discount")
    band = F.when(d >= 0.08, "high").when(d >= 0.04, "medium").when(d > 0, "low").otherwise("none")
    return li.groupBy(band.alias("discount_band")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("profit").cast("double").alias("profit"),
        F.avg("profit").cast("double").alias("avg_profit"), F.count_if(F.col("profit") < 0).alias("losing_lines"))


@register("q09_customer_order_value", _WITH_ALL + f"""
SELECT o_custkey, count(*) AS n_orders, {avg_dec('sales', 4)} AS avg_order_value,
       {avg_dec('quantity', 2)} AS avg_order_quantity, CAST(sum(n_lines) AS BIGINT) AS n_lines
FROM ofacts GROUP BY o_custkey""")
def q09_customer_order_value(spark, sf):
    """Average order value and size per customer (Q9, Q20): a two-level
    aggregate, lines to orders to customers."""
    of = order_facts(Tables(spark, sf), with_profit=False)
    return of.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"), F.avg("sales").cast("double").alias("avg_order_value"),
        F.avg("quantity").cast("double").alias("avg_order_quantity"), F.sum("n_lines").cast("long").alias("n_lines"))


_PARTS_SQL = f"""WITH {LINES_CTE}, ps AS (
  SELECT l_partkey, sum(sales) AS sales, sum(profit) AS profit, count(*) AS n_lines,
         max(profit) AS best_line_profit FROM lines GROUP BY l_partkey)"""


@register("q11_top_products", _PARTS_SQL + """
SELECT l_partkey, CAST(sales AS DOUBLE) AS sales FROM ps ORDER BY sales DESC, l_partkey LIMIT 10""")
def q11_top_products(spark, sf):
    """Best-selling products (top 10 by sales, key tie-break)."""
    ps = product_totals(Tables(spark, sf)).select("l_partkey", "sales")
    return O.top_k(ps, "sales", 10, ["l_partkey"]).select("l_partkey", _d("sales").alias("sales"))


@register("q13_worst_products", _PARTS_SQL + """
SELECT l_partkey, CAST(profit AS DOUBLE) AS profit FROM ps ORDER BY profit, l_partkey LIMIT 10""")
def q13_worst_products(spark, sf):
    """Least profitable products (bottom 10 by profit)."""
    ps = product_profit(Tables(spark, sf)).select("l_partkey", "profit")
    return O.top_k(ps, "profit", 10, ["l_partkey"], ascending=True).select("l_partkey", _d("profit").alias("profit"))


@register("q12_product_profit_flags", _PARTS_SQL + """
SELECT l_partkey, CAST(sales AS DOUBLE) AS sales, CAST(profit AS DOUBLE) AS profit, n_lines,
       profit < 0 AS losing, best_line_profit < 0 AS always_unprofitable
FROM ps""")
def q12_product_profit_flags(spark, sf):
    """Every product with its totals and two flags: loses in total, and
    loses on every line (Q12, Q50)."""
    ps = product_line_profit(Tables(spark, sf))
    return ps.select("l_partkey", _d("sales").alias("sales"), _d("profit").alias("profit"), "n_lines",
                     (F.col("profit") < 0).alias("losing"), (F.col("best_line_profit") < 0).alias("always_unprofitable"))


@register("q14_profit_distribution", _PARTS_SQL + """
SELECT CAST(floor(CAST(profit AS DOUBLE) / 50000) AS BIGINT) * 50000 AS profit_bin, count(*) AS n_products
FROM ps GROUP BY 1""")
def q14_profit_distribution(spark, sf):
    """How product profit is distributed: products per 50,000-wide bin."""
    ps = product_profit(Tables(spark, sf))
    b = (F.floor(F.col("profit").cast("double") / 50000).cast("long") * 50000).alias("profit_bin")
    return ps.groupBy(b).agg(F.count(F.lit(1)).alias("n_products"))


@register("q16_over_discounted_losing", f"""
WITH {LINES_CTE}
SELECT p_brand, {avg_dec('CAST(l_discount AS DECIMAL(4,2))', 2)} AS avg_discount, CAST(sum(profit) AS DOUBLE) AS profit,
       avg(CAST(l_discount AS DECIMAL(4,2))) > 0.05 AND sum(profit) < 0 AS over_discounted_losing
FROM lines GROUP BY p_brand""")
def q16_over_discounted_losing(spark, sf):
    """Sub-categories (brands) with a high average discount and a loss:
    every brand with the flag."""
    li = lines_with_profit(Tables(spark, sf))
    g = li.groupBy("p_brand").agg(F.avg(F.col("l_discount").cast("decimal(4,2)")).alias("d"),
                                  F.sum("profit").alias("p"))
    return g.select("p_brand", F.col("d").cast("double").alias("avg_discount"), F.col("p").cast("double").alias("profit"),
                    ((F.col("d") > 0.05) & (F.col("p") < 0)).alias("over_discounted_losing"))


@register("q17_repeat_buyers", """
WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT count(*) AS customers, CAST(count_if(n > 1) AS BIGINT) AS repeat_customers,
       CAST(count_if(n > 1) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS repeat_rate,
       CAST(sum(n) AS BIGINT) AS orders
FROM c""")
def q17_repeat_buyers(spark, sf):
    """Reorder rate: share of ordering customers with more than one order
    (Q17, Q22)."""
    c = Tables(spark, sf).orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return c.agg(F.count(F.lit(1)).alias("customers"), F.count_if(F.col("n") > 1).alias("repeat_customers"),
                 (F.count_if(F.col("n") > 1).cast("double") / F.count(F.lit(1)).cast("double")).alias("repeat_rate"),
                 F.sum("n").cast("long").alias("orders"))


@register("q23_order_gaps", """
WITH g AS (SELECT o_custkey, date_diff('day', lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey),
                  o_orderdate) AS gap FROM orders)
SELECT o_custkey, count(*) AS n_orders, CAST(max(gap) AS BIGINT) AS max_gap_days,
       CAST(sum(gap) AS DOUBLE) / CAST(count(gap) AS DOUBLE) AS avg_gap_days
FROM g GROUP BY o_custkey""")
def q23_order_gaps(spark, sf):
    """Days between a customer's consecutive orders: the largest and the
    average gap. The lag is computed on range chunks, so a customer with a
    very large order history is still spread over many tasks."""
    o = Tables(spark, sf).orders.select("o_orderkey", "o_custkey", "o_orderdate")
    lagged = lag_in_group(o, "o_orderdate", ["o_orderdate", "o_orderkey"], ["o_custkey"], name="prev")
    gap = DT.days_between("o_orderdate", "prev")
    return lagged.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"), F.max(gap).cast("long").alias("max_gap_days"),
        (F.sum(gap).cast("double") / F.count(gap).cast("double")).alias("avg_gap_days"))


@register("q18_product_region_spread", f"""
WITH {CUST_CTE}, pr AS (
  SELECT DISTINCT l_partkey, r_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN cust ON o_custkey = c_custkey)
SELECT l_partkey, count(*) AS n_regions, count(*) = 1 AS single_region FROM pr GROUP BY l_partkey""")
def q18_product_region_spread(spark, sf):
    """In how many regions is each product sold (flag: only one)? Lines meet
    their order's region in one join on the order key; the (part, region)
    pairs are then de-duplicated with a partial aggregate (few regions)."""
    t = Tables(spark, sf)
    li = t.lineitem.select("l_orderkey", "l_partkey")
    op = order_places(t)
    pr = li.join(op, li.l_orderkey == op.o_orderkey).select("l_partkey", "r_name").distinct()
    return pr.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n_regions"),
                                       (F.count(F.lit(1)) == 1).alias("single_region"))


@register("q48_region_type_popularity", _WITH_ALL + """
SELECT r_name, p_type, count(*) AS n_lines, CAST(sum(sales) AS DOUBLE) AS sales
FROM lines JOIN orders ON l_orderkey = o_orderkey JOIN cust ON o_custkey = c_custkey
GROUP BY r_name, p_type""")
def q48_region_type_popularity(spark, sf):
    """Popularity of each category in each region (line counts and sales)."""
    t = Tables(spark, sf)
    li = lines_with_profit(t)
    op = order_places(t)
    j = li.join(op, li.l_orderkey == op.o_orderkey)
    return j.groupBy("r_name", "p_type").agg(F.count(F.lit(1)).alias("n_lines"),
                                             F.sum("sales").cast("double").alias("sales"))


@register("q19_top_customers", _WITH_ALL + """
SELECT o_custkey, CAST(sum(sales) AS DOUBLE) AS sales FROM ofacts GROUP BY o_custkey
ORDER BY sum(sales) DESC, o_custkey LIMIT 10""")
def q19_top_customers(spark, sf):
    """Top 10 customers by purchase value."""
    of = order_facts(Tables(spark, sf), with_profit=False)
    per = of.groupBy("o_custkey").agg(F.sum("sales").alias("sales"))
    return O.top_k(per, "sales", 10, ["o_custkey"]).select("o_custkey", _d("sales").alias("sales"))


@register("q21_segment_frequency", f"""
WITH {CUST_CTE}
SELECT c_mktsegment, count(*) AS n_orders FROM orders JOIN cust ON o_custkey = c_custkey GROUP BY c_mktsegment""")
def q21_segment_frequency(spark, sf):
    """Which segment orders most often (value counts of the segment over
    orders)."""
    t = Tables(spark, sf)
    per = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    j = per.join(t.customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("c_mktsegment").agg(F.sum("n").cast("long").alias("n_orders")) \
            .orderBy(F.col("n_orders").desc(), "c_mktsegment")


@register("q24_weekday_rates", _WITH_ALL + f"""
SELECT CAST(isodow(o_orderdate) - 1 AS INT) AS weekday, isodow(o_orderdate) >= 6 AS weekend,
       count(*) AS n_orders, CAST(sum(sales) AS DOUBLE) AS sales, {avg_dec('sales', 4)} AS avg_order_value
FROM ofacts GROUP BY 1, 2""")
def q24_weekday_rates(spark, sf):
    """Orders, sales and average order value per weekday (Monday = 0), with
    the weekend flag (Q24, Q47): rates, not raw totals, for the comparison."""
    of = order_facts(Tables(spark, sf), with_profit=False)
    return of.groupBy(DT.weekday("o_orderdate").alias("weekday"), DT.is_weekend("o_orderdate").alias("weekend")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum("sales").cast("double").alias("sales"),
        F.avg("sales").cast("double").alias("avg_order_value"))


@register("q25_ship_delay", f"""
WITH {CUST_CTE}, d AS (
  SELECT r_name, o_orderpriority, date_diff('day', o_orderdate, l_shipdate) AS delay
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN cust ON o_custkey = c_custkey)
SELECT r_name, o_orderpriority, count(*) AS n_lines, CAST(sum(delay) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS avg_delay_days,
       CAST(count_if(delay < 0) AS BIGINT) AS shipped_before_order, CAST(count_if(delay > 30) AS BIGINT) AS late_lines,
       CAST(count_if(delay > 30) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS late_share
FROM d GROUP BY r_name, o_orderpriority""")
def q25_ship_delay(spark, sf):
    """Shipping delay (ship date - order date) by region and by priority (the
    ship-mode stand-in), with the count of negative delays and the late
    share (> 30 days) (Q25, Q26, Q44). Lines meet their order's date,
    priority and region in one join on the order key; the grouping is a
    partial aggregate over a handful of (region, priority) keys."""
    t = Tables(spark, sf)
    li = t.lineitem.select("l_orderkey", "l_shipdate")
    op = order_places(t, ("o_orderdate", "o_orderpriority"))
    d = li.join(op, li.l_orderkey == op.o_orderkey).withColumn("delay", DT.days_between("l_shipdate", "o_orderdate"))
    g = d.groupBy("r_name", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("delay").alias("s"),
        F.count_if(F.col("delay") < 0).alias("shipped_before_order"), F.count_if(F.col("delay") > 30).alias("late_lines"))
    return g.select("r_name", "o_orderpriority", F.col("n_lines").cast("long").alias("n_lines"),
                    (F.col("s").cast("double") / F.col("n_lines").cast("double")).alias("avg_delay_days"),
                    F.col("shipped_before_order").cast("long").alias("shipped_before_order"),
                    F.col("late_lines").cast("long").alias("late_lines"),
                    (F.col("late_lines").cast("double") / F.col("n_lines").cast("double")).alias("late_share"))


@register("q28_holiday_discount", _WITH_ALL + f"""
SELECT month(o_orderdate) IN (11, 12) AS holiday, count(*) AS n_orders, CAST(sum(sales) AS DOUBLE) AS sales,
       CAST(sum(discount_sum) AS DOUBLE) / CAST(sum(n_lines) AS DOUBLE) AS avg_discount
FROM ofacts GROUP BY 1""")
def q28_holiday_discount(spark, sf):
    """Holiday months (November, December; our choice) against the rest:
    orders, sales and average discount."""
    of = order_facts(Tables(spark, sf), with_profit=False)
    g = of.groupBy(F.month("o_orderdate").isin(11, 12).alias("holiday")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum("sales").cast("double").alias("sales"),
        (F.sum("discount_sum").cast("double") / F.sum("n_lines").cast("double")).alias("avg_discount"))
    return g


@register("q29_top_nations_by_profit", _WITH_ALL + """
SELECT n_name, CAST(sum(profit) AS DOUBLE) AS profit FROM oc GROUP BY n_name ORDER BY sum(profit) DESC, n_name LIMIT 5""")
def q29_top_nations_by_profit(spark, sf):
    """The most profitable places (nation stands in for city)."""
    g = q05_sales_by_nation(spark, sf).select("n_name", "profit")
    return O.top_k(g, "profit", 5, ["n_name"])


@register("q33_quantity_per_product", f"""
WITH {LINES_CTE}
SELECT l_partkey, {avg_dec('CAST(l_quantity AS DECIMAL(18,2))', 2)} AS avg_quantity,
       CAST(sum(l_quantity) AS DOUBLE) AS total_quantity
FROM lines GROUP BY l_partkey""")
def q33_quantity_per_product(spark, sf):
    """Average and total quantity per product."""
    li = Tables(spark, sf).lineitem.select("l_partkey", "l_quantity").where(F.col("l_partkey").isNotNull())
    return li.groupBy("l_partkey").agg(F.avg(money("l_quantity")).cast("double").alias("avg_quantity"),
                                       F.sum("l_quantity").cast("double").alias("total_quantity"))


@register("q34_bulk_orders_losses", f"""
WITH {LINES_CTE}, q AS (SELECT quantile_cont(l_quantity, 0.9) AS p90 FROM lineitem)
SELECT l_quantity >= (SELECT p90 FROM q) AS bulk, count(*) AS n_lines, CAST(count_if(profit < 0) AS BIGINT) AS losing_lines,
       CAST(count_if(profit < 0) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS losing_share,
       CAST(sum(profit) AS DOUBLE) AS profit
FROM lines GROUP BY 1""")
def q34_bulk_orders_losses(spark, sf):
    """Are bulk lines (quantity at or above the exact 90th percentile) more
    often losing? (Q34, Q35)."""
    t = Tables(spark, sf)
    p90 = AG.exact_quantiles(t.lineitem, "l_quantity", [0.9], names=["p90"]).scalar()
    li = lines_with_profit(t)
    g = li.groupBy((F.col("l_quantity") >= p90).alias("bulk")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("profit") < 0).alias("losing_lines"),
        F.sum("profit").cast("double").alias("profit"))
    return g.select("bulk", "n_lines", "losing_lines",
                    (F.col("losing_lines").cast("double") / F.col("n_lines").cast("double")).alias("losing_share"),
                    "profit")


@register("q32_nation_discount", _WITH_ALL + """
, n AS (SELECT n_name, sum(discount_sum) AS s, CAST(sum(n_lines) AS BIGINT) AS n FROM oc GROUP BY n_name)
SELECT n_name, round(CAST(s AS DOUBLE) / n, 9) AS avg_discount, n AS n_lines,
       s * (SELECT sum(n) FROM n) > (SELECT sum(s) FROM n) * n AS above_overall
FROM n""")
def q32_nation_discount(spark, sf):
    """Q32: places (nations stand in for cities) that give more discount than
    the overall average; every nation with its average and the flag. The
    comparison is exact (cross-multiplied decimals)."""
    oc = orders_with_customer(Tables(spark, sf), with_profit=False)
    n = oc.groupBy("n_name").agg(F.sum("discount_sum").alias("s"), F.sum("n_lines").cast("long").alias("n"))
    whole = Window.partitionBy()  # one row per nation: a fixed-size table
    flag = F.col("s") * F.sum("n").over(whole) > F.sum("s").over(whole) * F.col("n")
    return n.select("n_name", F.round(F.col("s").cast("double") / F.col("n"), 9).alias("avg_discount"),
                    F.col("n").alias("n_lines"), flag.alias("above_overall"))


@register("q35_bulk_share_by_brand", f"""
WITH {LINES_CTE}, q AS (SELECT quantile_cont(l_quantity, 0.9) AS p90 FROM lineitem)
SELECT p_brand, count(*) AS n_lines, CAST(count_if(l_quantity >= (SELECT p90 FROM q)) AS BIGINT) AS bulk_lines,
       round(CAST(count_if(l_quantity >= (SELECT p90 FROM q)) AS DOUBLE) / count(*), 9) AS bulk_share
FROM lines GROUP BY p_brand""")
def q35_bulk_share_by_brand(spark, sf):
    """Q35: which sub-categories (brands) are mostly ordered in bulk
    (quantity at or above the exact 90th percentile)?"""
    t = Tables(spark, sf)
    p90 = AG.exact_quantiles(t.lineitem, "l_quantity", [0.9], names=["p90"]).scalar()
    li = lines_with_profit(t)
    g = li.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n_lines"),
                                  F.count_if(F.col("l_quantity") >= p90).alias("bulk_lines"))
    return g.select("p_brand", "n_lines", "bulk_lines",
                    F.round(F.col("bulk_lines").cast("double") / F.col("n_lines"), 9).alias("bulk_share"))


@register("q46_monthly_profit_last_years", _WITH_ALL + f"""
, m AS (SELECT year(o_orderdate) AS yr, month(o_orderdate) AS mo, sum(profit) AS profit FROM ofacts GROUP BY 1, 2)
SELECT CAST(yr AS INT) AS year, count(*) AS n_months, {avg_dec('profit', 4)} AS avg_monthly_profit
FROM m WHERE yr >= (SELECT max(yr) FROM m) - 2 GROUP BY yr""")
def q46_monthly_profit_last_years(spark, sf):
    """Q46: has the average monthly profit grown over the last three years of
    data? Average monthly profit per year for those years."""
    of = order_facts(Tables(spark, sf))
    m = of.groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("mo")) \
          .agg(F.sum("profit").alias("profit"))
    # One row per month (a calendar-sized table): the last year by a window.
    last = F.max("year").over(Window.partitionBy())
    m = m.withColumn("_last", last)
    return m.where(F.col("year") >= F.col("_last") - 2).groupBy("year").agg(
        F.count(F.lit(1)).alias("n_months"), F.avg("profit").cast("double").alias("avg_monthly_profit"))
