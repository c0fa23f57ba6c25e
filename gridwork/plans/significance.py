"""Group comparisons of the lessons' questions (Q38, Q40-45, Q49) as
statistics computed from grouped moments (``operators.stats``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwork.operators import stats as STS
from gridwork.plans.questions import q48_region_type_popularity
from gridwork.plans.registry import register
from gridwork.plans.sqlkit import CUST_CTE, LINES_CTE, ORDERS_CTE
from gridwork.plans.star import lines_with_profit, order_facts, orders_with_customer
from gridwork.sources import Tables


@register("st1_welch_t_sales_asia_europe", f"""
WITH {LINES_CTE}, {CUST_CTE}, {ORDERS_CTE},
m AS (SELECT r_name, count(*) AS n, avg(CAST(sales AS DOUBLE)) AS mean, var_samp(CAST(sales AS DOUBLE)) AS var
      FROM oc WHERE r_name IN ('ASIA', 'EUROPE') GROUP BY r_name),
w AS (SELECT max(n) FILTER (WHERE r_name = 'ASIA') AS n1, max(mean) FILTER (WHERE r_name = 'ASIA') AS m1,
             max(var) FILTER (WHERE r_name = 'ASIA') AS v1, max(n) FILTER (WHERE r_name = 'EUROPE') AS n2,
             max(mean) FILTER (WHERE r_name = 'EUROPE') AS m2, max(var) FILTER (WHERE r_name = 'EUROPE') AS v2 FROM m)
SELECT n1, n2, round(m1, 6) AS mean1, round(m2, 6) AS mean2,
       round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t_stat,
       round((v1 / n1 + v2 / n2) * (v1 / n1 + v2 / n2) / ((v1 / n1) * (v1 / n1) / (n1 - 1) + (v2 / n2) * (v2 / n2) / (n2 - 1)), 6) AS dof
FROM w""")
def st1_welch_t_sales_asia_europe(spark, sf):
    """Do ASIA and EUROPE orders differ in value? Welch's t on order sales."""
    oc = orders_with_customer(Tables(spark, sf), with_profit=False)
    r = STS.welch_t(oc, "r_name", F.col("sales").cast("double"), "ASIA", "EUROPE")
    return r.select("n1", "n2", *[F.round(c, 6).alias(c) for c in ("mean1", "mean2", "t_stat", "dof")])


@register("st2_anova_discount_by_type", f"""
WITH {LINES_CTE},
m AS (SELECT p_type, count(*) AS n, avg(l_discount) AS mean, var_samp(l_discount) AS var FROM lines GROUP BY p_type),
g AS (SELECT sum(n * mean) / sum(n) AS g FROM m)
SELECT round((sum(n * (mean - (SELECT g FROM g)) * (mean - (SELECT g FROM g))) / (count(*) - 1))
             / (sum((n - 1) * coalesce(var, 0)) / (sum(n) - count(*))), 6) AS f_stat,
       CAST(count(*) - 1 AS BIGINT) AS df_between, CAST(sum(n) - count(*) AS BIGINT) AS df_within
FROM m""")
def st2_anova_discount_by_type(spark, sf):
    """Does the average discount differ across categories? One-way F."""
    li = lines_with_profit(Tables(spark, sf))
    r = STS.anova_f(li, "p_type", "l_discount")
    return r.select(F.round("f_stat", 6).alias("f_stat"), "df_between", "df_within")


@register("st3_chi_square_region_type", f"""
WITH {LINES_CTE}, {CUST_CTE},
c AS (SELECT r_name, p_type, count(*) AS n FROM lines JOIN orders ON l_orderkey = o_orderkey
      JOIN cust ON o_custkey = c_custkey GROUP BY r_name, p_type),
r AS (SELECT r_name, sum(n) AS rt FROM c GROUP BY r_name),
t AS (SELECT p_type, sum(n) AS ct FROM c GROUP BY p_type),
tot AS (SELECT sum(n) AS total FROM c),
e AS (SELECT n, CAST(rt AS DOUBLE) * ct / (SELECT total FROM tot) AS e FROM c JOIN r USING (r_name) JOIN t USING (p_type))
SELECT round(sum((n - e) * (n - e) / e) + ((SELECT total FROM tot) - sum(e)), 6) AS chi2,
       CAST(((SELECT count(*) FROM r) - 1) * ((SELECT count(*) FROM t) - 1) AS BIGINT) AS dof,
       count(*) AS observed_cells
FROM e""")
def st3_chi_square_region_type(spark, sf):
    """Is category popularity independent of region? Pearson chi-square over
    the region x category line counts (absent cells count as 0)."""
    counts = q48_region_type_popularity(spark, sf).select("r_name", "p_type", F.col("n_lines").alias("n"))
    r = STS.chi_square(counts, "r_name", "p_type", "n")
    return r.select(F.round("chi2", 6).alias("chi2"), "dof", "observed_cells")


# -- More hypothesis questions, built from the same three operators. --------
# Oracle SQL templates mirroring operators.stats.

def _welch_sql(prelude: str, source: str, group: str, value: str, a: str, b: str) -> str:
    return f"""{prelude}
m AS (SELECT {group} AS g, count({value}) AS n, avg({value}) AS mean, var_samp({value}) AS var
      FROM {source} WHERE {group} IN ('{a}', '{b}') GROUP BY 1),
w AS (SELECT max(n) FILTER (WHERE g = '{a}') AS n1, max(mean) FILTER (WHERE g = '{a}') AS m1,
             max(var) FILTER (WHERE g = '{a}') AS v1, max(n) FILTER (WHERE g = '{b}') AS n2,
             max(mean) FILTER (WHERE g = '{b}') AS m2, max(var) FILTER (WHERE g = '{b}') AS v2 FROM m)
SELECT n1, n2, round(m1, 6) AS mean1, round(m2, 6) AS mean2,
       round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t_stat,
       round((v1 / n1 + v2 / n2) * (v1 / n1 + v2 / n2) / ((v1 / n1) * (v1 / n1) / (n1 - 1) + (v2 / n2) * (v2 / n2) / (n2 - 1)), 6) AS dof
FROM w"""


def _anova_sql(prelude: str, source: str, group: str, value: str) -> str:
    return f"""{prelude}
m AS (SELECT {group} AS g, count({value}) AS n, avg({value}) AS mean, var_samp({value}) AS var
      FROM {source} GROUP BY 1 HAVING count({value}) > 0),
gm AS (SELECT sum(n * mean) / sum(n) AS g FROM m)
SELECT round((sum(n * (mean - (SELECT g FROM gm)) * (mean - (SELECT g FROM gm))) / (count(*) - 1))
             / (sum((n - 1) * coalesce(var, 0)) / (sum(n) - count(*))), 6) AS f_stat,
       CAST(count(*) - 1 AS BIGINT) AS df_between, CAST(sum(n) - count(*) AS BIGINT) AS df_within
FROM m"""


def _welch_out(r):
    return r.select("n1", "n2", *[F.round(c, 6).alias(c) for c in ("mean1", "mean2", "t_stat", "dof")])


def _anova_out(r):
    return r.select(F.round("f_stat", 6).alias("f_stat"), "df_between", "df_within")


_OC = f"WITH {LINES_CTE}, {CUST_CTE}, {ORDERS_CTE},"


@register("st4_anova_quantity_by_region", _anova_sql(
    f"WITH {LINES_CTE}, {CUST_CTE}, lq AS (SELECT r_name, l_quantity FROM lines JOIN orders ON l_orderkey = o_orderkey "
    "JOIN cust ON o_custkey = c_custkey),", "lq", "r_name", "l_quantity"))
def st4_anova_quantity_by_region(spark, sf):
    """Q41: is the quantity ordered per line the same across regions?"""
    t = Tables(spark, sf)
    from gridwork.plans.star import order_places
    li = t.lineitem.select("l_orderkey", "l_quantity")
    op = order_places(t)
    j = li.join(op, li.l_orderkey == op.o_orderkey)
    return _anova_out(STS.anova_f(j, "r_name", "l_quantity"))


@register("st5_welch_t_profit_segments", _welch_sql(
    _OC, "(SELECT c_mktsegment, CAST(profit AS DOUBLE) AS p FROM oc)", "c_mktsegment", "p", "BUILDING", "AUTOMOBILE"))
def st5_welch_t_profit_segments(spark, sf):
    """Q42: does one segment make more profit per order than another
    (BUILDING vs AUTOMOBILE stand in for consumer vs corporate)?"""
    oc = orders_with_customer(Tables(spark, sf))
    return _welch_out(STS.welch_t(oc, "c_mktsegment", F.col("profit").cast("double"), "BUILDING", "AUTOMOBILE"))


@register("st6_welch_t_order_value_segments", _welch_sql(
    _OC, "(SELECT c_mktsegment, CAST(sales AS DOUBLE) AS s FROM oc)", "c_mktsegment", "s", "HOUSEHOLD", "FURNITURE"))
def st6_welch_t_order_value_segments(spark, sf):
    """Q43: is the average order value different between two segments?"""
    oc = orders_with_customer(Tables(spark, sf), with_profit=False)
    return _welch_out(STS.welch_t(oc, "c_mktsegment", F.col("sales").cast("double"), "HOUSEHOLD", "FURNITURE"))


@register("st7_anova_profit_by_priority", _anova_sql(
    _OC, "(SELECT o_orderpriority, CAST(profit AS DOUBLE) AS p FROM ofacts)", "o_orderpriority", "p"))
def st7_anova_profit_by_priority(spark, sf):
    """Q45: does profit per order differ between ship modes (priority is the
    ship-mode stand-in)?"""
    of = order_facts(Tables(spark, sf))
    return _anova_out(STS.anova_f(of, "o_orderpriority", F.col("profit").cast("double")))


@register("st8_late_share_two_priorities", """
WITH d AS (SELECT o_orderpriority AS g, date_diff('day', o_orderdate, l_shipdate) > 30 AS late
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority IN ('5-LOW', '1-URGENT')),
s AS (SELECT count(*) FILTER (WHERE g = '5-LOW') AS n1, CAST(count_if(late AND g = '5-LOW') AS BIGINT) AS k1,
             count(*) FILTER (WHERE g = '1-URGENT') AS n2, CAST(count_if(late AND g = '1-URGENT') AS BIGINT) AS k2 FROM d)
SELECT n1, k1, n2, k2, round(CAST(k1 AS DOUBLE) / n1, 9) AS share1, round(CAST(k2 AS DOUBLE) / n2, 9) AS share2,
       round((CAST(k1 AS DOUBLE) / n1 - CAST(k2 AS DOUBLE) / n2)
             / sqrt((CAST(k1 + k2 AS DOUBLE) / (n1 + n2)) * (1 - CAST(k1 + k2 AS DOUBLE) / (n1 + n2)) * (1.0 / n1 + 1.0 / n2)), 6) AS z_stat
FROM s""")
def st8_late_share_two_priorities(spark, sf):
    """Q44: are late lines (> 30 days) more frequent for one ship mode than
    another (5-LOW vs 1-URGENT)? Two-proportion z statistic."""
    from gridwork.functions import dates as DT
    t = Tables(spark, sf)
    o = t.orders.where(F.col("o_orderpriority").isin("5-LOW", "1-URGENT")).select("o_orderkey", "o_orderdate", "o_orderpriority")
    li = t.lineitem.select("l_orderkey", "l_shipdate")
    d = li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_orderpriority").alias("g"), (DT.days_between("l_shipdate", "o_orderdate") > 30).alias("late"))
    return STS.two_proportion_z(d, "g", "late", "5-LOW", "1-URGENT")


@register("st9_weekend_daily_orders", _welch_sql(
    "WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, CASE WHEN isodow(o_orderdate) >= 6 THEN 'weekend' "
    "ELSE 'weekday' END AS kind, CAST(count(*) AS DOUBLE) AS n_orders FROM orders GROUP BY 1, 2),",
    "d", "kind", "n_orders", "weekend", "weekday"))
def st9_weekend_daily_orders(spark, sf):
    """Q47: do weekend days see more orders than weekdays? Welch t on orders
    per calendar day."""
    from gridwork.functions import dates as DT
    o = Tables(spark, sf).orders
    d = o.groupBy(F.to_date("o_orderdate").alias("day"),
                  F.when(DT.is_weekend("o_orderdate"), "weekend").otherwise("weekday").alias("kind")) \
         .agg(F.count(F.lit(1)).cast("double").alias("n_orders"))
    return _welch_out(STS.welch_t(d, "kind", "n_orders", "weekend", "weekday"))


@register("st10_chi_square_nation_brand", f"""
WITH {LINES_CTE}, {CUST_CTE},
c AS (SELECT n_name, p_brand, count(*) AS n FROM lines JOIN orders ON l_orderkey = o_orderkey
      JOIN cust ON o_custkey = c_custkey GROUP BY n_name, p_brand),
r AS (SELECT n_name, sum(n) AS rt FROM c GROUP BY n_name),
t AS (SELECT p_brand, sum(n) AS ct FROM c GROUP BY p_brand),
tot AS (SELECT sum(n) AS total FROM c),
e AS (SELECT n, CAST(rt AS DOUBLE) * ct / (SELECT total FROM tot) AS e FROM c JOIN r USING (n_name) JOIN t USING (p_brand))
SELECT round(sum((n - e) * (n - e) / e) + ((SELECT total FROM tot) - sum(e)), 6) AS chi2,
       CAST(((SELECT count(*) FROM r) - 1) * ((SELECT count(*) FROM t) - 1) AS BIGINT) AS dof,
       count(*) AS observed_cells
FROM e""")
def st10_chi_square_nation_brand(spark, sf):
    """Q49: do sub-categories (brands) sell differently in different states
    (nations)? Chi-square over nation x brand line counts."""
    t = Tables(spark, sf)
    from gridwork.plans.star import order_places
    li = lines_with_profit(t)
    op = order_places(t)
    j = li.join(op, li.l_orderkey == op.o_orderkey)
    counts = j.groupBy("n_name", "p_brand").agg(F.count(F.lit(1)).alias("n"))
    r = STS.chi_square(counts, "n_name", "p_brand", "n")
    return r.select(F.round("chi2", 6).alias("chi2"), "dof", "observed_cells")
