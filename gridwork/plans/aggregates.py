"""Aggregates, sorting, top-k and ordered windows (inventory A, W).

Floating statistics are rounded to 9 decimals on both sides (the summation
order of a distributed sum is not fixed); money is summed as DECIMAL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwork.functions import arrays as AR
from gridwork.functions import regex as RX
from gridwork.operators import aggregate as AG
from gridwork.operators import order as O
from gridwork.operators.window import lag_in_group
from gridwork.plans.registry import register
from gridwork.plans.sqlkit import avg_dec
from gridwork.plans.star import lines_with_profit, money
from gridwork.sources import Tables


def _r9(c):
    return F.round(c, 9)


@register("a1_describe_quantity", """
SELECT l_returnflag, count(l_quantity) AS n, sum(l_quantity) AS total, avg(l_quantity) AS mean,
       min(l_quantity) AS min, max(l_quantity) AS max, round(stddev_samp(l_quantity), 9) AS std,
       round(stddev_pop(l_quantity), 9) AS std_pop, round(var_samp(l_quantity), 9) AS var
FROM lineitem GROUP BY l_returnflag""")
def a1_describe_quantity(spark, sf):
    """sum, mean, min, max, sample std (pandas), population std (NumPy) and
    variance per group in one hash aggregate."""
    d = AG.describe(Tables(spark, sf).lineitem, "l_quantity", ["l_returnflag"])
    return d.select("l_returnflag", "n", "total", "mean", "min", "max",
                    _r9(F.col("std")).alias("std"), _r9(F.col("std_pop")).alias("std_pop"),
                    _r9(F.col("var")).alias("var"))


@register("a7_quantiles_price", """
SELECT l_returnflag, quantile_cont(l_extendedprice, 0.5) AS median,
       quantile_cont(l_extendedprice, 0.25) AS q25, quantile_cont(l_extendedprice, 0.75) AS q75
FROM lineitem GROUP BY l_returnflag""")
def a7_quantiles_price(spark, sf):
    """``median()`` and ``quantile(0.25/0.75)``, exact with linear
    interpolation, from counts of equal values; no group in one task."""
    li = Tables(spark, sf).lineitem
    return AG.exact_quantiles(li, "l_extendedprice", [0.5, 0.25, 0.75], ["l_returnflag"],
                              names=["median", "q25", "q75"])


@register("a8_quantile_global", """
SELECT quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.9) AS q90 FROM orders""")
def a8_quantile_global(spark, sf):
    """Table-wide exact quantiles (no group key)."""
    return AG.exact_quantiles(Tables(spark, sf).orders, "o_totalprice", [0.5, 0.9], names=["median", "q90"])


@register("a9_argmax_first", """
SELECT o_orderpriority, o_custkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn
  FROM orders) WHERE rn = 1""")
def a9_argmax_first(spark, sf):
    """``labels[np.argmax(values)]`` per group: first row (by o_orderkey) on
    ties, as NumPy does; a partial aggregate of ``max(struct)``."""
    return AG.arg_extreme(Tables(spark, sf).orders, "o_totalprice", "o_custkey", "o_orderkey",
                          largest=True, group_by=["o_orderpriority"])


@register("a9_argmin_first", """
SELECT o_orderpriority, o_custkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS rn
  FROM orders) WHERE rn = 1""")
def a9_argmin_first(spark, sf):
    return AG.arg_extreme(Tables(spark, sf).orders, "o_totalprice", "o_custkey", "o_orderkey",
                          largest=False, group_by=["o_orderpriority"])


@register("a10_distinct_counts", """
SELECT l_returnflag, count(DISTINCT l_partkey) AS n_parts, count(DISTINCT l_suppkey) AS n_suppliers
FROM lineitem GROUP BY l_returnflag""")
def a10_distinct_counts(spark, sf):
    """``nunique()`` per group (NULLs not counted)."""
    li = Tables(spark, sf).lineitem
    return li.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("n_parts"),
                                          F.count_distinct("l_suppkey").alias("n_suppliers"))


@register("a11_unique_values", "SELECT DISTINCT o_orderpriority FROM orders")
def a11_unique_values(spark, sf):
    """``np.unique`` / ``unique()``: the distinct values."""
    return Tables(spark, sf).orders.select("o_orderpriority").distinct()


@register("a12_unique_with_counts", "SELECT p_brand, count(*) AS count FROM part GROUP BY p_brand")
def a12_unique_with_counts(spark, sf):
    """``np.unique(..., return_counts=True)``."""
    return Tables(spark, sf).part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("count"))


@register("a13_value_counts", """
SELECT o_orderpriority, count(*) AS count FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1""")
def a13_value_counts(spark, sf):
    return AG.value_counts(Tables(spark, sf).orders, "o_orderpriority")


@register("a14_value_counts_pct", """
SELECT o_orderpriority, CAST(count(*) AS DOUBLE) * 100.0 / CAST((SELECT count(*) FROM orders) AS DOUBLE) AS percent
FROM orders GROUP BY 1""")
def a14_value_counts_pct(spark, sf):
    """``value_counts(normalize=True) * 100``."""
    return AG.value_counts(Tables(spark, sf).orders, "o_orderpriority", normalize=True)


@register("a15_group_sum_mean_median", f"""
SELECT c_mktsegment, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS total,
       {avg_dec('CAST(c_acctbal AS DECIMAL(18,2))', 2)} AS mean,
       quantile_cont(c_acctbal, 0.5) AS median
FROM customer GROUP BY c_mktsegment""")
def a15_group_sum_mean_median(spark, sf):
    """``groupby(key).sum() / .mean() / .median()``."""
    c = Tables(spark, sf).customer
    sums = c.groupBy("c_mktsegment").agg(F.sum(money("c_acctbal")).cast("double").alias("total"),
                                         F.avg(money("c_acctbal")).cast("double").alias("mean"))
    med = AG.exact_quantiles(c, "c_acctbal", [0.5], ["c_mktsegment"], names=["median"])
    return sums.join(med, "c_mktsegment")


@register("a18_conditional_sum", """
SELECT l_linestatus, CAST(sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) AS returned_qty,
       CAST(count_if(l_returnflag = 'R') AS BIGINT) AS returned_lines
FROM lineitem GROUP BY l_linestatus""")
def a18_conditional_sum(spark, sf):
    """``np.sum(q[flag == 'R'])`` per group as a conditional aggregate."""
    li = Tables(spark, sf).lineitem
    r = F.col("l_returnflag") == "R"
    return li.groupBy("l_linestatus").agg(
        F.sum(F.when(r, F.col("l_quantity"))).cast("double").alias("returned_qty"),
        F.count_if(r).alias("returned_lines"))


@register("a17_group_sum_map", """
SELECT l_returnflag, CAST(sum(l_quantity) AS DOUBLE) AS value FROM lineitem GROUP BY l_returnflag""")
def a17_group_sum_map(spark, sf):
    """``{flag: q[flags == flag].sum() for flag in np.unique(flags)}`` as
    (key, value) rows (one aggregate instead of a scan per key)."""
    return AG.group_sums(Tables(spark, sf).lineitem, "l_returnflag", F.sum("l_quantity"))


@register("a22_occurrence_count", """
SELECT l_returnflag, CAST(count_if(l_quantity = 50) AS BIGINT) AS qty_50_lines FROM lineitem GROUP BY 1""")
def a22_occurrence_count(spark, sf):
    """``list.count(v)`` over a column: ``count_if``."""
    li = Tables(spark, sf).lineitem
    return li.groupBy("l_returnflag").agg(F.count_if(F.col("l_quantity") == 50).alias("qty_50_lines"))


@register("a22_array_count", """
SELECT vec_id, CAST(len(list_filter(embedding, lambda x: floor(256 * CAST(x AS DOUBLE)) = 0)) AS BIGINT) AS zeros FROM embeddings""")
def a22_array_count(spark, sf):
    """``lst.count(v)`` on an array column."""
    e = Tables(spark, sf).embeddings
    whole = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")))
    return e.select("vec_id", AR.count_of(whole, F.lit(0).cast("long")).cast("long").alias("zeros"))


@register("a24_letter_count", r"""
SELECT doc_id, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS letters,
       length(text) - length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS non_letters
FROM documents""")
def a24_letter_count(spark, sf):
    """A counter incremented per character passing a test (``isalpha``),
    as one expression over each whole text."""
    d = Tables(spark, sf).documents
    letters = RX.count_chars("text", r"[\p{L}]")
    return d.select("doc_id", letters.cast("long").alias("letters"),
                    (F.length("text") - letters).cast("long").alias("non_letters"))


# -- W: sort, n-th largest, top-k, lag -------------------------------------

@register("w1_sorted_parts_desc", """
SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey DESC) - 1 AS position, l_partkey AS part FROM lineitem""")
def w1_sorted_parts_desc(spark, sf):
    """``lst.sort(reverse=True)`` of each order's parts, as rows."""
    li = Tables(spark, sf).lineitem.select("l_orderkey", F.col("l_partkey").alias("part"))
    return O.ordinal(li, ["-part"], ["l_orderkey"], name="position", repeated=True).select("l_orderkey", "position", "part")


@register("w3_sorted_parts", """
SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS position FROM part""")
def w3_sorted_parts(spark, sf):
    """``sort_values(by=price)``: every row with its place, ascending."""
    p = Tables(spark, sf).part.select("p_partkey", "p_retailprice")
    return O.ordinal(p, ["p_retailprice", "p_partkey"], name="position").select("p_partkey", "position")


@register("w2_nth_largest", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey OFFSET 2 LIMIT 1""")
def w2_nth_largest(spark, sf):
    """``sort_values(ascending=False).iloc[2]``: the third largest."""
    return O.nth_largest(Tables(spark, sf).orders.select("o_orderkey", "o_totalprice"),
                         "o_totalprice", 2, tie_break=["o_orderkey"])


@register("w4_reverse_parts", """
SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC) - 1 AS position, l_partkey AS part
FROM lineitem""")
def w4_reverse_parts(spark, sf):
    """``lst.reverse()`` of each order's parts in line order, as rows."""
    li = Tables(spark, sf).lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("part"))
    return O.ordinal(li, ["-l_linenumber", "-part"], ["l_orderkey"], name="position").select("l_orderkey", "position", "part")


@register("w5_top_orders", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""")
def w5_top_orders(spark, sf):
    """Top 10 by value with a key tie-break (a per-task top-k, then a merge)."""
    return O.top_k(Tables(spark, sf).orders.select("o_orderkey", "o_custkey", "o_totalprice"),
                   "o_totalprice", 10, tie_break=["o_orderkey"])


@register("w6_lag_previous_order", """
SELECT o_orderkey, o_custkey, strftime(lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), '%Y-%m-%d') AS prev_date
FROM orders""")
def w6_lag_previous_order(spark, sf):
    """Previous order date of the same customer (``lag``), computed on
    range-partitioned chunks so one busy customer does not fill one task."""
    o = Tables(spark, sf).orders.select("o_orderkey", "o_custkey", "o_orderdate")
    lagged = lag_in_group(o, "o_orderdate", ["o_orderdate", "o_orderkey"], ["o_custkey"], name="prev")
    return lagged.select("o_orderkey", "o_custkey", F.date_format("prev", "yyyy-MM-dd").alias("prev_date"))


@register("w2_position_rank", """
SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS position FROM orders""")
def w2_position_rank(spark, sf):
    """Position of every order in descending value order (a whole-table
    ordinal built from per-task counts, not a single-task window)."""
    o = Tables(spark, sf).orders.select("o_orderkey", "o_totalprice")
    return O.ordinal(o, ["-o_totalprice", "o_orderkey"], name="position") \
            .select("o_orderkey", "position")


@register("a19_pivot_mean_profit_by_brand", f"""
SELECT p_brand, {avg_dec('CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) - CAST(l_quantity AS DECIMAL(18,2)) * CAST(p_retailprice AS DECIMAL(18,2))', 4)} AS mean_profit
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand""")
def a19_pivot_mean_profit_by_brand(spark, sf):
    """``pivot_table(values='Profit', index='Sub-Category', aggfunc=np.mean)``
    with brand as the sub-category."""
    li = lines_with_profit(Tables(spark, sf))
    return li.groupBy("p_brand").agg(F.avg("profit").cast("double").alias("mean_profit"))


@register("a21_pivot_grand_total_type", """
WITH l AS (SELECT p_type, CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS sales,
                  CAST(l_quantity AS DECIMAL(18,2)) AS qty
           FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT p_type, CAST(sum(sales) AS DOUBLE) AS sales, CAST(sum(qty) AS DOUBLE) AS quantity FROM l GROUP BY p_type
UNION ALL SELECT 'Grand Total', CAST(sum(sales) AS DOUBLE), CAST(sum(qty) AS DOUBLE) FROM l""")
def a21_pivot_grand_total_type(spark, sf):
    """``pivot_table(values=['Sales', 'Quantity'], index='Category',
    aggfunc='sum', margins=True, margins_name='Grand Total')``: grouping sets
    (type), () with the total row labelled, no sub-totals."""
    li = lines_with_profit(Tables(spark, sf))
    p = AG.pivot_with_total(li, ["p_type"], {"sales": F.sum("sales"), "quantity": F.sum(money("l_quantity"))})
    return p.select("p_type", F.col("sales").cast("double").alias("sales"),
                    F.col("quantity").cast("double").alias("quantity"))


@register("g1_one_hot_segment", """
SELECT c_custkey, CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 1 ELSE 0 END AS seg_AUTOMOBILE,
       CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS seg_BUILDING,
       CASE WHEN c_mktsegment = 'FURNITURE' THEN 1 ELSE 0 END AS seg_FURNITURE,
       CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 1 ELSE 0 END AS seg_HOUSEHOLD,
       CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END AS seg_MACHINERY
FROM customer""")
def g1_one_hot_segment(spark, sf):
    """``pd.get_dummies(df['Segment']) + 0``: categories
    given (they are the result's columns), one 0/1 column each."""
    from gridwork.operators.reshape import one_hot
    c = Tables(spark, sf).customer.select("c_custkey", "c_mktsegment")
    return one_hot(c, "c_mktsegment", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"], prefix="seg")


@register("g4_daily_value_threshold", """
WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
           FROM events GROUP BY 1)
SELECT day, total, total > (SELECT avg(total) FROM d) AS above FROM d""")
def g4_daily_value_threshold(spark, sf):
    """A line series with a threshold flag (the data behind a
    ``fill_between(where=y > t)`` chart): daily event value against the
    average day."""
    from gridwork.operators.reshape import threshold_flags
    ev = Tables(spark, sf).events
    d = ev.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.sum(money("value")).cast("double").alias("total"))
    return threshold_flags(d, "total", d.agg(F.avg("total")).scalar())


_TYPE_BRAND = """l AS (SELECT p_type, p_brand, CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS sales,
       CAST(l_quantity AS DECIMAL(18,2)) * CAST(p_retailprice AS DECIMAL(18,2)) AS cost FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@register("a20_sums_by_type_and_brand", f"""
WITH {_TYPE_BRAND}
SELECT p_type, p_brand, CAST(sum(sales) AS DOUBLE) AS sales, CAST(sum(sales - cost) AS DOUBLE) AS profit FROM l GROUP BY p_type, p_brand""")
def a20_sums_by_type_and_brand(spark, sf):
    """``pivot_table(values=['Sales', 'Profit'], index=['Category',
    'Sub-Category'], aggfunc='sum')``."""
    return lines_with_profit(Tables(spark, sf)).groupBy("p_type", "p_brand").agg(
        F.sum("sales").cast("double").alias("sales"), F.sum("profit").cast("double").alias("profit"))


@register("a21_two_keys_grand_total", f"""
WITH {_TYPE_BRAND}
SELECT p_type, p_brand, CAST(sum(sales) AS DOUBLE) AS sales FROM l GROUP BY p_type, p_brand
UNION ALL SELECT 'Grand Total', NULL, CAST(sum(sales) AS DOUBLE) FROM l""")
def a21_two_keys_grand_total(spark, sf):
    """``pivot_table(index=['Category', 'Sub-Category'], margins=True)``: two
    keys and one grand-total row, no sub-totals."""
    p = AG.pivot_with_total(lines_with_profit(Tables(spark, sf)), ["p_type", "p_brand"], {"sales": F.sum("sales")})
    return p.select("p_type", "p_brand", F.col("sales").cast("double").alias("sales"))


@register("a16_two_key_share", f"""
WITH {_TYPE_BRAND}, g AS (SELECT p_type, p_brand, sum(sales) AS total FROM l GROUP BY p_type, p_brand)
SELECT p_type, p_brand, CAST(total AS DOUBLE) AS total, round(CAST(total AS DOUBLE) * 100.0 / (SELECT CAST(sum(total) AS DOUBLE) FROM g), 9) AS share_pct FROM g""")
def a16_two_key_share(spark, sf):
    """``groupby(['Category', 'Sub-Category']).sum() / sum() * 100``."""
    g = AG.group_share(lines_with_profit(Tables(spark, sf)), ["p_type", "p_brand"], "sales")
    return g.select("p_type", "p_brand", F.col("total").cast("double").alias("total"), F.round("share_pct", 9).alias("share_pct"))


@register("n7_null_group_key", """
WITH e AS (SELECT event_id, ts, value, CASE WHEN event_type <> 'error' THEN event_type END AS kind FROM events),
w AS (SELECT *, lag(value) OVER (PARTITION BY kind ORDER BY ts, event_id) AS prev FROM e),
q AS (SELECT kind, quantile_cont(value, 0.5) AS median FROM e GROUP BY kind)
SELECT event_id, prev, median FROM w JOIN q ON w.kind IS NOT DISTINCT FROM q.kind""")
def n7_null_group_key(spark, sf):
    """Lag and median inside groups one of which has a NULL key."""
    kind = F.when(F.col("event_type") != "error", F.col("event_type"))
    e = Tables(spark, sf).events.select("event_id", "ts", "value", kind.alias("kind"))
    med = AG.exact_quantiles(e, "value", [0.5], ["kind"], names=["median"]).withColumnRenamed("kind", "kind_q")
    lagged = lag_in_group(e, "value", ["ts", "event_id"], ["kind"], name="prev")
    return lagged.join(med, F.col("kind").eqNullSafe(F.col("kind_q"))).select("event_id", "prev", "median")
