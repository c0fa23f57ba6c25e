"""Set operations (inventory U) as table operations and as array functions.

Tables: the customers who ordered in 1996 (A) against those who ordered in
1997 (B). Arrays: per order, the suppliers of lines 1-3 (x) against those of
lines 2 and up (y), which overlap in some orders and not in others.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwork.functions import arrays as AR
from gridwork.operators import sets as ST
from gridwork.plans.registry import register
from gridwork.sources import Tables

_A = "(SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1996)"
_B = "(SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1997)"


def _year_customers(spark, sf, year):
    o = Tables(spark, sf).orders
    return o.where((F.col("o_orderdate") >= F.lit(f"{year}-01-01").cast("timestamp_ntz"))
                   & (F.col("o_orderdate") < F.lit(f"{year + 1}-01-01").cast("timestamp_ntz"))) \
            .select("o_custkey").distinct()


@register("u1_set_union", f"SELECT o_custkey FROM {_A} UNION SELECT o_custkey FROM {_B}")
def u1_set_union(spark, sf):
    return ST.union(_year_customers(spark, sf, 1996), _year_customers(spark, sf, 1997))


@register("u2_set_intersection", f"SELECT o_custkey FROM {_A} INTERSECT SELECT o_custkey FROM {_B}")
def u2_set_intersection(spark, sf):
    return ST.intersection(_year_customers(spark, sf, 1996), _year_customers(spark, sf, 1997))


@register("u3_set_difference", f"SELECT o_custkey FROM {_A} EXCEPT SELECT o_custkey FROM {_B}")
def u3_set_difference(spark, sf):
    return ST.difference(_year_customers(spark, sf, 1996), _year_customers(spark, sf, 1997))


@register("u4_set_symmetric_difference", f"""
(SELECT o_custkey FROM {_A} EXCEPT SELECT o_custkey FROM {_B})
UNION (SELECT o_custkey FROM {_B} EXCEPT SELECT o_custkey FROM {_A})""")
def u4_set_symmetric_difference(spark, sf):
    return ST.symmetric_difference(_year_customers(spark, sf, 1996), _year_customers(spark, sf, 1997))


@register("u5_set_relations", f"""
SELECT NOT EXISTS (SELECT o_custkey FROM {_A} EXCEPT SELECT o_custkey FROM {_B}) AS is_subset,
       NOT EXISTS (SELECT o_custkey FROM {_B} EXCEPT SELECT o_custkey FROM {_A}) AS is_superset,
       NOT EXISTS (SELECT o_custkey FROM {_A} INTERSECT SELECT o_custkey FROM {_B}) AS is_disjoint""")
def u5_set_relations(spark, sf):
    """``issubset``, ``issuperset``, ``isdisjoint`` of A and B."""
    return ST.relations(_year_customers(spark, sf, 1996), _year_customers(spark, sf, 1997))


@register("u10_extend_bag", f"""
SELECT o_custkey, count(*) AS copies FROM (
  SELECT o_custkey FROM {_A} UNION ALL SELECT o_custkey FROM {_B}) GROUP BY o_custkey""")
def u10_extend_bag(spark, sf):
    """``a.extend(b)`` keeps duplicates: each key with its number of copies."""
    bag = ST.extend(_year_customers(spark, sf, 1996), _year_customers(spark, sf, 1997))
    return bag.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("copies"))


_XY = """(SELECT vec_id, list_distinct(list_transform(embedding[1:40], lambda v: CAST(floor(256 * CAST(v AS DOUBLE)) AS BIGINT))) AS x,
  list_distinct(list_transform(embedding[21:64], lambda v: CAST(floor(256 * CAST(v AS DOUBLE)) AS BIGINT))) AS y FROM embeddings)"""


def _text(items):
    return f"array_to_string(list_sort({items}), ',')"


@register("u_array_set_ops", f"""
SELECT vec_id, {_text('list_distinct(list_concat(x, y))')} AS set_union,
       {_text('list_filter(x, lambda v: list_contains(y, v))')} AS set_intersection,
       {_text('list_filter(x, lambda v: NOT list_contains(y, v))')} AS set_difference,
       {_text('list_concat(list_filter(x, lambda v: NOT list_contains(y, v)), list_filter(y, lambda v: NOT list_contains(x, v)))')} AS set_symmetric_difference,
       len(list_filter(x, lambda v: NOT list_contains(y, v))) = 0 AS x_subset_of_y,
       len(list_filter(x, lambda v: list_contains(y, v))) = 0 AS disjoint,
       {_text('list_distinct(list_append(x, -1000))')} AS x_add,
       {_text('list_filter(x, lambda v: v <> 0)')} AS x_discard
FROM {_XY}""")
def u_array_set_ops(spark, sf):
    """Python set methods on array columns: ``union``, ``intersection``,
    ``difference``, ``symmetric_difference``, ``issubset``, ``isdisjoint``,
    ``add`` and ``discard``, on two overlapping stretches of each vector."""
    whole = F.transform("embedding", lambda v: F.floor(256 * v.cast("double")))
    e = Tables(spark, sf).embeddings.select("vec_id", whole.alias("w"))
    per = e.select("vec_id", F.array_distinct(F.slice("w", 1, 40)).alias("x"), F.array_distinct(F.slice("w", 21, 44)).alias("y"))

    def text(a):
        return F.array_join(F.sort_array(a).cast("array<string>"), ",")

    x, y = F.col("x"), F.col("y")
    return per.select(
        "vec_id",
        text(F.array_union(x, y)).alias("set_union"),
        text(F.array_intersect(x, y)).alias("set_intersection"),
        text(F.array_except(x, y)).alias("set_difference"),
        text(AR.symmetric_difference(x, y)).alias("set_symmetric_difference"),
        AR.is_subset(x, y).alias("x_subset_of_y"),
        AR.is_disjoint(x, y).alias("disjoint"),
        text(AR.add_item(x, F.lit(-1000).cast("long"))).alias("x_add"),
        text(F.array_remove(x, F.lit(0).cast("long"))).alias("x_discard"))


@register("u_order_supplier_flags", """
SELECT l_orderkey, l_suppkey, bool_or(l_linenumber <= 3) AS in_x, bool_or(l_linenumber >= 2) AS in_y FROM lineitem GROUP BY l_orderkey, l_suppkey""")
def u_order_supplier_flags(spark, sf):
    """Two supplier sets of each order as rows with membership flags, so an
    order of any size is never gathered."""
    return Tables(spark, sf).lineitem.groupBy("l_orderkey", "l_suppkey").agg(
        F.bool_or(F.col("l_linenumber") <= 3).alias("in_x"), F.bool_or(F.col("l_linenumber") >= 2).alias("in_y"))
