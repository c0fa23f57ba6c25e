"""Set algebra on tables (the array-column versions are in
``functions.arrays``).

Every result is distinct, as a Python set is. Set relations (subset,
superset, disjoint) are answered by an anti/semi join that only has to find
whether a row exists, returned as one-row tables built from scalar
subqueries, so nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """``a | b``."""
    return a.unionByName(b).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """``a & b``."""
    return a.intersect(b)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """``a - b``."""
    return a.subtract(b)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """``a ^ b``: in exactly one side. One shuffle: tag each distinct row with
    its side and keep the rows seen on one side only."""
    cols = a.columns
    tagged = a.distinct().withColumn("_gw_s", F.lit(1)).unionByName(
        b.select(*cols).distinct().withColumn("_gw_s", F.lit(2)))
    return tagged.groupBy(*cols).agg(F.count(F.lit(1)).alias("_gw_n")).where("_gw_n = 1").select(*cols)


def extend(a: DataFrame, b: DataFrame) -> DataFrame:
    """``list.extend``: a bag union, duplicates kept."""
    return a.unionByName(b)


def relations(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: ``a <= b``, ``a >= b``, ``a.isdisjoint(b)``."""
    cols = a.columns
    cond = [a[c].eqNullSafe(b[c]) for c in cols]
    a_not_in_b = a.join(b, cond, "left_anti").limit(1).agg(F.count(F.lit(1)).alias("n")).scalar()
    cond_b = [b[c].eqNullSafe(a[c]) for c in cols]
    b_not_in_a = b.join(a, cond_b, "left_anti").limit(1).agg(F.count(F.lit(1)).alias("n")).scalar()
    shared = a.join(b, cond, "left_semi").limit(1).agg(F.count(F.lit(1)).alias("n")).scalar()
    return a.sparkSession.range(1).select(
        (a_not_in_b == 0).alias("is_subset"), (b_not_in_a == 0).alias("is_superset"),
        (shared == 0).alias("is_disjoint"))
