"""Matrix reductions (inventory X) on ``embeddings``: 64-wide float rows.

Row-wise work is a per-row expression; column-wise work explodes to
(position, value) and is partially aggregated per task before the shuffle.
Sums of floats depend on the order of addition, so they are rounded to 6
decimals on both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwork.operators import matrix as MX
from gridwork.plans.registry import register
from gridwork.sources import Tables

_E = "(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


def _emb(spark, sf):
    return Tables(spark, sf).embeddings.select("vec_id", MX.as_double("embedding").alias("e"))


@register("x1_total_reduce", f"""
SELECT round(sum(list_sum(e)), 6) AS total, max(list_max(e)) AS max, min(list_min(e)) AS min FROM {_E}""")
def x1_total_reduce(spark, sf):
    """``data.sum()``, ``data.max()``, ``data.min()``."""
    t = MX.total_reduce(_emb(spark, sf), "e")
    return t.select(F.round("total", 6).alias("total"), "max", "min")


@register("x2_column_reduce", f"""
SELECT CAST(i - 1 AS BIGINT) AS col_id, round(sum(e[i]), 6) AS col_sum, max(e[i]) AS col_max
FROM {_E}, range(1, 65) r(i) GROUP BY i""")
def x2_column_reduce(spark, sf):
    """``sum(axis=0)`` and ``max(axis=0)``."""
    r = MX.column_reduce(_emb(spark, sf), "e", ("sum", "max"))
    return r.select("col_id", F.round("col_sum", 6).alias("col_sum"), "col_max")


@register("x3_row_reduce", f"""
SELECT vec_id, round(list_sum(e), 6) AS row_sum, CAST(list_position(e, list_max(e)) - 1 AS BIGINT) AS row_argmax,
       CAST(list_position(e, list_min(e)) - 1 AS BIGINT) AS row_argmin
FROM {_E}""")
def x3_row_reduce(spark, sf):
    """``sum(axis=1)``, ``argmax(axis=1)``, ``argmin(axis=1)`` (first on
    ties): per-row expressions, no shuffle."""
    e = _emb(spark, sf)
    return e.select("vec_id", F.round(MX.row_sums("e"), 6).alias("row_sum"),
                    MX.row_argmax("e").alias("row_argmax"), MX.row_argmin("e").alias("row_argmin"))


@register("x5_flat_argmax", f"""
SELECT (SELECT vec_id * 64 + list_position(e, list_max(e)) - 1 FROM {_E}
        ORDER BY list_max(e) DESC, vec_id LIMIT 1) AS flat_argmax,
       (SELECT vec_id * 64 + list_position(e, list_min(e)) - 1 FROM {_E}
        ORDER BY list_min(e), vec_id LIMIT 1) AS flat_argmin""")
def x5_flat_argmax(spark, sf):
    """``data.argmax()`` / ``data.argmin()`` on the row-major flattening."""
    e = _emb(spark, sf)
    mx = MX.flat_argmax(e, "vec_id", "e", 64, largest=True).select(F.col("flat_index").alias("flat_argmax"))
    mn = MX.flat_argmax(e, "vec_id", "e", 64, largest=False).select(F.col("flat_index").alias("flat_argmin"))
    return mx.select("flat_argmax", mn.select("flat_argmin").scalar().alias("flat_argmin"))


@register("x6_sum_of_row_max", f"SELECT round(sum(list_max(e)), 6) AS sum_row_max FROM {_E}")
def x6_sum_of_row_max(spark, sf):
    """``data.max(axis=1).sum()``."""
    return _emb(spark, sf).agg(F.round(F.sum(F.array_max("e")), 6).alias("sum_row_max"))


@register("x7_partial_column_sums", f"""
SELECT CAST(i - 1 AS BIGINT) AS col_id, round(sum(e[i]), 6) AS col_sum
FROM {_E}, range(1, 8) r(i) GROUP BY i""")
def x7_partial_column_sums(spark, sf):
    """``data.sum(axis=0)[:7]``: column sums of the first seven columns
    (the slice is taken per row before the explode)."""
    e = _emb(spark, sf).select(F.slice("e", 1, 7).alias("e"))
    s = MX.column_reduce(e, "e", "sum")
    return s.select("col_id", F.round("col_sum", 6).alias("col_sum"))


@register("x8_elementwise", f"""
SELECT vec_id, round(list_sum([x * 2 for x in e]), 6) AS sum_times_2,
       round(list_sum([pow(x, 2) for x in e]), 6) AS sum_squares,
       round(list_sum([x / 2 for x in e]), 6) AS sum_halves,
       CAST(list_sum([floor(x / 0.5) for x in e]) AS BIGINT) AS sum_floor_div,
       round(list_sum([exp(x) for x in e]), 6) AS sum_exp
FROM {_E}""")
def x8_elementwise(spark, sf):
    """``data * 2``, ``data ** 2``, ``data / 2``, ``data // 0.5``,
    ``np.exp(data)``, each reduced per row."""
    e = _emb(spark, sf)

    def rsum(a):
        return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)

    return e.select(
        "vec_id", F.round(rsum(MX.elementwise("e", lambda x: x * 2)), 6).alias("sum_times_2"),
        F.round(rsum(MX.elementwise("e", lambda x: F.pow(x, 2))), 6).alias("sum_squares"),
        F.round(rsum(MX.elementwise("e", lambda x: x / 2)), 6).alias("sum_halves"),
        F.aggregate(F.transform("e", lambda x: F.floor(x / 0.5)), F.lit(0).cast("long"),
                    lambda acc, x: acc + x).alias("sum_floor_div"),
        F.round(rsum(MX.elementwise("e", F.exp)), 6).alias("sum_exp"))


_SLICES = {"rows_0_3_cols_4_5": (slice(0, 3), slice(4, 5)), "row_0": (0, slice(None)), "beyond": (slice(3, 5), slice(60, 100)),
           "last_two": (slice(-2, None), slice(-3, None)), "empty": (slice(-1, -2), slice(-2, -3)), "column_7": (slice(None), 7)}


@register("f14_matrix_slice", f"""
WITH m AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, count(*) OVER () AS n, len(e) AS w, e FROM {_E}),
s AS (SELECT 'rows_0_3_cols_4_5' AS name, row, e, 4 AS c0, 5 AS c1 FROM m WHERE row < 3
  UNION ALL SELECT 'row_0', row, e, 0, w FROM m WHERE row = 0
  UNION ALL SELECT 'beyond', row, e, 60, least(w, 100) FROM m WHERE row IN (3, 4)
  UNION ALL SELECT 'last_two', row, e, greatest(w - 3, 0), w FROM m WHERE row >= n - 2
  UNION ALL SELECT 'column_7', row, e, 7, 8 FROM m)
SELECT name, row, CAST(col AS BIGINT) AS col, e[col + 1] AS value FROM (SELECT name, row, e, unnest(range(c0, c1)) AS col FROM s)""")
def f14_matrix_slice(spark, sf):
    """``data[0:3, 4:5]``, ``data[0, :]``, a slice beyond the last column, the
    last rows and columns by negative bounds, an empty one, and a column."""
    return MX.slices_long(_emb(spark, sf), ["vec_id"], "e", _SLICES)
