"""Ordered scans inside key groups (fill, lag) that stay spread out when one
key holds a large share of the rows.

Rows are cut into chunks in (key, order) order (``order.sorted_chunks``); each
chunk is scanned on its own, and the value that crosses a chunk border comes
from at most two rows a chunk. NULL keys are a group like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwork.operators.missing import missing
from gridwork.operators.order import _PID, carried, chunk_window, names_of, reversed_order, sorted_chunks, with_carry


def forward_fill(df: DataFrame, columns: Sequence[str], order_by, partition_by=(),
                 backward: bool = False, n_chunks: int | None = None) -> DataFrame:
    """``ffill()`` (or ``bfill()`` with ``backward=True``) of ``columns`` in
    ``order_by`` order inside each ``partition_by`` group. NULL and NaN are
    filled; leading (trailing) gaps with nothing before (after) them stay.

    ``order_by`` must be a total order inside a group for a unique answer.
    """
    keys = names_of(partition_by)
    order = reversed_order(order_by) if backward else names_of(order_by)
    tagged = sorted_chunks(df, order, keys, n_chunks)
    w = chunk_window(order, keys)
    there = {c: F.when(~missing(df, c), F.col(c)) for c in columns}
    inside = tagged.select("*", F.row_number().over(w).alias("_gw_rn"),
                           *[F.last(there[c], ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(f"_gw_in_{c}") for c in columns])
    last = F.struct(*[F.max_by(F.col(c), F.when(there[c].isNotNull(), F.col("_gw_rn"))).alias(c) for c in columns])
    per_chunk = inside.groupBy(_PID, *keys).agg(last.alias("_gw_v"))
    carry = carried(per_chunk, F.col("_gw_v"), keys, lambda v, g: F.struct(
        *[F.last(v[c], ignorenulls=True).over(g.rowsBetween(Window.unboundedPreceding, -1)).alias(c) for c in columns]))
    out = with_carry(inside, carry, keys)
    filled = [F.coalesce(there[c], F.col(f"_gw_in_{c}"), F.col("_gw_carry")[c], F.col(c)).alias(c) for c in columns]
    return out.select(*[c for c in df.columns if c not in columns], *filled).select(*df.columns)


def lag_in_group(df: DataFrame, value: str, order_by, partition_by=(), name: str | None = None,
                 n_chunks: int | None = None) -> DataFrame:
    """``lag(value, 1)`` in ``order_by`` order inside each ``partition_by``
    group (NULL for a group's first row)."""
    keys = names_of(partition_by)
    name = name or f"prev_{value}"
    w = chunk_window(order_by, keys)
    inside = sorted_chunks(df, order_by, keys, n_chunks).select(
        "*", F.lag(value).over(w).alias("_gw_lag"), F.row_number().over(w).alias("_gw_rn"))
    per_chunk = inside.groupBy(_PID, *keys).agg(F.max_by(F.col(value), "_gw_rn").alias("_gw_v"))
    carry = carried(per_chunk, F.col("_gw_v"), keys, lambda v, g: F.lag(v).over(g))
    out = with_carry(inside, carry, keys)
    return out.withColumn(name, F.when(F.col("_gw_rn") == 1, F.col("_gw_carry")).otherwise(F.col("_gw_lag"))).select(*df.columns, name)
