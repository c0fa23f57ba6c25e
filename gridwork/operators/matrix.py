"""Matrix reductions on row arrays ``(row_id, array<number>)``.

Row-wise reductions (axis=1) are per-row expressions with no shuffle;
column-wise ones (axis=0) explode to (position, value) and group by position,
which is a partial aggregate (one row per position per task before the
shuffle), so a tall matrix never gathers in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwork.operators import order


def as_double(arr) -> Column:
    a = F.col(arr) if isinstance(arr, str) else arr
    return a.cast("array<double>")


def row_sums(arr) -> Column:
    """``sum(axis=1)``."""
    return F.aggregate(as_double(arr), F.lit(0.0), lambda acc, x: acc + x)


def row_argmax(arr) -> Column:
    """``argmax(axis=1)``: 0-based, first position on ties."""
    a = F.col(arr) if isinstance(arr, str) else arr
    return (F.array_position(a, F.array_max(a)) - 1).cast("long")


def row_argmin(arr) -> Column:
    a = F.col(arr) if isinstance(arr, str) else arr
    return (F.array_position(a, F.array_min(a)) - 1).cast("long")


def cells(df: DataFrame, row_id: str, arr: str) -> DataFrame:
    """Long form (row_id, col_id, value)."""
    return df.select(row_id, F.posexplode(as_double(arr)).alias("col_id", "value")) \
             .withColumn("col_id", F.col("col_id").cast("long"))


def transpose_long(df: DataFrame, row_id: str, arr: str) -> DataFrame:
    """``data.T`` in long form: (row_id = old column, col_id = old row)."""
    c = cells(df, row_id, arr)
    return c.select(F.col("col_id").alias("row_id"), F.col(row_id).alias("col_id"), "value")


def column_reduce(df: DataFrame, arr: str, how: str | tuple = "sum") -> DataFrame:
    """``sum/max/min/mean(axis=0)``: one row per column position; several
    reductions (``how=("sum", "max")``) share one explode and one aggregate."""
    fns = {"sum": F.sum, "max": F.max, "min": F.min, "mean": F.avg}
    hows = [how] if isinstance(how, str) else list(how)
    e = df.select(F.posexplode(as_double(arr)).alias("col_id", "value"))
    return e.groupBy(F.col("col_id").cast("long").alias("col_id")).agg(
        *[fns[h]("value").alias(f"col_{h}") for h in hows])


def total_reduce(df: DataFrame, arr: str) -> DataFrame:
    """``data.sum()``, ``data.max()``, ``data.min()`` over all cells: per-row
    reductions first, then one small aggregate."""
    a = as_double(arr)
    per_row = df.select(row_sums(a).alias("s"), F.array_max(a).alias("mx"), F.array_min(a).alias("mn"))
    return per_row.agg(F.sum("s").alias("total"), F.max("mx").alias("max"), F.min("mn").alias("min"))


def flat_argmax(df: DataFrame, row_id: str, arr: str, width: int | None = None, largest: bool = True) -> DataFrame:
    """``data.argmax()`` on the row-major flattening: ``row * width + col``,
    first on ties. Per-row best first, then one struct max."""
    a = F.col(arr)
    pos = row_argmax(a) if largest else row_argmin(a)
    best = F.array_max(a) if largest else F.array_min(a)
    w = F.size(a) if width is None else F.lit(width)
    per_row = df.select(best.cast("double").alias("v"), (F.col(row_id) * w + pos).alias("flat"))
    if largest:
        agg = per_row.agg(F.max(F.struct(F.col("v"), (-F.col("flat")).alias("nf"))).alias("b"))
        return agg.select((-F.col("b.nf")).alias("flat_index"), F.col("b.v").alias("value"))
    agg = per_row.agg(F.min(F.struct(F.col("v"), F.col("flat"))).alias("b"))
    return agg.select(F.col("b.flat").alias("flat_index"), F.col("b.v").alias("value"))


def elementwise(arr, fn) -> Column:
    """``f(data)`` element by element (``data * 2``, ``data ** 2``, ...)."""
    return F.transform(as_double(arr), fn)


def _bound(b: int | None, n: Column, default: Column) -> Column:
    """A slice bound as a place from 0 to n: negative ones count from the end,
    all clip."""
    if b is None:
        return default
    return F.greatest(n + b, F.lit(0)) if b < 0 else F.least(F.lit(b), n)


def slices_long(df: DataFrame, order_by, arr: str, slices: dict[str, tuple[slice | int, slice | int]]) -> DataFrame:
    """``data[rows, columns]`` for each named pair, in long form (name, row,
    col, value) with the places in the whole matrix. A row's place comes from
    one distributed ordinal under ``order_by``; the columns are cut out of the
    row before it is taken apart. A pair is of slices (step 1) or single places;
    bounds beyond the end clip, an empty range gives no rows, a single place
    beyond the end none either."""
    n_rows = df.agg(F.count(F.lit(1))).scalar()
    placed = order.ordinal(df, order_by, name="_gw_row").withColumn("_gw_rows", n_rows)
    width, rows, wanted = F.size(arr).cast("long"), F.col("_gw_rows"), []
    for name, pair in slices.items():
        bounds = []
        for part, n in zip(pair, (rows, width), strict=True):
            if not isinstance(part, slice):
                part = slice(part, part + 1 if part != -1 else None)
            if part.step not in (None, 1):
                raise ValueError("steps other than 1 are not supported")
            bounds += [_bound(part.start, n, F.lit(0).cast("long")).cast("long"), _bound(part.stop, n, n).cast("long")]
        wanted.append(F.struct(F.lit(name).alias("name"), *[b.alias(k) for b, k in zip(bounds, ("r0", "r1", "c0", "c1"), strict=True)]))
    held = placed.select("_gw_row", F.col(arr).alias("_gw_e"), F.filter(F.array(*wanted), lambda w: (w["r0"] <= F.col("_gw_row")) & (F.col("_gw_row") < w["r1"])).alias("_gw_w"))
    each = held.select("_gw_row", "_gw_e", F.inline("_gw_w")).where("c0 < c1")
    cut = F.slice("_gw_e", (F.col("c0") + 1).cast("int"), (F.col("c1") - F.col("c0")).cast("int"))
    return each.select("name", F.col("_gw_row").alias("row"), "c0", F.posexplode(cut).alias("at", "value")) \
               .select("name", "row", (F.col("c0") + F.col("at")).alias("col"), "value")
