"""Aggregates: describe, quantiles, value counts, shares, pivots, arg-max.

All of these are one hash aggregate (partial aggregation before the shuffle,
final after); the exact quantiles add running counts over sorted chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwork.operators.missing import missing
from gridwork.operators.order import running_total


def _names(cs) -> list[str]:
    return [cs] if isinstance(cs, str) else list(cs or [])


def describe(df: DataFrame, value: str, group_by: Sequence[str] = ()) -> DataFrame:
    """count, sum, mean, min, max, sample std (pandas ``std``), population std
    (NumPy ``std``) and sample variance of ``value`` per group, in one pass."""
    v = F.col(value)
    aggs = [
        F.count(v).alias("n"),
        F.sum(v).alias("total"),
        F.avg(v).alias("mean"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.stddev_samp(v).alias("std"),
        F.stddev_pop(v).alias("std_pop"),
        F.var_samp(v).alias("var"),
    ]
    g = _names(group_by)
    return df.groupBy(*g).agg(*aggs) if g else df.agg(*aggs)


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float],
                    group_by: Sequence[str] = (), names: Sequence[str] | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation (pandas ``quantile`` /
    ``median``; NULL and NaN skipped), one row per group, NULL groups included.

    Rows are first reduced to (group, value, count) by a map-side aggregate,
    so a value holding half the rows is one row; running counts over chunks
    (``order.running_total``) then give each value's range of ranks. One
    method at every size, no group is gathered in a task."""
    g = _names(group_by)
    names = list(names or ["q" + format(p * 100, "g").replace(".", "_") for p in probs])
    values = df.where(~missing(df, value)).groupBy(*g, F.col(value).alias("_gw_v")).agg(F.count(F.lit(1)).alias("_gw_c"))
    ranged = running_total(values, F.col("_gw_c"), ["_gw_v"], g, name="_gw_b")
    totals = values.groupBy(*g).agg(F.sum("_gw_c").alias("_gw_n"))
    if g:
        totals = totals.select(*[F.col(c).alias(f"_gw_g_{c}") for c in g], "_gw_n")
        same = [F.col(c).eqNullSafe(F.col(f"_gw_g_{c}")) for c in g]
        ranged = ranged.join(totals, same)
    else:
        ranged = ranged.withColumn("_gw_n", totals.scalar())
    aggs, outs, needed = [], [], F.lit(False)
    for p, nm in zip(probs, names):
        h = (F.col("_gw_n") - 1) * F.lit(float(p))

        def holds(rank):
            return (F.col("_gw_b") <= rank) & (rank < F.col("_gw_b") + F.col("_gw_c"))
        lo, hi = holds(F.floor(h)), holds(F.ceil(h))
        needed = needed | lo | hi
        aggs += [F.max(F.when(lo, F.col("_gw_v"))).alias(f"_lo_{nm}"), F.max(F.when(hi, F.col("_gw_v"))).alias(f"_hi_{nm}"),
                 F.max(h - F.floor(h)).alias(f"_fr_{nm}")]
        outs.append((F.col(f"_lo_{nm}") + (F.col(f"_hi_{nm}") - F.col(f"_lo_{nm}")) * F.col(f"_fr_{nm}")).cast("double").alias(nm))
    kept = ranged.where(needed)
    agg = kept.groupBy(*g).agg(*aggs) if g else kept.agg(*aggs)
    return agg.select(*g, *outs)


def value_counts(df: DataFrame, column: str, normalize: bool = False,
                 name: str | None = None) -> DataFrame:
    """``value_counts()``: NULLs dropped, most frequent first (ties by value).
    ``normalize`` gives the share in percent of the non-NULL rows; the total is
    scalar subquery counting the present values, not a global window."""
    present = df.where(F.col(column).isNotNull())
    counts = present.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    if normalize:
        # A scan-only count of the column (no shuffle), as a scalar subquery.
        total = present.agg(F.count(F.lit(1))).scalar()
        counts = counts.select(column, (F.col("count") * F.lit(100.0) / total).alias(name or "percent"))
        return counts.orderBy(F.col(name or "percent").desc(), F.col(column))
    return counts.orderBy(F.col("count").desc(), F.col(column))


def group_share(df: DataFrame, keys: Sequence[str], value: Column | str, name: str = "share_pct",
                total_name: str = "total") -> DataFrame:
    """``df.groupby(keys)[value].sum() / df[value].sum() * 100``.

    The grand total is the sum of the group sums, taken as a scalar subquery
    of the grouped result (no window over the whole table)."""
    v = F.col(value) if isinstance(value, str) else value
    grouped = df.groupBy(*keys).agg(F.sum(v).alias(total_name))
    grand = grouped.agg(F.sum(total_name)).scalar()
    return grouped.withColumn(
        name, F.col(total_name).cast("double") * F.lit(100.0) / grand.cast("double"))


def pivot_with_total(df: DataFrame, index: Sequence[str], aggs: dict[str, Column],
                     margins_name: str = "Grand Total") -> DataFrame:
    """``pivot_table(..., index=index, margins=True, margins_name=...)``: the
    group rows plus one grand-total row, and no sub-totals (so grouping sets
    ``(index), ()``, not ``rollup``). Index columns of the total row hold
    ``margins_name`` in the first and NULL in the others."""
    idx = list(index)
    grouped = df.groupingSets([idx, []], *idx).agg(
        *[c.alias(k) for k, c in aggs.items()], F.grouping_id().alias("_gw_gid"))
    first, *rest = idx
    labelled = grouped.select(
        F.when(F.col("_gw_gid") == 0, F.col(first).cast("string")).otherwise(F.lit(margins_name)).alias(first),
        *[F.col(c) for c in rest], *aggs.keys())
    return labelled


def arg_extreme(df: DataFrame, value: str, label: str, order_key: str,
                largest: bool = True, group_by: Sequence[str] = ()) -> DataFrame:
    """Label of the row with the largest (or smallest) ``value``; on ties the
    first row in ``order_key`` order wins, as in ``np.argmax``/``np.argmin``.
    ``max(struct(value, -order, label))`` is an ordinary partial aggregate."""
    g = _names(group_by)
    if largest:
        e = F.max(F.struct(F.col(value).alias("v"), (-F.col(order_key)).alias("o"), F.col(label).alias("l")))
    else:
        e = F.min(F.struct(F.col(value).alias("v"), F.col(order_key).alias("o"), F.col(label).alias("l")))
    e = e.alias("_gw_best")
    agg = df.where(F.col(value).isNotNull())
    agg = agg.groupBy(*g).agg(e) if g else agg.agg(e)
    return agg.select(*g, F.col("_gw_best.l").alias(label), F.col("_gw_best.v").alias(value))


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``df.isna().sum()`` plus the column type, one row per column, computed in
    a single aggregate (NaN counts as missing, as in pandas)."""
    cols = list(columns or df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}

    wide = df.agg(*[F.count_if(missing(df, c)).alias(c) for c in cols])
    pairs = ", ".join(f"'{c}', '{types[c].simpleString()}', `{c}`" for c in cols)
    return wide.selectExpr(f"stack({len(cols)}, {pairs}) as (column_name, dtype, null_count)")


def group_sums(df: DataFrame, key: str, value: Column, name: str = "value") -> DataFrame:
    """``{k: sum(v[keys == k]) for k in unique(keys)}`` as (key, value) rows:
    one aggregate replaces the per-key scans of the lesson."""
    return df.groupBy(key).agg(value.alias(name))
