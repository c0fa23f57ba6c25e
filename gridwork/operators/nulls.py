"""Missing values: fill with the mean, forward/backward fill, drop rows.

Missing means NULL (and NaN in floating columns, as in pandas; see
``sources.normalize_nan``). Means come from one aggregate over all the
columns, attached as scalar subqueries (one row, so nothing grows).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwork.operators.missing import missing
from gridwork.operators.window import forward_fill


def fill_mean(df: DataFrame, columns: Sequence[str] | None = None, decimal_scale: int | None = None) -> DataFrame:
    """``df[c].fillna(df[c].mean())`` for each of ``columns`` (default: every
    numeric column), with the means from a single aggregate. With
    ``decimal_scale`` the mean is taken over exact decimals."""
    num = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
    cols = list(columns or [f.name for f in df.schema.fields if isinstance(f.dataType, num)])

    def val(c):
        v = F.when(~missing(df, c), F.col(c))
        return v.cast(f"decimal(18,{decimal_scale})") if decimal_scale is not None else v

    means = df.agg(*[F.avg(val(c)).cast("double").alias(c) for c in cols])
    # One scalar subquery holding every mean (identical subqueries are reused,
    # so the aggregate runs once).
    packed = means.select(F.struct(*cols).alias("m")).scalar()
    fills = {c: packed.getField(c) for c in cols}
    return df.select(*[F.when(missing(df, c), fills[c]).otherwise(F.col(c)).alias(c) if c in fills else F.col(c)
                       for c in df.columns])


def ffill(df: DataFrame, columns: Sequence[str], order_by, partition_by=()) -> DataFrame:
    """``ffill()`` inside each ``partition_by`` group in ``order_by`` order."""
    return forward_fill(df, columns, order_by, partition_by)


def bfill(df: DataFrame, columns: Sequence[str], order_by, partition_by=()) -> DataFrame:
    """``bfill()``: the next non-missing value in ``order_by`` order."""
    return forward_fill(df, columns, order_by, partition_by, backward=True)


def dropna(df: DataFrame, how: str = "any", subset: Sequence[str] | None = None) -> DataFrame:
    """``dropna(how='any'|'all')``; NaN counts as missing (Spark ``na.drop``
    does the same)."""
    return df.na.drop(how=how, subset=list(subset) if subset else None)
