"""Reshaping: one-hot columns and chart-ready series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_hot(df: DataFrame, column: str, categories: Sequence, prefix: str | None = None, keep: bool = False) -> DataFrame:
    """``pd.get_dummies(df[column]) + 0``: one 0/1 column per category, named
    ``{prefix}_{value}``; a NULL row is all zeros. The categories are the
    result's columns, so the caller names them."""
    prefix = prefix or column
    rest = [c for c in df.columns if keep or c != column]
    return df.select(*rest, *[F.coalesce(F.col(column) == F.lit(v), F.lit(False)).cast("int").alias(f"{prefix}_{v}") for v in categories])


def threshold_flags(series: DataFrame, value: str, threshold, name: str = "above") -> DataFrame:
    """The data side of ``fill_between(where=y > t)``: the series with a flag
    per point."""
    t = threshold if not isinstance(threshold, (int, float)) else F.lit(threshold)
    return series.withColumn(name, F.col(value) > t)
