"""What counts as missing: NULL, and NaN in floating columns (as in pandas)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def missing(df: DataFrame, c: str) -> Column:
    m = F.col(c).isNull()
    if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
        m = m | F.isnan(c)
    return m
