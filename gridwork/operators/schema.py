"""Schema and shape: dtypes, shape, size, select by type, integer narrowing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATING = (T.FloatType, T.DoubleType)
# Signed integer limits of int8/int16/int32 (np.iinfo).
_LIMITS = [("tinyint", -128, 127), ("smallint", -32768, 32767), ("int", -2147483648, 2147483647)]


def dtypes(df: DataFrame) -> list[tuple[str, str]]:
    """``df.dtypes`` (from the schema, no job)."""
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]


def catalogue(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """``df.columns`` and ``df.dtypes`` of many tables as one table: a row per
    column with its place, from the schemas alone (no row is read)."""
    rows = [(name, i, column, kind) for name, df in tables.items() for i, (column, kind) in enumerate(dtypes(df))]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, type string")


def shape(df: DataFrame) -> DataFrame:
    """``df.shape`` as a one-row table (n_rows, n_cols)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).cast("long").alias("n_cols"))


def size(df: DataFrame) -> DataFrame:
    """``df.size``: rows x columns, NULL cells included."""
    return df.agg((F.count(F.lit(1)) * len(df.columns)).alias("n_cells"))


def select_dtypes(df: DataFrame, include: str) -> list[str]:
    """Column names of a kind: 'float', 'integer', 'number', 'string'."""
    kinds = {"float": _FLOATING, "integer": _INTEGRAL, "number": _FLOATING + _INTEGRAL + (T.DecimalType,),
             "string": (T.StringType,)}[include]
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def column_means(df: DataFrame, decimal_scale: int | None = None) -> DataFrame:
    """Mean of every column, one row per column, from a single aggregate.
    With ``decimal_scale`` values are averaged as exact decimals."""
    cols = df.columns
    if decimal_scale is not None:
        aggs = [F.avg(F.col(c).cast(f"decimal(18,{decimal_scale})")).cast("double").alias(c) for c in cols]
    else:
        aggs = [F.avg(c).alias(c) for c in cols]
    wide = df.agg(*aggs)
    pairs = ", ".join(f"'{c}', `{c}`" for c in cols)
    return wide.selectExpr(f"stack({len(cols)}, {pairs}) as (column_name, mean)")


def narrow_integer_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """For each integer column: min, max and the smallest of tinyint /
    smallint / int / bigint that holds both (one aggregate pass)."""
    cols = list(columns or select_dtypes(df, "integer"))
    aggs = []
    for c in cols:
        aggs += [F.min(c).cast("long").alias(f"{c}__min"), F.max(c).cast("long").alias(f"{c}__max")]
    wide = df.agg(*aggs)
    pairs = ", ".join(f"'{c}', `{c}__min`, `{c}__max`" for c in cols)
    long = wide.selectExpr(f"stack({len(cols)}, {pairs}) as (column_name, min_value, max_value)")
    t = F.lit("bigint")
    for name, lo, hi in reversed(_LIMITS):
        t = F.when((F.col("min_value") >= lo) & (F.col("max_value") <= hi), F.lit(name)).otherwise(t)
    return long.withColumn("narrow_type", t)


def narrow(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Cast each integer column to its narrowest type (checked first, so no
    value can overflow)."""
    plan = {r["column_name"]: r["narrow_type"] for r in narrow_integer_types(df, columns).collect()}
    return df.select(*[F.col(c).cast(plan[c]).alias(c) if c in plan else F.col(c) for c in df.columns])
