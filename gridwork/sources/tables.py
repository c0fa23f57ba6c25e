"""Readers.

Every reader states its schema; nothing is inferred from data. Parquet scans
are left lazy so Catalyst prunes columns and pushes filters into the scan.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLE_NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy parquet scan of one driver table (``{sf_dir}/{name}.parquet``)."""
    if name not in TABLE_NAMES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Tables:
    """Attribute access to the driver tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLE_NAMES:
            return read_table(self.spark, self.sf_dir, name)
        raise AttributeError(name)


# Both ends agree on these: fields in quotes may hold quotes (doubled), line
# breaks and outer blanks; NULL and the empty text differ.
CSV_OPTIONS = {"quote": '"', "escape": '"', "multiLine": "true", "nullValue": "\\N", "emptyValue": "", "quoteAll": "true",
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "lineSep": "\n"}


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str,
             header: bool = True, corrupt_column: str | None = None, **options) -> DataFrame:
    """CSV scan with a given schema (the ``read_csv`` of the lessons, without
    type inference, which would need an extra pass over the data). A record
    that does not fit the schema has its text in ``corrupt_column`` and NULL in
    the fields that failed; without such a column it raises an error."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    mode = {"mode": "FAILFAST"}
    if corrupt_column:
        schema = T.StructType([*schema.fields, T.StructField(corrupt_column, T.StringType())])
        mode = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt_column}
    return spark.read.schema(schema).options(header=str(header).lower(), **{**mode, **options}).csv(path)


def write_csv(df: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    """``to_csv(path, index=False)``: with a header, readable by ``read_csv``
    with ``CSV_OPTIONS``. Quoted line breaks make a file a reader's unit of
    work, so files are kept small."""
    df.write.options(header="true", maxRecordsPerFile=str(rows_per_file), **CSV_OPTIONS).csv(path)


def scratch_dir(spark: SparkSession, tag: str) -> str:
    """A new folder in the shared one that ``spark.checkpoint.dir`` names. Only
    a local session without that setting (tests) gets one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        root = "file://" + tempfile.mkdtemp(prefix="gridwork-scratch-")
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def inline_table(spark: SparkSession, rows: Iterable[Sequence], schema: T.StructType | str,
                 with_row_no: bool = False) -> DataFrame:
    """Small literal table with an explicit schema.

    ``with_row_no`` adds a 0-based ``row_no`` column in the given row order,
    standing in for the implicit row index of a labelled table.
    """
    rows = list(rows)
    if with_row_no:
        if isinstance(schema, str):
            schema = T._parse_datatype_string(schema)
        schema = T.StructType([T.StructField("row_no", T.LongType(), False), *schema.fields])
        rows = [(i, *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, schema)


def random_int_table(spark: SparkSession, n_rows: int, columns: Sequence[str],
                     low: int, high: int, seed: int) -> DataFrame:
    """``n_rows`` x len(columns) integers drawn uniformly from [low, high).

    Generated in parallel from ``spark.range``; each column has its own seed
    so columns are independent. ``row_no`` carries the row order.
    """
    df = spark.range(n_rows).withColumnRenamed("id", "row_no")
    span = high - low
    cols = [(F.floor(F.rand(seed + i) * span) + low).cast("long").alias(c)
            for i, c in enumerate(columns)]
    return df.select("row_no", *cols)


def random_normal_table(spark: SparkSession, n_rows: int, columns: Sequence[str],
                        seed: int) -> DataFrame:
    """Standard normal draws, the counterpart of ``np.random.randn``."""
    df = spark.range(n_rows).withColumnRenamed("id", "row_no")
    return df.select("row_no", *[F.randn(seed + i).alias(c) for i, c in enumerate(columns)])


def normalize_nan(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Turn NaN into NULL in floating columns.

    pandas uses NaN as its missing marker; in Spark NaN is an ordinary value
    (``avg`` over it is NaN, ``NaN = NaN`` is true, ``IS NULL`` misses it), so
    missing data is normalised to NULL once, at load.
    """
    floating = {f.name for f in df.schema.fields
                if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    targets = floating if columns is None else floating & set(columns)
    return df.select(*[
        (F.when(F.isnan(c), F.lit(None)).otherwise(F.col(c)).alias(c) if c in targets else F.col(c))
        for c in df.columns
    ])


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c
