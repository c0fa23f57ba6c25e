"""Table sources: the driver parquet tables, CSV with an explicit schema,
inline literal tables and seeded random tables."""

from gridwork.sources.tables import (
    CSV_OPTIONS, TABLE_NAMES, Tables, inline_table, normalize_nan, random_int_table,
    random_normal_table, read_csv, read_table, scratch_dir, write_csv,
)

__all__ = [
    "CSV_OPTIONS", "TABLE_NAMES", "Tables", "inline_table", "normalize_nan", "random_int_table",
    "random_normal_table", "read_csv", "read_table", "scratch_dir", "write_csv",
]
