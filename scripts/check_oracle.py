"""Run every registered query on Spark and its oracle SQL on DuckDB, compare.

Usage: python scripts/check_oracle.py [sf_dir] [name-substring ...]

Comparison: same column names, same row count, then rows compared after
sorting the columns by name and the rows by value. Floats are compared exactly
and, separately, to 9 significant digits, so near-misses are visible.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from gridwork import get_session  # noqa: E402
from gridwork.plans.registry import ORACLE, QUERIES, load_all  # noqa: E402
from gridwork.sources import TABLE_NAMES  # noqa: E402


def _norm(v, digits=None):
    if v is None:
        return (0, "")
    try:
        import numpy as np
        if isinstance(v, np.ndarray):
            v = v.tolist()
        elif isinstance(v, np.generic):
            v = v.item()
    except ImportError:
        pass
    if isinstance(v, float):
        if math.isnan(v):
            return (0, "")
        if digits:
            return (1, float(f"{v:.{digits}g}"))
        return (1, v)
    if isinstance(v, bool):
        return (2, int(v))
    if isinstance(v, int):
        return (1, float(v)) if digits else (1, v)
    if isinstance(v, (list, tuple)):
        return (3, tuple(_norm(x, digits) for x in v))
    if isinstance(v, dict):
        return (4, tuple(sorted((str(k), _norm(x, digits)) for k, x in v.items())))
    if hasattr(v, "isoformat"):
        return (5, str(v)[:26])
    return (6, str(v))


# Spark simple type names and the DuckDB types that hold the same values.
SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "smallint": "SMALLINT", "tinyint": "TINYINT", "float": "FLOAT"}


def type_diffs(spark_schema, duck_relation):
    """Columns whose Spark type and DuckDB type differ."""
    d = dict(zip(duck_relation.columns, [str(t) for t in duck_relation.types]))
    return [(f.name, f.dataType.simpleString(), d.get(f.name)) for f in spark_schema.fields
            if SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString()) != d.get(f.name)]


def rows_of(pdf, digits=None):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False):
        out.append(tuple(_norm(None if (not isinstance(x, (list, tuple, dict)) and _isnull(x)) else x, digits)
                         for x in rec))
    return cols, sorted(out, key=repr)


def _isnull(x):
    try:
        import pandas as pd
        r = pd.isna(x)
        return bool(r) if not hasattr(r, "__len__") else False
    except Exception:
        return x is None


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    pats = args[1:] if args and os.path.isdir(args[0]) else args
    spark = get_session(master="local[8]", shuffle_partitions=8)
    load_all()
    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    bad = 0
    for name in sorted(QUERIES):
        if pats and not any(p in name for p in pats):
            continue
        t0 = time.time()
        try:
            sdf = QUERIES[name](spark, sf_dir)
            spdf = sdf.toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in ORACLE:
            print(f"ROWS {name}: {len(spdf)} rows (no oracle) {ts:.1f}s")
            continue
        try:
            diffs = type_diffs(sdf.schema, con.sql(ORACLE[name]))
            if diffs:
                print(f"FAIL {name}: column types differ {diffs}")
                bad += 1
                continue
            dpdf = con.execute(ORACLE[name]).fetchdf()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        sc, sr = rows_of(spdf)
        dc, dr = rows_of(dpdf)
        if sc != dc:
            print(f"FAIL {name}: columns spark={sc} duck={dc}")
            bad += 1
            continue
        if len(sr) != len(dr):
            print(f"FAIL {name}: rows spark={len(sr)} duck={len(dr)}")
            bad += 1
            continue
        if sr == dr:
            print(f"OK   {name}: {len(sr)} rows exact {ts:.1f}s")
            continue
        _, sr9 = rows_of(spdf, 9)
        _, dr9 = rows_of(dpdf, 9)
        if sr9 == dr9:
            print(f"NEAR {name}: {len(sr)} rows equal to 9 digits only")
        else:
            diff = [(a, b) for a, b in zip(sr9, dr9) if a != b][:3]
            print(f"FAIL {name}: values differ, e.g. {diff}")
        bad += 1
    spark.stop()
    sys.exit(1 if bad else 0)


if __name__ == "__main__":
    main()
