"""Every registered query against its DuckDB oracle on the sf0.001 tables."""

import importlib.util
import os

import duckdb
import pytest

from tests.conftest import SF_SMALL

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_spec = importlib.util.spec_from_file_location("check_oracle", os.path.join(ROOT, "scripts", "check_oracle.py"))
check = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(check)

from gridwork.plans.registry import ORACLE, QUERIES, load_all  # noqa: E402
from gridwork.sources import TABLE_NAMES  # noqa: E402

load_all()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLE_NAMES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    assert check.type_diffs(sdf.schema, con.sql(ORACLE[name])) == []
    spdf = sdf.toPandas()
    dpdf = con.execute(ORACLE[name]).fetchdf()
    sc, sr = check.rows_of(spdf)
    dc, dr = check.rows_of(dpdf)
    assert sc == dc
    assert len(sr) == len(dr)
    assert sr == dr
