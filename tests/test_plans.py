"""Plan-shape checks and the registry contract."""

import importlib.util
import os
import re

import pytest

from gridwork.plans.registry import QUERIES
from tests.conftest import SF_SMALL

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry_contract(spark):
    mod = _entry()
    df = mod.entry(spark)
    assert df.columns == ["region", "sales", "share_pct"]
    assert df.count() == 6
    q, o = mod.queries(), mod.oracle_sql()
    assert set(o) <= set(q)
    assert set(QUERIES) <= set(o)


def test_no_python_udfs_anywhere(spark):
    mod = _entry()
    for name, fn in QUERIES.items():
        plan = _plan(fn(spark, SF_SMALL))
        assert "PythonUDF" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name


def test_scan_pruning_and_pushdown(spark):
    from gridwork.plans.basics import s3_parquet_scan_pruned
    plan = _plan(s3_parquet_scan_pruned(spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(l_shipdate), IsNotNull(l_returnflag), GreaterThanOrEqual(l_shipdate" in plan
    read_schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "l_extendedprice" not in read_schema and "l_tax" not in read_schema


def test_top_k_is_take_ordered(spark):
    from gridwork.plans.aggregates import w5_top_orders
    assert "TakeOrderedAndProject" in _plan(w5_top_orders(spark, SF_SMALL))


@pytest.mark.parametrize("name,key", [("n4_ffill_by_user", "user_id"), ("w6_lag_previous_order", "o_custkey"), ("q23_order_gaps", "o_custkey")])
def test_keyed_scans_are_not_single_key_windows(spark, name, key):
    """Ordered scans in a key group run on range chunks: the per-row window
    is partitioned by the group and one more column, the rows below it are
    dealt by that other column alone, and they are dealt once."""
    lines = _plan(QUERIES[name](spark, SF_SMALL)).split("\n")
    per_row = 0
    for i, line in enumerate(lines):
        spec = re.search(r"Window \[.*\], \[([^\]]*)\], \[[^\]]*\]$", line)
        if not spec:
            continue
        keys = [k.split("#")[0] for k in spec[1].split(", ")]
        assert keys != [key]
        if key in keys:
            per_row += 1
            other, = set(keys) - {key}
            below = iter(lines[i + 1:])
            exchange = next(x for x in below if "Exchange" in x)
            assert f"hashpartitioning({other}#" in exchange and key not in exchange
            # nothing but projections between that shuffle and the scan, subqueries aside
            depth = len(exchange) - len(exchange.lstrip(" :+-"))
            spine = [x for x in below if len(x) - len(x.lstrip(" :+-")) > depth]
            end = next(k for k, x in enumerate(spine) if "FileScan" in x and "Subquery" not in x)
            main = [x for x in spine[:end] if "Exchange" in x and ":" not in x[depth:].split("Exchange")[0]]
            assert not main, main
    assert per_row


@pytest.mark.parametrize("name", ["q11_top_products", "q12_product_profit_flags", "q13_worst_products", "q14_profit_distribution", "q33_quantity_per_product"])
def test_product_totals_are_summed_before_the_shuffle(spark, name):
    """Lines are never shuffled as they are: right below the first exchange
    above the line scan stands a partial aggregate, also without broadcasts."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = _plan(QUERIES[name](spark, SF_SMALL)).split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    scan = next(i for i, x in enumerate(lines) if "FileScan" in x and "l_partkey" in x)
    exchange = max(i for i, x in enumerate(lines[:scan]) if "Exchange hashpartitioning(l_partkey" in x)
    assert "HashAggregate" in lines[exchange + 1] and "partial_" in lines[exchange + 1]
    if name in ("q11_top_products", "q33_quantity_per_product"):
        assert not any("p_partkey" in x for x in lines)


def test_single_partition_windows_only_over_aggregates(spark):
    """A window without partition keys runs in one task; every such window in
    a registered plan must read an aggregate's output (one row per group or
    per task), never rows of a scanned table."""
    mod = _entry()
    for name, fn in QUERIES.items():
        lines = _plan(fn(spark, SF_SMALL)).split("\n")
        for i, line in enumerate(lines):
            if "Exchange SinglePartition" in line and any("Window" in x for x in lines[max(0, i - 3):i]):
                below = " ".join(lines[i + 1:i + 4])
                assert "HashAggregate" in below or "ObjectHashAggregate" in below, (name, below[:200])
