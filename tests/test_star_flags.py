"""The loss/spread flags of the questions on a tiny star schema with a
known losing nation, a losing product and a single-region product (the
driver data has none of these, so the flags need their own fixture)."""

import datetime as dt

import pytest

from gridwork.plans import questions as Q


@pytest.fixture(scope="module")
def star_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("star")
    ts = dt.datetime
    tables = {
        "region": ([(0, "ASIA"), (1, "EUROPE")], "r_regionkey INT, r_name STRING"),
        "nation": ([(0, "JAPAN", 0), (1, "FRANCE", 1)], "n_nationkey INT, n_name STRING, n_regionkey INT"),
        "customer": ([(1, "c1", 0, 1.0, "BUILDING"), (2, "c2", 1, 2.0, "MACHINERY")],
                     "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"),
        "part": ([(10, "p10", "B1", "T1", 1, 100.0), (20, "p20", "B2", "T2", 1, 1.0)],
                 "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE"),
        "orders": ([(100, 1, "F", 0.0, ts(1996, 1, 5), "1-URGENT"), (101, 1, "F", 0.0, ts(1997, 2, 5), "2-HIGH"),
                    (200, 2, "F", 0.0, ts(1996, 3, 5), "1-URGENT")],
                   "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
                   "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"),
        # Part 10 costs 100 a unit and sells for 50 a unit with a 10% discount: it
        # always loses, so JAPAN (which only buys it) loses every year.
        "lineitem": ([(100, 10, 1, 1, 2.0, 100.0, 0.10, 0.0, "N", "O", ts(1996, 1, 9)),
                      (101, 10, 1, 1, 1.0, 50.0, 0.10, 0.0, "N", "O", ts(1997, 2, 9)),
                      (200, 20, 1, 1, 5.0, 500.0, 0.0, 0.0, "N", "O", ts(1996, 3, 9))],
                     "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
                     "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, "
                     "l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(d / f"{name}.parquet"))
    return str(d)


def test_loss_every_year(spark, star_dir):
    r = {x.n_name: x for x in Q.q06_loss_nations(spark, star_dir).collect()}
    assert r["JAPAN"].loses_every_year and r["JAPAN"].loss_years == 2
    assert not r["FRANCE"].loses_every_year


def test_product_flags_and_spread(spark, star_dir):
    p = {x.l_partkey: x for x in Q.q12_product_profit_flags(spark, star_dir).collect()}
    assert p[10].losing and p[10].always_unprofitable
    assert not p[20].losing
    s = {x.l_partkey: x.single_region for x in Q.q18_product_region_spread(spark, star_dir).collect()}
    assert s == {10: True, 20: True}
    b = {x.p_brand: x.over_discounted_losing for x in Q.q16_over_discounted_losing(spark, star_dir).collect()}
    assert b == {"B1": True, "B2": False}
