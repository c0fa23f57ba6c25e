"""Operators on skewed and edge-case inputs, compared with pandas/NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridwork.operators import aggregate as AG
from gridwork.operators import order as O
from gridwork.operators import stats as STS
from gridwork.operators.window import forward_fill, lag_in_group


def _skewed(spark, n=3000, seed=7):
    """Key 0 holds a third of the rows; values have gaps (NULL)."""
    rng = np.random.default_rng(seed)
    keys = np.where(np.arange(n) % 3 == 0, 0, rng.integers(1, 40, n))
    vals = rng.normal(size=n).round(3)
    vals[rng.random(n) < 0.3] = np.nan
    pdf = pd.DataFrame({"k": keys.astype("int64"), "t": np.arange(n, dtype="int64"), "v": vals})
    df = spark.createDataFrame(pdf).withColumn("v", F.when(F.isnan("v"), None).otherwise(F.col("v")))
    return pdf, df


def test_ordinal_hot_key(spark):
    pdf, df = _skewed(spark)
    got = O.ordinal(df, ["t"], ["k"], name="pos").toPandas().sort_values("t")
    exp = pdf.sort_values("t").groupby("k").cumcount()
    assert got["pos"].tolist() == exp.tolist()


def test_fill_and_lag_hot_key(spark):
    pdf, df = _skewed(spark)
    f = forward_fill(df, ["v"], ["t"], ["k"]).toPandas().sort_values("t")
    b = forward_fill(df, ["v"], ["t"], ["k"], backward=True).toPandas().sort_values("t")
    lg = lag_in_group(df, "v", ["t"], ["k"], name="p").toPandas().sort_values("t")
    s = pdf.sort_values("t")
    assert f["v"].fillna(99).tolist() == s.groupby("k")["v"].ffill().fillna(99).tolist()
    assert b["v"].fillna(99).tolist() == s.groupby("k")["v"].bfill().fillna(99).tolist()
    assert lg["p"].fillna(99).tolist() == s.groupby("k")["v"].shift(1).fillna(99).tolist()


def test_exact_quantiles_match_numpy(spark):
    pdf, df = _skewed(spark)
    got = AG.exact_quantiles(df, "v", [0.0, 0.25, 0.5, 0.9, 1.0], ["k"]).toPandas().set_index("k")
    for k, g in pdf.dropna().groupby("k"):
        exp = np.quantile(g["v"].to_numpy(), [0.0, 0.25, 0.5, 0.9, 1.0])
        assert np.allclose(got.loc[k].to_numpy(dtype=float), exp)


def test_slices_and_topk(spark):
    df = spark.range(100).withColumnRenamed("id", "x")
    got = O.position_slice(df, ["x"], -5, -2).select("x").collect()
    assert [r[0] for r in got] == list(range(100))[-5:-2]
    assert O.position_slice(df, ["x"], 7, 3).count() == 0
    assert [r[0] for r in O.tail(df, "x", 3).collect()] == [97, 98, 99]
    assert O.nth_largest(df, "x", 2).first()[0] == 97
    ties = spark.createDataFrame([(1, 5), (2, 5), (3, 4)], "id INT, v INT")
    assert [r.id for r in O.top_k(ties, "v", 2, ["id"]).collect()] == [1, 2]


def test_value_counts_and_pivot_total(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), (None, 4)], "g STRING, v INT")
    vc = AG.value_counts(df, "g").collect()
    assert [(r.g, r["count"]) for r in vc] == [("a", 2), ("b", 1)]
    pct = {r.g: r.percent for r in AG.value_counts(df, "g", normalize=True).collect()}
    assert abs(pct["a"] - 200 / 3) < 1e-9
    pv = {r.g: r.total for r in AG.pivot_with_total(df.where("g IS NOT NULL"), ["g"],
                                                    {"total": F.sum("v")}).collect()}
    assert pv == {"a": 4, "b": 2, "Grand Total": 6}


def test_statistics_match_numpy(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.choice(list("abc"), 600), "v": rng.normal(size=600)})
    df = spark.createDataFrame(pdf)
    a, b = pdf[pdf.g == "a"].v, pdf[pdf.g == "b"].v
    t = (a.mean() - b.mean()) / np.sqrt(a.var() / len(a) + b.var() / len(b))
    assert abs(STS.welch_t(df, "g", "v", "a", "b").first().t_stat - t) < 1e-9
    groups = [g.v.to_numpy() for _, g in pdf.groupby("g")]
    grand = pdf.v.mean()
    ssb = sum(len(x) * (x.mean() - grand) ** 2 for x in groups)
    ssw = sum(((x - x.mean()) ** 2).sum() for x in groups)
    f = (ssb / 2) / (ssw / (600 - 3))
    assert abs(STS.anova_f(df, "g", "v").first().f_stat - f) < 1e-9
    # Chi-square with an absent cell equals the full-grid computation.
    cnt = pd.DataFrame({"r": ["x", "x", "y"], "c": ["p", "q", "p"], "n": [10, 20, 30]})
    grid = cnt.pivot_table(index="r", columns="c", values="n", fill_value=0).to_numpy(dtype=float)
    e = grid.sum(1, keepdims=True) * grid.sum(0, keepdims=True) / grid.sum()
    chi = ((grid - e) ** 2 / e).sum()
    got = STS.chi_square(spark.createDataFrame(cnt), "r", "c", "n").first()
    assert abs(got.chi2 - chi) < 1e-9 and got.dof == 1


def test_narrow_types(spark):
    from gridwork.operators import schema as S
    df = spark.createDataFrame([(1, 300, 70000, 1 << 40)], "a BIGINT, b BIGINT, c BIGINT, d BIGINT")
    plan = {r.column_name: r.narrow_type for r in S.narrow_integer_types(df).collect()}
    assert plan == {"a": "tinyint", "b": "smallint", "c": "int", "d": "bigint"}
    assert [f.dataType.simpleString() for f in S.narrow(df).schema] == ["tinyint", "smallint", "int", "bigint"]


def test_position_slice_descending(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("x"), F.col("id").alias("y"))
    got = O.position_slice(df, ["-x"], 10, 20).orderBy("position").collect()
    assert [r.position for r in got] == list(range(10, 20)) and got[0].x == 489
    with pytest.raises(TypeError):
        O.tail(df, F.col("x"), 3)


def test_quantiles_many_groups_ties_null_and_nan(spark):
    df = spark.range(90000).select((F.col("id") % 30000).alias("k"), (F.col("id") % 7).cast("double").alias("v"))
    got = AG.exact_quantiles(df, "v", [0.5], ["k"])
    assert got.count() == 30000
    rows = [(None, 1.0), (None, float("nan")), (None, None), (None, 4.0), *[(1, 5.0)] * 500, *[(1, float(i)) for i in range(499)]]
    small = spark.createDataFrame(rows, "k INT, v DOUBLE")
    out = {r.k: r.q50 for r in AG.exact_quantiles(small, "v", [0.5], ["k"]).collect()}
    assert out == {None: 2.5, 1: float(np.median([5.0] * 500 + list(range(499))))}


def test_null_group_fill_lag_ordinal(spark):
    df = spark.createDataFrame([(None, i, None if i % 3 else float(i)) for i in range(4000)], "k INT, t INT, v DOUBLE")
    f = forward_fill(df, ["v"], ["t"], ["k"]).orderBy("t").collect()
    assert [r.v for r in f] == [float(i - i % 3) for i in range(4000)]
    p = lag_in_group(df, "t", ["t"], ["k"], name="p").orderBy("t").collect()
    assert [r.p for r in p] == [None, *range(3999)]
    assert [r.pos for r in O.ordinal(df, ["t"], ["k"], name="pos").orderBy("t").collect()] == list(range(4000))
    gaps = spark.createDataFrame([(0, 1.0), (1, float("nan")), (2, None), (3, 4.0)], "t INT, v DOUBLE")
    assert [r.v for r in forward_fill(gaps, ["v"], ["t"]).orderBy("t").collect()] == [1.0, 1.0, 1.0, 4.0]
    assert [r.v for r in forward_fill(gaps, ["v"], ["t"], backward=True).orderBy("t").collect()] == [1.0, 4.0, 4.0, 4.0]


def test_chunks_are_lazy_spread_and_shuffled_once(spark):
    df = spark.range(20000).select(F.lit(1).alias("k"), F.col("id").alias("t"))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup
    before = len(jobs())
    out = O.ordinal(df, ["t"], ["k"], name="pos")
    assert len(jobs()) == before
    chunks = O.sorted_chunks(df, ["t"], ["k"]).groupBy(O._PID).count().collect()
    assert len(chunks) >= 16 and max(r["count"] for r in chunks) < 20000 / 8
    assert [r.pos for r in out.orderBy("t").collect()] == list(range(20000))


def test_repeated_rows_spread(spark):
    """400,000 rows of 10 values: positions are exact and written out by many
    tasks, none with much more than its share."""
    df = spark.range(400000).select((F.col("id") % 10).alias("v"), F.lit("x").alias("w"))
    out = O.ordinal(df, ["-v"], ["w"], name="pos", repeated=True)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert len(sizes) >= 6 and max(sizes) <= 400000 / 3
    got = {r.v: (r.lo, r.hi, r.n, r.d) for r in out.groupBy("v").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count("*").alias("n"), F.countDistinct("pos").alias("d")).collect()}
    assert got == {v: ((9 - v) * 40000, (9 - v) * 40000 + 39999, 40000, 40000) for v in range(10)}
    assert O.ordinal(df.where("false"), ["v"], repeated=True).count() == 0
    few = spark.createDataFrame([(None,), (None,), (1,)], "v INT")
    assert sorted((r.v or 0, r.ordinal) for r in O.ordinal(few, ["v"], repeated=True).collect()) == [(0, 0), (0, 1), (1, 2)]


def test_one_frequent_row_does_not_fill_the_sample(spark):
    """Half of the rows are one row; the other half still falls into many
    chunks."""
    df = spark.range(40000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("t"))
    chunks = O.sorted_chunks(df, ["t"]).where("t > 0").groupBy(O._PID).count().collect()
    assert len(chunks) >= 16 and max(r["count"] for r in chunks) < 20000 / 8


def test_chunks_follow_every_order(spark):
    """Each type in both directions, with NULL, NaN, prefixes and negatives,
    as Spark sorts."""
    from datetime import date, datetime
    from decimal import Decimal
    rows = [(None,) * 6, ("a", float("nan"), True, date(2020, 1, 1), datetime(2020, 1, 1), Decimal("1.5")),
            ("ab", -0.0, False, date(1969, 1, 1), datetime(1960, 1, 1), Decimal("-1.5")), ("b", 1e300, True, date(2021, 1, 1), datetime(2021, 3, 1), Decimal("0")),
            ("", float("-inf"), False, date(2000, 1, 1), datetime(2022, 1, 1), Decimal("9")), ("aÿ", 2.0, True, date(1, 1, 1), datetime(2021, 1, 1), Decimal("7"))]
    df = spark.createDataFrame(rows, "s string, f double, b boolean, d date, t timestamp_ntz, n decimal(5,2)")
    df = df.withColumn("ts", F.col("t").cast("timestamp")).withColumn("i", F.col("n").cast("int")).withColumn("y", F.col("s").cast("binary"))
    for c in df.columns:
        for by in (c, f"-{c}"):
            got = [str(r[0]) for r in O.ordinal(df, [by, "i"], name="p", n_chunks=16).orderBy("p").select(c).collect()]
            assert got == [str(r[0]) for r in df.orderBy(*O.sort_columns([by, "i"])).select(c).collect()], by
    with pytest.raises(TypeError):
        O.ordinal(df.withColumn("m", F.array("i")), ["-m"])


def test_matrix_reductions_match_numpy(spark):
    from gridwork.operators import matrix as MX
    rng = np.random.default_rng(5)
    data = rng.integers(0, 10, size=(10, 5))
    df = spark.createDataFrame([(i, [int(x) for x in row]) for i, row in enumerate(data)], "row_id INT, row ARRAY<INT>")
    t = MX.total_reduce(df, "row").first()
    assert (t.total, t.max, t.min) == (data.sum(), data.max(), data.min())
    cols = MX.column_reduce(df, "row", ("sum", "max")).orderBy("col_id").collect()
    assert [r.col_sum for r in cols] == list(data.sum(axis=0)) and [r.col_max for r in cols] == list(data.max(axis=0))
    rows = df.select("row_id", MX.row_sums("row").alias("s"), MX.row_argmax("row").alias("a")).orderBy("row_id").collect()
    assert [r.s for r in rows] == list(data.sum(axis=1)) and [r.a for r in rows] == list(data.argmax(axis=1))
    fa = MX.flat_argmax(df, "row_id", "row", 5).first()
    fi = MX.flat_argmax(df, "row_id", "row", 5, largest=False).first()
    assert (fa.flat_index, fi.flat_index) == (data.argmax(), data.argmin())
    tr = MX.transpose_long(df, "row_id", "row").collect()
    assert all(data.T[r.row_id, r.col_id] == r.value for r in tr) and len(tr) == 50


def test_shape_and_types(spark):
    from gridwork.operators import schema as S
    df = spark.createDataFrame([(1, 2.0, "a"), (2, None, "b")], "i INT, d DOUBLE, s STRING")
    assert tuple(S.shape(df).first()) == (2, 3)
    assert S.size(df).first()[0] == 6
    assert S.dtypes(df) == [("i", "int"), ("d", "double"), ("s", "string")]
    assert S.select_dtypes(df, "float") == ["d"] and S.select_dtypes(df, "number") == ["i", "d"]


def test_empty_inputs(spark):
    from gridwork.operators import nulls as NL
    from gridwork.operators import reshape as RS
    from gridwork.operators import sets as ST
    e = spark.createDataFrame([], "k INT, t BIGINT, v DOUBLE, s STRING")
    assert AG.exact_quantiles(e, "v", [0.5], ["k"]).count() == 0
    assert AG.exact_quantiles(e, "v", [0.5]).count() <= 1
    assert O.ordinal(e, ["t"], ["k"]).count() == 0
    assert forward_fill(e, ["v"], ["t"], ["k"]).count() == 0
    assert lag_in_group(e, "v", ["t"], ["k"]).count() == 0
    assert AG.value_counts(e, "s").count() == 0
    assert AG.value_counts(e, "s", normalize=True).count() == 0
    assert {r.k for r in AG.pivot_with_total(e, ["k"], {"n": F.count("v")}).collect()} <= {"Grand Total"}
    assert all(r.null_count == 0 for r in AG.null_counts(e).collect())
    assert NL.fill_mean(e, ["v"]).count() == 0
    assert AG.arg_extreme(e, "v", "s", "t").count() <= 1
    assert RS.one_hot(e, "s", ["a"]).columns == ["k", "t", "v", "s_a"]
    assert ST.relations(e.select("k"), e.select("k")).first().is_subset
    assert O.position_slice(e, ["t"], 0, 5).count() == 0 and O.position_slice(e, ["t"], -3, None).count() == 0


def test_nan_beside_null(spark):
    from gridwork.operators import nulls as NL
    df = spark.createDataFrame([(0, 1.0), (1, float("nan")), (2, None), (3, 3.0)], "i INT, v DOUBLE")
    assert {r.column_name: r.null_count for r in AG.null_counts(df).collect()}["v"] == 2
    assert [r.v for r in NL.fill_mean(df, ["v"]).orderBy("i").collect()] == [1.0, 2.0, 2.0, 3.0]
    assert NL.dropna(df, "any").count() == 2
