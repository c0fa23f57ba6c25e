"""The small literal tables of the lessons, with the answers worked out by
"""

import math

from pyspark.sql import functions as F

from gridwork.functions import regex as RX
from gridwork.functions import text as TX
from gridwork.operators import aggregate as AG
from gridwork.operators import joins as J
from gridwork.operators import nulls as NL
from gridwork.operators import schema as S
from gridwork.operators import sets as ST
from gridwork.sources import inline_table, normalize_nan

# The literal tables of the lessons, as given there.
RETAIL = [(1001, "Laptop", 1, 50000, 50000), (1002, "Mouse", 2, 500, 1000),
          (1003, "Keyboard", 1, 1000, 1000), (1004, "Monitor", 1, 7000, 14000),
          (1005, "Headphones", 1, 2000, 2000)]
MARKS = [("A", 10), ("A", 20), ("C", 30), ("D", 40)]
GENDER = [("A", "Male"), ("A", "Female"), ("A", "Male"), ("E", "Female"), ("F", "Male")]
SALES = [("A", 10, "T001", "2024-06-01"), ("A", 20, "T002", "2024-06-05"),
         ("C", 30, "T003", "2024-06-07"), ("D", 40, "T004", "2024-06-08")]
CUSTOMERS = [("A", "Male", "Mumbai"), ("A", "Female", "Mumbai"), ("B", "Male", "Delhi"),
             ("D", "Female", "Chennai"), ("D", "Male", "Hyderabad")]
NAN = float("nan")
NULLS_A = {"A": [1, NAN, 3, NAN, 5, 6, NAN, 8, 9, 10],
           "B": [NAN, 11, 12, 13, NAN, 15, 16, NAN, 18, 19],
           "C": [21, 22, NAN, 24, 25, NAN, 27, 28, NAN, 30],
           "D": [NAN, NAN, 33, 34, NAN, 36, NAN, 38, 39, 40],
           "E": [41, 42, 43, NAN, 45, NAN, 47, 48, 49, NAN]}
NULLS_B = {"A": [1, 22, 3, 23, 5, 6, 41, 8, 9, 10],
           "B": [22, 11, 12, 13, NAN, 15, 16, NAN, 18, 19],
           "C": [21, 22, NAN, 24, 25, NAN, 27, 28, NAN, 30],
           "D": [27, NAN, 33, 34, NAN, 36, NAN, 38, 39, 40],
           "E": [41, 42, 43, NAN, 45, NAN, 47, 48, 49, NAN]}
RETAIL_NULLS = [(101.0, "Laptop", 1.0, 70000.0, "2023-01-10"), (102.0, "Phone", 2.0, 30000.0, "2023-01-12"),
                (103.0, "Tablet", NAN, 25000.0, None), (NAN, "Tablet", 1.0, 25000.0, "2023-01-15"),
                (105.0, None, 2.0, 40000.0, "2023-01-16"), (106.0, "Camera", 1.0, NAN, "2023-01-17"),
                (NAN, "Camera", NAN, 15000.0, "2023-01-18"), (108.0, "Laptop", 3.0, 70000.0, None),
                (109.0, None, 2.0, NAN, "2023-01-20"), (110.0, "Phone", 1.0, 30000.0, "2023-01-21")]
REVIEWS = ["I bought this on 10/07/2025, and it's amazing! 123",
           "Email me at user123@example.com for more info.",
           "The phone number is 987-654-3210, call anytime.",
           "This product is well-made and state-of-the-art!",
           "Worst. Experience. Ever. \U0001F44E So bad I said bad twice. bad bad."]


def _grid(spark, data):
    cols = list(data)
    rows = [tuple(float(data[c][i]) for c in cols) for i in range(len(data[cols[0]]))]
    df = inline_table(spark, rows, ", ".join(f"{c} DOUBLE" for c in cols), with_row_no=True)
    return normalize_nan(df)


def test_retail_array(spark):
    df = inline_table(spark, RETAIL, "customer_id INT, product STRING, quantity INT, price INT, total INT",
                      with_row_no=True)
    r = df.agg(F.sum("total").alias("s"), F.avg("total").alias("m"), F.avg("price").alias("p"),
               F.sum("quantity").alias("q"), F.count_distinct("product").alias("d")).first()
    assert (r.s, r.m, r.p, r.q, r.d) == (68000, 13600.0, 12100.0, 6, 5)
    assert AG.arg_extreme(df, "total", "product", "row_no").first()["product"] == "Laptop"
    # Mouse and Keyboard tie on 1000: the first row wins, as in np.argmin.
    assert AG.arg_extreme(df, "total", "product", "row_no", largest=False).first()["product"] == "Mouse"
    assert [tuple(r) for r in df.where("quantity > 1").select("product", "customer_id").collect()] == [("Mouse", 1002)]
    picked = df.where("price > 1000 AND total >= 2000").orderBy("row_no").select("product").collect()
    assert [r[0] for r in picked] == ["Laptop", "Monitor", "Headphones"]
    assert df.agg(F.sum(F.when(F.col("customer_id") == 1002, F.col("total")))).first()[0] == 1000
    m = {r["product"]: r["value"] for r in AG.group_sums(df, "product", F.sum("quantity")).collect()}
    assert m == {"Headphones": 1, "Keyboard": 1, "Laptop": 1, "Monitor": 1, "Mouse": 2}


def test_merges(spark):
    marks = inline_table(spark, MARKS, "Name STRING, Marks INT")
    gender = inline_table(spark, GENDER, "Name STRING, Gender STRING")
    assert J.merge(marks, gender, "Name", "inner").count() == 6
    assert J.merge(marks, gender, "Name", "left").count() == 8
    assert J.merge(marks, gender, "Name", "right").count() == 8
    ind = J.merge(gender, marks, "Name", "left", indicator=True)
    counts = {r["_merge"]: r["count"] for r in ind.groupBy("_merge").count().collect()}
    assert counts == {"both": 6, "left_only": 2}
    right = J.merge(marks, gender, "Name", "right").select("Name").distinct().collect()
    assert sorted(r[0] for r in right) == ["A", "E", "F"]
    cross = J.merge(marks.withColumn("constant", F.lit(1)), gender.withColumn("constant", F.lit(1)), "constant")
    assert cross.count() == 20
    assert {"Name_x", "Name_y", "constant"} <= set(cross.columns)
    assert J.anti_join(marks, gender, "Name").count() == 2
    assert J.semi_join(marks, gender, "Name").count() == 2


def test_merge_sales_customers(spark):
    s = inline_table(spark, SALES, "CustomerID STRING, TransactionAmount INT, TransactionID STRING, Date STRING")
    c = inline_table(spark, CUSTOMERS, "CustomerID STRING, Gender STRING, Location STRING")
    j = J.merge(s, c, "CustomerID", "inner")
    assert j.count() == 6
    assert {r[0] for r in j.select("CustomerID").collect()} == {"A", "D"}


def test_null_key_merge(spark):
    l = inline_table(spark, [(None, 1), ("a", 2)], "k STRING, x INT")
    r = inline_table(spark, [(None, 10), ("a", 20)], "k STRING, y INT")
    assert J.merge(l, r, "k").count() == 1
    assert J.merge(l, r, "k", null_safe=True).count() == 2


def test_null_table_means_and_counts(spark):
    df = _grid(spark, NULLS_A)
    means = {r["column_name"]: r["mean"] for r in S.column_means(df.drop("row_no")).collect()}
    expect = {"A": 6.0, "B": 104 / 7, "C": 177 / 7, "D": 220 / 6, "E": 45.0}
    assert all(math.isclose(means[k], v) for k, v in expect.items())
    filled = NL.fill_mean(df.drop("row_no")).agg(*[F.count_if(F.col(c).isNull()) for c in "ABCDE"]).first()
    assert list(filled) == [0] * 5
    b = _grid(spark, NULLS_B).drop("row_no")
    counts = {r["column_name"]: r["null_count"] for r in AG.null_counts(b).collect()}
    assert counts == {"A": 0, "B": 2, "C": 3, "D": 3, "E": 3}
    assert NL.dropna(b, "all").count() == 10


def test_retail_nulls_dropna(spark):
    df = normalize_nan(inline_table(
        spark, RETAIL_NULLS,
        "CustomerID DOUBLE, Product STRING, Quantity DOUBLE, Price DOUBLE, PurchaseDate STRING"))
    kept = NL.dropna(df, "any").select("CustomerID").collect()
    assert sorted(r[0] for r in kept) == [101.0, 102.0, 110.0]
    all_kept = NL.dropna(df, "all")
    assert all_kept.count() == 10
    assert S.size(all_kept).first()[0] == 50


def test_ffill_bfill_match_pandas(spark):
    import pandas as pd
    pdf = pd.DataFrame(NULLS_A)
    df = _grid(spark, NULLS_A)
    got_f = NL.ffill(df, ["C", "D"], "row_no").orderBy("row_no").toPandas()
    got_b = NL.bfill(df, ["C", "D"], "row_no").orderBy("row_no").toPandas()
    for c in ["C", "D"]:
        assert got_f[c].fillna(-1).tolist() == pdf[c].ffill().fillna(-1).tolist()
        assert got_b[c].fillna(-1).tolist() == pdf[c].bfill().fillna(-1).tolist()


def test_reviews(spark):
    df = inline_table(spark, [(i, t) for i, t in enumerate(REVIEWS)], "doc_id INT, text STRING")
    out = df.select("doc_id", F.array_join(RX.findall("text", RX.DATE_DMY), ";").alias("d"),
                    TX.word_count("text").alias("w"), RX.strip_punct("text").alias("clean"),
                    F.array_join(RX.findall("text", RX.EMAIL), ";").alias("e")).orderBy("doc_id").collect()
    assert [r.d for r in out] == ["10/07/2025", "", "", "", ""]
    assert [r.w for r in out] == [9, 7, 7, 6, 12]
    assert "\U0001F44E" not in out[4].clean and "its amazing" in out[0].clean
    assert out[1].e == "user123@example.com"


def test_sets(spark):
    def one(values):
        return inline_table(spark, [(str(v),) for v in values], "v STRING")

    x = one([1, 2, 5, 6, 7, "data", "science"])
    y = one([1, 2, 5, 8, 9, 10, "data", "analytics"])
    assert {r[0] for r in ST.intersection(x, y).collect()} == {"1", "2", "5", "data"}
    x2 = one([1, 2, 34, 4, 5, "data", "science"])
    y2 = one([1, 2, 3, 5, 4, "data", "analytics"])
    assert {r[0] for r in ST.difference(x2, y2).collect()} == {"34", "science"}
    rel = ST.relations(one([1, 2]), one([3, 4])).first()
    assert (rel.is_subset, rel.is_superset, rel.is_disjoint) == (False, False, True)
    sd = ST.symmetric_difference(one([1, 2, 3, 4, 5]), one([4, 5, 6, 7, 8]))
    assert {r[0] for r in sd.collect()} == {"1", "2", "3", "6", "7", "8"}
    assert ST.union(x, y).count() == 11
    assert ST.extend(x, y).count() == 15


def test_outer_merge_indicator_and_suffixes(spark):
    marks = inline_table(spark, MARKS, "Name STRING, Marks INT").withColumn("note", F.lit("m"))
    gender = inline_table(spark, GENDER, "Name STRING, Gender STRING").withColumn("note", F.lit("g"))
    out = J.merge(marks, gender, "Name", "outer", indicator=True)
    counts = {r["_merge"]: r["count"] for r in out.groupBy("_merge").count().collect()}
    assert counts == {"both": 6, "left_only": 2, "right_only": 2}
    assert {"note_x", "note_y"} <= set(out.columns)
    assert sorted(r.Name for r in out.where("_merge = 'right_only'").collect()) == ["E", "F"]
