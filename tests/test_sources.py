"""Readers and generated tables."""

from pyspark.sql import functions as F

from gridwork.sources import Tables, random_int_table, random_normal_table, read_csv, read_table


def test_read_csv_with_schema(spark, tmp_path):
    p = tmp_path / "sales.csv"
    p.write_text("CustomerID,Amount,Date\nA,10,2024-06-01\nB,,2024-06-05\n")
    df = read_csv(spark, str(p), "CustomerID STRING, Amount INT, Date DATE")
    assert [f.dataType.simpleString() for f in df.schema] == ["string", "int", "date"]
    rows = df.orderBy("CustomerID").collect()
    assert rows[0].Amount == 10 and rows[1].Amount is None


def test_random_tables_are_seeded_and_bounded(spark):
    a = random_int_table(spark, 1000, ["x", "y"], 0, 100, seed=42)
    b = random_int_table(spark, 1000, ["x", "y"], 0, 100, seed=42)
    assert a.orderBy("row_no").collect() == b.orderBy("row_no").collect()
    r = a.agg(F.min("x"), F.max("x"), F.count_distinct("x")).first()
    assert r[0] >= 0 and r[1] <= 99 and r[2] > 90
    n = random_normal_table(spark, 5000, ["z"], seed=1).agg(F.avg("z"), F.stddev_pop("z")).first()
    assert abs(n[0]) < 0.1 and abs(n[1] - 1) < 0.1


def test_tables_read_by_name(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    assert t.region.schema == read_table(spark, "/root/testdata/sf0.001", "region").schema and t.region.count() == 5



def test_scale_conf():
    from gridwork.session import scale_conf
    c = scale_conf(100 << 40, 8000)
    assert int(c["spark.sql.shuffle.partitions"]) == 409600
    assert int(scale_conf(1 << 20, 8)["spark.sql.shuffle.partitions"]) == 16
