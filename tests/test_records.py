"""Ordered dicts, line separators, empty matches, dates, CSV, matrix slices and
the catalogue, against Python and NumPy."""

import random
import re
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwork.functions import dates as DT
from gridwork.functions import ordered as OD
from gridwork.functions import regex as RX
from gridwork.functions import text as TX
from gridwork.operators import matrix as MX
from gridwork.operators import schema as S
from gridwork.sources import CSV_OPTIONS, read_csv, scratch_dir, write_csv
from tests.conftest import SF_SMALL


def test_ordered_dict_follows_python(spark):
    rng = random.Random(4)
    rows, want = [], []
    for i in range(200):
        pairs = [(rng.choice("abcd"), str(rng.randint(0, 9))) for _ in range(rng.randint(0, 6))]
        new, gone = rng.choice("abcde"), rng.choice("abcde")
        rows.append((i, pairs, new, gone))
        d = dict(pairs)
        d[new] = "put"
        first = list(d.items())
        d.pop(gone, None)
        d[gone] = "again"
        want.append((first, list(d.keys()), list(d.values()), d.get("a")))
    df = spark.createDataFrame(rows, "i int, p array<struct<key:string,value:string>>, n string, g string")
    df = df.withColumn("d", OD.from_pairs("p")).withColumn("d", OD.put("d", "n", F.lit("put"))).withColumn("e", OD.put(OD.delete("d", "g"), "g", F.lit("again")))
    got = df.select("i", OD.items("d").alias("first"), OD.keys("e").alias("k"), OD.values("e").alias("v"), OD.get("e", F.lit("a")).alias("a")).orderBy("i").collect()
    assert [([tuple(x) for x in r.first], r.k, r.v, r.a) for r in got] == want


def test_splitlines_with_every_separator(spark):
    rng = random.Random(8)
    bits = ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", " ", " ", "a", "b c", "\x1f", "\t", " ", " "]
    texts = ["", "\n", "\r\n\r\n", *["".join(rng.choices(bits, k=rng.randint(0, 9))) for _ in range(400)]]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    for r in df.select("s", TX.split_lines("s").alias("l"), TX.line_count("s").alias("n")).collect():
        assert r.l == r.s.splitlines() and r.n == len(r.l), repr(r.s)


@pytest.mark.parametrize("python,unit", [("d*", "d+"), ("(?:ab)*", "(?:ab)+"), ("x?", "x"), (r"\d*", r"\p{Nd}+"), ("(?:a|bc)*", "(?:a|bc)+")])
def test_empty_matches_are_counted_as_in_python(spark, python, unit):
    rng = random.Random(2)
    texts = ["", "datadatdatdata", *["".join(rng.choices("abcdx1٣ \n", k=rng.randint(0, 12))) for _ in range(300)]]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    for r in df.select("s", RX.count_with_empty("s", unit).alias("n")).collect():
        assert r.n == len(re.findall(python, r.s)), repr(r.s)


def test_literal_counts(spark):
    df = spark.createDataFrame([("aaa $ the$and", "aa")], "s string, t string")
    assert df.select(*[TX.count_literal("s", x).alias(x) for x in ("aa", "$", "the", "zz")]).first().asDict() == {"aa": 1, "$": 2, "the": 1, "zz": 0}


def test_dates_by_their_shape(spark):
    from gridwork.plans.records import DATES
    texts = ["2024-02-29", "2023-02-29", "31/12/1999", "31/11/1999", "7.3.2020", "70.23.22", "March 5, 2021", "Smarch 5, 2021", "", None, "2024-02-29x"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    got = [r.d for r in df.select("i", DT.parse_any("s", DATES).alias("d")).orderBy("i").collect()]
    assert got == [date(2024, 2, 29), None, date(1999, 12, 31), None, date(2020, 3, 7), None, date(2021, 3, 5), None, None, None, None]


def test_csv_keeps_every_text(spark):
    rows = [(1, 'a,"b"\n"c', 0.5), (2, "", 1.5), (3, None, None), (4, " lead and trail ", -1.0), (5, "\r\n\t\\N \\", 2.0), (6, '"', 0.0), (7, "é😀" * 3000, 1e300), (None, ",", 1.0)]
    df = spark.createDataFrame(rows, "id bigint, text string, v double")
    folder = scratch_dir(spark, "test-csv")
    write_csv(df, folder, rows_per_file=2)
    back = read_csv(spark, folder, df.schema, corrupt_column="bad", **CSV_OPTIONS).collect()
    assert sorted(map(str, rows)) == sorted(str((r.id, r.text, r.v)) for r in back)
    assert all(r.bad is None for r in back)


def test_csv_records_that_do_not_fit(spark):
    folder = scratch_dir(spark, "test-bad-csv")
    spark.createDataFrame([("id,v",), ("1,2.5",), ("x,1.0",), ("3,4.0,5",)], "value string").coalesce(1).write.text(folder)
    back = {r.bad: (r.id, r.v) for r in read_csv(spark, folder, "id int, v double", corrupt_column="bad").collect()}
    assert back[None] == (1, 2.5) and back["x,1.0"] == (None, 1.0) and "3,4.0,5" in back
    with pytest.raises(Exception, match="MALFORMED"):
        read_csv(spark, folder, "id int, v double").collect()


def test_matrix_slices_match_numpy(spark):
    data = np.random.default_rng(1).integers(0, 10, (10, 5))
    df = spark.createDataFrame([(i * 7, [float(x) for x in row]) for i, row in enumerate(data)], "k int, e array<double>")
    wanted = {"a": (slice(0, 3), slice(4, 5)), "b": (slice(0, 2), slice(1, 4)), "c": (slice(-1, -2), slice(-2, -3)), "d": (0, slice(None)),
              "e": (slice(8, 99), slice(3, 99)), "f": (slice(-3, -1), slice(-4, None)), "g": (slice(None), -1), "h": (slice(None, -99), slice(None)), "i": (9, 4)}
    got = {name: [] for name in wanted}
    for r in MX.slices_long(df, ["k"], "e", wanted).collect():
        got[r.name].append((r.row, r.col, r.value))
    for name, (rows, cols) in wanted.items():
        r, c = (np.arange(n)[p if isinstance(p, slice) else [p]] for n, p in zip(data.shape, (rows, cols), strict=True))
        assert sorted(got[name]) == [(i, j, float(data[i, j])) for i in r for j in c], name
    assert MX.slices_long(df.where("false"), ["k"], "e", wanted).count() == 0
    with pytest.raises(ValueError):
        MX.slices_long(df, ["k"], "e", {"a": (slice(0, 9, 2), 0)})


def test_catalogue_reads_no_rows(spark):
    from gridwork.plans.basics import m1_catalogue
    df = m1_catalogue(spark, SF_SMALL)
    assert "FileScan" not in df._jdf.queryExecution().executedPlan().toString()
    assert ("documents", 0, "doc_id", "bigint") in [tuple(r) for r in df.collect()]
    assert S.catalogue(spark, {}).count() == 0
