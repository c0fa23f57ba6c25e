"""Column helpers against the Python behaviour they re-create."""

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from gridwork.functions import arrays as AR
from gridwork.functions import maps as MP
from gridwork.functions import numeric as N
from gridwork.functions import text as TX
from gridwork.sources import inline_table


def test_floor_div_mod_bin(spark):
    pairs = [(a, b) for a in (-7, -6, -1, 0, 1, 6, 7, 10 ** 12) for b in (-3, -2, -1, 1, 2, 3)]
    df = inline_table(spark, pairs, "a BIGINT, b BIGINT")
    got = df.select("a", "b", N.floor_div("a", "b").alias("q"), N.py_mod("a", "b").alias("r"),
                    N.bin_text("a").alias("t")).collect()
    for r in got:
        assert (r.q, r.r) == (r.a // r.b, r.a % r.b)
        assert r.t == bin(r.a)
    z = inline_table(spark, [(5, 0)], "a BIGINT, b BIGINT").select(N.floor_div("a", "b"), N.py_mod("a", "b")).first()
    assert tuple(z) == (None, None)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=" \t\n-+0123456789abcXYZé👎ß.!", max_size=12), min_size=1, max_size=6))
def test_string_methods_match_python(spark, words):
    df = inline_table(spark, [(i, w) for i, w in enumerate(words)], "i INT, s STRING")
    got = df.select("i", TX.zfill("s", 8).alias("z"), TX.center("s", 9, "*").alias("c"),
                    TX.center("s", 10).alias("c2"), TX.py_strip("s").alias("st"),
                    F.size(TX.split_ws("s")).alias("n"), TX.word_count("s").alias("wc"),
                    TX.py_find("s", "a").alias("f"),
                    TX.py_slice("s", -3, None).alias("sl"), TX.py_slice("s", 1, -1).alias("sl2"),
                    TX.is_alpha("s").alias("al"), TX.is_space("s").alias("sp"),
                    TX.is_digit("s").alias("dg"), TX.py_strip("s", ".!").alias("sc"),
                    TX.py_strip("s", side="right").alias("rs")).orderBy("i").collect()
    for w, r in zip(words, got):
        assert r.z == w.zfill(8)
        assert r.c == w.center(9, "*") and r.c2 == w.center(10)
        assert r.st == w.strip() and r.n == len(w.split()) == r.wc and r.f == w.find("a")
        assert r.sl == w[-3:] and r.sl2 == w[1:-1]
        assert r.al == w.isalpha() and r.sp == w.isspace() and r.dg == w.isdigit()
        assert r.sc == w.strip(".!") and r.rs == w.rstrip()


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(-5, 5), max_size=7), st.integers(-9, 9), st.integers(-3, 3))
def test_list_methods_match_python(spark, xs, pos, v):
    df = spark.createDataFrame([(xs,)], "a ARRAY<BIGINT>")
    r = df.select(AR.insert_at("a", pos, F.lit(v).cast("long")).alias("ins"),
                  AR.remove_first("a", F.lit(v).cast("long")).alias("rem"),
                  AR.item("a", pos).alias("it"), AR.list_slice("a", pos, None).alias("sl"),
                  AR.index_of("a", F.lit(v).cast("long")).alias("ix"),
                  AR.count_of("a", F.lit(v).cast("long")).alias("cnt"),
                  AR.pop_at("a", pos).alias("pop")).first()
    ins = list(xs)
    ins.insert(pos, v)
    assert r.ins == ins
    rem = list(xs)
    if v in rem:
        rem.remove(v)
    assert r.rem == rem
    assert r.it == (xs[pos] if -len(xs) <= pos < len(xs) else None)
    assert r.sl == xs[pos:]
    assert r.ix == (xs.index(v) if v in xs else None)
    assert r.cnt == xs.count(v)
    if -len(xs) <= pos < len(xs):
        popped = list(xs)
        popped.pop(pos)
        assert r.pop == popped


def test_map_methods(spark):
    df = spark.createDataFrame([({"a": 1, "b": 2},)], "m MAP<STRING, INT>")
    r = df.select(MP.get("m", F.lit("a")).alias("g"), MP.get("m", F.lit("z")).alias("gz"),
                  MP.put("m", F.lit("a"), F.lit(9)).alias("p"), MP.remove("m", F.lit("b")).alias("d"),
                  MP.from_pairs_last_wins(F.array(F.lit("x"), F.lit("y"), F.lit("x")),
                                          F.array(F.lit(1), F.lit(2), F.lit(3))).alias("lw")).first()
    assert (r.g, r.gz, r.p, r.d, r.lw) == (1, None, {"a": 9, "b": 2}, {"a": 1}, {"x": 3, "y": 2})


def test_truthiness_and_dates(spark):
    from gridwork.functions import dates as DT
    df = inline_table(spark, [(0,), (3,), (None,)], "x INT")
    assert [r[0] for r in df.select(N.is_truthy("x")).collect()] == [False, True, False]
    d = spark.createDataFrame([("2024-06-02",)], "s STRING").select(F.to_date("s").alias("d"))
    r = d.select(DT.weekday("d").alias("w"), DT.is_weekend("d").alias("we"),
                 DT.parse_date(F.lit("not a date")).alias("bad")).first()
    assert (r.w, r.we, r.bad) == (6, True, None)


_REGEX_ALPHABET = "aZé_19٣½ \t\n  ́ß\U0001F44E-.,!$@"


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet=_REGEX_ALPHABET, max_size=15), min_size=1, max_size=5))
def test_regex_classes_match_python_re(spark, texts):
    import re
    from gridwork.functions import regex as RX
    df = inline_table(spark, [(i, s) for i, s in enumerate(texts)], "i INT, s STRING")
    got = df.select("i", F.array_join(RX.findall("s", RX.WORD), "").alias("w"),
                    RX.digits_joined("s").alias("d"), RX.strip_punct("s").alias("p"),
                    RX.count_matches("s", RX.WORD).alias("n"),
                    TX.split_ws("s").alias("sp")).orderBy("i").collect()
    for s, r in zip(texts, got):
        assert r.w == "".join(re.findall(r"\w", s))
        assert r.d == "".join(re.findall(r"\d", s))
        assert r.p == re.sub(r"[^\w\s]", "", s)
        assert r.n == len(re.findall(r"\w", s))
        assert r.sp == s.split()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\ré👎", max_size=10), min_size=1, max_size=5))
def test_lines_chars_prefixes_match_python(spark, texts):
    df = inline_table(spark, [(i, s) for i, s in enumerate(texts)], "i INT, s STRING")
    got = df.select("i", TX.split_lines("s").alias("ln"), TX.chars("s").alias("ch"),
                    TX.prefixes("s").alias("pf"), TX.py_index("s", "b").alias("ix"),
                    TX.line_count("s").alias("nl")).orderBy("i").collect()
    for s, r in zip(texts, got):
        assert r.ln == s.splitlines() and r.nl == len(s.splitlines())
        assert r.ch == list(s)
        assert r.pf == [s[:k] for k in range(1, len(s))]
        assert r.ix == (s.index("b") if "b" in s else None)


@settings(max_examples=30, deadline=None)
@given(st.text(alphabet=_REGEX_ALPHABET + "aeiou", max_size=30))
def test_count_chars_matches_findall(spark, s):
    import re
    from gridwork.functions import regex as RX
    df = inline_table(spark, [(s,)], "s STRING")
    r = df.select(RX.count_chars("s", "[aeiou]").alias("v"), RX.count_chars("s", RX.WORD).alias("w"),
                  RX.count_chars("s", r"[^\p{Nd}]").alias("nd")).first()
    assert (r.v, r.w, r.nd) == (len(re.findall("[aeiou]", s)), len(re.findall(r"\w", s)), len(re.findall(r"\D", s)))


def test_pandas_comparison_rules(spark):
    import pandas as pd
    from gridwork.functions import predicates as P
    vals = [1.0, None, 3.0]
    df = spark.createDataFrame([(v,) for v in vals], "x DOUBLE")
    s = pd.Series([1.0, float("nan"), 3.0])
    r = df.select(P.pd_ne("x", 1.0).alias("ne"), P.pd_eq("x", 1.0).alias("eq"),
                  P.pd_not_isin("x", [3.0]).alias("ni"), P.pd_isin("x", [3.0]).alias("i"),
                  P.pd_mask_not(F.col("x") > 2).alias("nm")).collect()
    assert [x.ne for x in r] == list(s != 1.0) and [x.eq for x in r] == list(s == 1.0)
    assert [x.ni for x in r] == list(~s.isin([3.0])) and [x.i for x in r] == list(s.isin([3.0]))
    assert [x.nm for x in r] == list(~(s > 2))
    # Spark's own NOT IN drops the missing row; the pandas rule keeps it.
    assert df.where(~F.col("x").isin(3.0)).count() == 1
    assert df.where(P.pd_not_isin("x", [3.0])).count() == 2
