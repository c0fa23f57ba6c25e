"""Scans, schema/shape, filters, slicing, conditionals and arithmetic
(inventory S, M, F, C, E) as queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwork.functions import numeric as N
from gridwork.operators import order as O
from gridwork.operators import schema as S
from gridwork.plans.registry import register
from gridwork.plans.sqlkit import avg_dec
from gridwork.sources import CSV_OPTIONS, TABLE_NAMES, Tables, read_csv, scratch_dir, write_csv


def _ts(s: str):
    return F.lit(s).cast("timestamp_ntz")


# -- S: scans and generated columns ------------------------------------------

@register("s3_parquet_scan_pruned", """
SELECT l_orderkey, l_linenumber, l_quantity, strftime(l_shipdate, '%Y-%m-%d') AS ship_date
FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01' AND l_returnflag = 'N'""")
def s3_parquet_scan_pruned(spark, sf):
    """Projection and filter reach the parquet scan (ReadSchema has 5 of 11
    columns; PushedFilters holds both predicates)."""
    li = Tables(spark, sf).lineitem
    return li.where((F.col("l_shipdate") >= _ts("1999-01-01")) & (F.col("l_returnflag") == "N")) \
             .select("l_orderkey", "l_linenumber", "l_quantity", F.date_format("l_shipdate", "yyyy-MM-dd").alias("ship_date"))


@register("s8_line_slots", """
SELECT o_orderkey, CAST(unnest(generate_series(1, n)) AS BIGINT) AS slot
FROM (SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)""")
def s8_line_slots(spark, sf):
    """``range(1, n + 1)`` per order, one row per slot: each line's position in
    its order."""
    li = Tables(spark, sf).lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return O.ordinal(li, ["l_linenumber"], ["o_orderkey"], name="at").select("o_orderkey", (F.col("at") + 1).alias("slot"))


@register("s9_labels_constant", """
SELECT c_custkey, 'customer' || CAST(c_custkey AS VARCHAR) AS label, 1 AS constant FROM customer""")
def s9_labels_constant(spark, sf):
    """Generated labels (``"student" + str(i)``) and a constant column."""
    c = Tables(spark, sf).customer
    return c.select("c_custkey", F.concat(F.lit("customer"), F.col("c_custkey").cast("string")).alias("label"),
                    F.lit(1).alias("constant"))


@register("s11_order_part_lists", """
SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) - 1 AS position, l_partkey AS part FROM lineitem""")
def s11_order_part_lists(spark, sf):
    """``.tolist()`` per order: its part keys in order, as (order, position,
    part) rows, so that no order is gathered into one value."""
    li = Tables(spark, sf).lineitem.select("l_orderkey", F.col("l_partkey").alias("part"))
    return O.ordinal(li, ["part"], ["l_orderkey"], name="position", repeated=True).select("l_orderkey", "position", "part")


# -- M: schema and shape -----------------------------------------------------

@register("m2_shape", "SELECT count(*) AS n_rows, CAST(11 AS BIGINT) AS n_cols FROM lineitem")
def m2_shape(spark, sf):
    return S.shape(Tables(spark, sf).lineitem)


@register("m3_size", "SELECT count(*) * 11 AS n_cells FROM lineitem")
def m3_size(spark, sf):
    return S.size(Tables(spark, sf).lineitem)


_M7_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("m7_float_column_means", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {avg_dec(f'CAST({c} AS DECIMAL(18,2))', 2)} AS mean FROM lineitem"
    for c in _M7_COLS))
def m7_float_column_means(spark, sf):
    """``select_dtypes(include='float').mean()``: the floating columns are
    picked from the schema, their means computed in one aggregate."""
    li = Tables(spark, sf).lineitem
    floats = S.select_dtypes(li, "float")
    return S.column_means(li.select(*floats), decimal_scale=2)


@register("m8_try_cast", """
SELECT l_orderkey, l_linenumber, TRY_CAST(trunc(l_extendedprice) AS SMALLINT) AS price_i16,
       TRY_CAST(trunc(l_quantity) AS TINYINT) AS qty_i8
FROM lineitem""")
def m8_try_cast(spark, sf):
    """``astype(np.int16)`` without silent wrap-around: out-of-range values
    become NULL (``try_cast``); fractions truncate toward zero."""
    li = Tables(spark, sf).lineitem
    return li.select("l_orderkey", "l_linenumber",
                     F.col("l_extendedprice").try_cast("smallint").alias("price_i16"),
                     F.col("l_quantity").try_cast("tinyint").alias("qty_i8"))


_M9_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def _narrow_sql(c):
    return (f"SELECT '{c}' AS column_name, CAST(min({c}) AS BIGINT) AS min_value, "
            f"CAST(max({c}) AS BIGINT) AS max_value, CASE "
            f"WHEN min({c}) >= -128 AND max({c}) <= 127 THEN 'tinyint' "
            f"WHEN min({c}) >= -32768 AND max({c}) <= 32767 THEN 'smallint' "
            f"WHEN min({c}) >= -2147483648 AND max({c}) <= 2147483647 THEN 'int' "
            f"ELSE 'bigint' END AS narrow_type FROM lineitem")


@register("m9_narrow_types", " UNION ALL ".join(_narrow_sql(c) for c in _M9_COLS))
def m9_narrow_types(spark, sf):
    """Smallest integer type holding each integer column (one min/max pass)."""
    return S.narrow_integer_types(Tables(spark, sf).lineitem)


@register("m11_transpose_long", """
SELECT CAST(unnest(range(0, len(embedding))) AS BIGINT) AS row_id, vec_id AS col_id,
       CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings""")
def m11_transpose_long(spark, sf):
    """``data.T`` in long form (row, column, value): the transpose of a tall
    matrix has unboundedly wide rows, so it is kept long."""
    from gridwork.operators.matrix import transpose_long
    return transpose_long(Tables(spark, sf).embeddings, "vec_id", "embedding")


# -- F: projection, filters, slicing ----------------------------------------

@register("f2_equality_filter", """
SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'""")
def f2_equality_filter(spark, sf):
    c = Tables(spark, sf).customer
    return c.where(F.col("c_mktsegment") == "BUILDING").select("c_custkey", "c_name", "c_acctbal")


@register("f3_filter_or", """
SELECT l_orderkey, l_linenumber, l_returnflag, l_discount FROM lineitem
WHERE l_returnflag = 'R' OR l_discount >= 0.09""")
def f3_filter_or(spark, sf):
    li = Tables(spark, sf).lineitem
    return li.where((F.col("l_returnflag") == "R") | (F.col("l_discount") >= 0.09)) \
             .select("l_orderkey", "l_linenumber", "l_returnflag", "l_discount")


@register("f4_mask_select", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 400000""")
def f4_mask_select(spark, sf):
    """``ids[totals > x].tolist()``: a mask on one column selecting another."""
    o = Tables(spark, sf).orders
    return o.where(F.col("o_totalprice") > 400000).select("o_orderkey", "o_custkey")


@register("f6_membership", """
SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders
WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('P')""")
def f6_membership(spark, sf):
    o = Tables(spark, sf).orders
    return o.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & ~F.col("o_orderstatus").isin("P")) \
            .select("o_orderkey", "o_orderpriority", "o_orderstatus")


@register("f8_substring_contains", """
SELECT doc_id, n_chars FROM documents WHERE contains(text, '@')""")
def f8_substring_contains(spark, sf):
    """``"@" in text`` over whole documents."""
    d = Tables(spark, sf).documents
    return d.where(F.col("text").contains("@")).select("doc_id", "n_chars")


@register("f9_open_range", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_totalprice < 150000""")
def f9_open_range(spark, sf):
    """``x > a and x < b``: both bounds open (``between`` would close them)."""
    o = Tables(spark, sf).orders
    return o.where((F.col("o_totalprice") > 100000) & (F.col("o_totalprice") < 150000)) \
            .select("o_orderkey", "o_totalprice")


@register("f10_truthiness", """
SELECT l_returnflag, CAST(count_if(coalesce(l_discount <> 0, false)) AS BIGINT) AS truthy,
       CAST(count_if(NOT coalesce(l_discount <> 0, false)) AS BIGINT) AS falsy
FROM lineitem GROUP BY l_returnflag""")
def f10_truthiness(spark, sf):
    """``if discount:`` per line, counted per return flag."""
    li = Tables(spark, sf).lineitem
    t = N.is_truthy("l_discount")
    return li.groupBy("l_returnflag").agg(F.count_if(t).alias("truthy"), F.count_if(~t).alias("falsy"))


@register("f11_position_slice", """
SELECT position, o_custkey, o_orderstatus FROM (
  SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS position, * FROM orders)
WHERE position >= 100 AND position < 120""")
def f11_position_slice(spark, sf):
    """``orders.iloc[100:120, 1:3]`` in o_orderkey order (distributed ordinal,
    no single-task window)."""
    o = Tables(spark, sf).orders
    return O.position_slice(o, ["o_orderkey"], 100, 120, col_start=1, col_stop=3)


@register("f12_label_slice", """
SELECT c_custkey, c_name, c_mktsegment FROM customer
WHERE c_custkey BETWEEN (SELECT min(c_custkey) FROM customer WHERE c_name = 'Customer#000000009')
                    AND (SELECT max(c_custkey) FROM customer WHERE c_name = 'Customer#000000012')""")
def f12_label_slice(spark, sf):
    """``loc['Customer#000000009':'Customer#000000012']``: inclusive, by row
    order, located by label."""
    c = Tables(spark, sf).customer
    return O.label_slice(c, "c_custkey", "c_name", "Customer#000000009", "Customer#000000012",
                         columns=["c_custkey", "c_name", "c_mktsegment"])


@register("f15_empty_slice", """
SELECT o_orderkey, o_totalprice FROM (
  SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS position, *, count(*) OVER () AS n FROM orders)
WHERE position >= n - 1 AND position < n - 2""")
def f15_empty_slice(spark, sf):
    """``orders.iloc[-1:-2]``: an empty range gives an empty table, not an error."""
    o = Tables(spark, sf).orders
    return O.position_slice(o, ["o_orderkey"], -1, -2, columns=["o_orderkey", "o_totalprice"]).drop("position")


@register("f16_head_tail", """
(SELECT 'head' AS part, o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5)
UNION ALL
(SELECT 'tail' AS part, o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 5)""")
def f16_head_tail(spark, sf):
    """``head()`` and ``tail()`` (n = 5) in o_orderkey order: top-k plans."""
    o = Tables(spark, sf).orders.select("o_orderkey", "o_totalprice")
    h = O.head(o, ["o_orderkey"]).select(F.lit("head").alias("part"), "*")
    t = O.tail(o, ["o_orderkey"]).select(F.lit("tail").alias("part"), "*")
    return h.unionByName(t)


# -- C: conditionals -------------------------------------------------------

@register("c3_band_quantity", """
SELECT CASE WHEN l_quantity >= 40 THEN 'bulk' WHEN l_quantity >= 20 THEN 'medium'
            WHEN l_quantity >= 10 THEN 'small' ELSE 'few' END AS band,
       count(*) AS n_lines, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity
FROM lineitem GROUP BY band""")
def c3_band_quantity(spark, sf):
    """if / elif / else banding: first matching branch wins."""
    li = Tables(spark, sf).lineitem
    q = F.col("l_quantity")
    band = (F.when(q >= 40, "bulk").when(q >= 20, "medium").when(q >= 10, "small").otherwise("few"))
    return li.groupBy(band.alias("band")).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(q.cast("decimal(18,2)")).cast("double").alias("quantity"))


@register("c2_if_else", """
SELECT CASE WHEN o_totalprice > 200000 THEN 'high' ELSE 'low' END AS price_class, count(*) AS n_orders
FROM orders GROUP BY price_class""")
def c2_if_else(spark, sf):
    """if / else; a NULL predicate falls to the else branch."""
    o = Tables(spark, sf).orders
    cls = F.when(F.col("o_totalprice") > 200000, "high").otherwise("low")
    return o.groupBy(cls.alias("price_class")).agg(F.count(F.lit(1)).alias("n_orders"))


@register("c5_parity", """
SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'even' ELSE 'odd' END AS parity,
       CAST(count_if(l_partkey % 7 = 0) AS BIGINT) AS partkey_div7, count(*) AS n_lines
FROM lineitem GROUP BY parity""")
def c5_parity(spark, sf):
    """``x % 2 == 0`` and ``n % 7 == 0``."""
    li = Tables(spark, sf).lineitem
    parity = F.when(N.divisible("l_linenumber", 2), "even").otherwise("odd")
    return li.groupBy(parity.alias("parity")).agg(
        F.count_if(N.divisible("l_partkey", 7)).alias("partkey_div7"), F.count(F.lit(1)).alias("n_lines"))


# -- E: arithmetic ---------------------------------------------------------

@register("e1_arithmetic", """
SELECT l_orderkey, l_linenumber, l_quantity + 1 AS plus_one, l_quantity - 1 AS minus_one,
       l_quantity * 2 AS times_two, -l_quantity AS negated, l_extendedprice / l_quantity AS unit_price,
       power(l_quantity, 2) AS squared, round(exp(l_discount), 9) AS exp_discount,
       CAST(ceil(l_extendedprice) AS BIGINT) AS price_ceil, CAST(floor(l_extendedprice) AS BIGINT) AS price_floor
FROM lineitem""")
def e1_arithmetic(spark, sf):
    """``+ - * /``, unary minus, ``**``, ``exp``, ``ceil``, ``floor`` per line."""
    li = Tables(spark, sf).lineitem
    q = F.col("l_quantity")
    return li.select(
        "l_orderkey", "l_linenumber", (q + 1).alias("plus_one"), (q - 1).alias("minus_one"),
        (q * 2).alias("times_two"), (-q).alias("negated"),
        N.true_div(F.col("l_extendedprice"), q).alias("unit_price"),
        F.pow(q, 2).alias("squared"), F.round(F.exp("l_discount"), 9).alias("exp_discount"),
        F.ceil("l_extendedprice").cast("long").alias("price_ceil"),
        F.floor("l_extendedprice").cast("long").alias("price_floor"))


@register("e3_floor_div_mod", """
SELECT l_orderkey, l_linenumber, a, b,
       CASE WHEN b = 0 THEN NULL ELSE CAST(floor(a / b) AS BIGINT) END AS floor_div,
       CASE WHEN b = 0 THEN NULL ELSE CAST(a - b * floor(a / b) AS BIGINT) END AS py_mod
FROM (SELECT l_orderkey, l_linenumber, l_partkey - 1000 AS a, CAST(l_linenumber - 4 AS BIGINT) AS b FROM lineitem)""")
def e3_floor_div_mod(spark, sf):
    """Python ``//`` and ``%`` with negative operands and zero divisors."""
    li = Tables(spark, sf).lineitem
    x = li.select("l_orderkey", "l_linenumber", (F.col("l_partkey") - 1000).alias("a"),
                  (F.col("l_linenumber") - 4).cast("long").alias("b"))
    return x.select("*", N.floor_div("a", "b").alias("floor_div"), N.py_mod("a", "b").alias("py_mod"))


@register("e8_bitwise_bin", """
SELECT l_orderkey, l_linenumber, l_orderkey & 7 AS and_7, l_orderkey | 8 AS or_8, xor(l_orderkey, 5) AS xor_5,
       CASE WHEN l_linenumber - 4 < 0 THEN '-0b' || bin(4 - l_linenumber) ELSE '0b' || bin(l_linenumber - 4) END AS bin_text
FROM lineitem""")
def e8_bitwise_bin(spark, sf):
    """``& | ^`` and Python ``bin()`` text (``-0b11`` for negatives)."""
    li = Tables(spark, sf).lineitem
    k = F.col("l_orderkey")
    return li.select("l_orderkey", "l_linenumber", k.bitwiseAND(7).alias("and_7"), k.bitwiseOR(8).alias("or_8"),
                     k.bitwiseXOR(5).alias("xor_5"), N.bin_text(F.col("l_linenumber") - 4).alias("bin_text"))


@register("e11_yearly_percent_change", """
WITH y AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS order_year,
                  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
           FROM orders GROUP BY 1)
SELECT order_year, total,
       (total - lag(total) OVER (ORDER BY order_year)) / lag(total) OVER (ORDER BY order_year) * 100 AS pct_change
FROM y""")
def e11_yearly_percent_change(spark, sf):
    """``(new - old) / old * 100`` year over year (the window runs over the
    one-row-per-year aggregate, not over orders)."""
    from pyspark.sql import Window
    o = Tables(spark, sf).orders
    y = o.groupBy(F.year("o_orderdate").cast("long").alias("order_year")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))
    prev = F.lag("total").over(Window.orderBy("order_year"))
    return y.select("order_year", "total", N.percent_change(F.col("total"), prev).alias("pct_change"))


@register("c1_if_without_else", """
SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END AS flag, count(*) AS n_orders
FROM orders GROUP BY 1""")
def c1_if_without_else(spark, sf):
    """``if p: flag = 'urgent'`` with no else: other rows get NULL."""
    o = Tables(spark, sf).orders
    return o.groupBy(F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("urgent")).alias("flag")) \
            .agg(F.count(F.lit(1)).alias("n_orders"))


_M10_MAP = ("CASE typeof({c}) WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' "
            "WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(typeof({c})) END")
_M10_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
             "l_returnflag", "l_linestatus", "l_shipdate"]


@register("m10_value_types", " UNION ALL ".join(
    f"SELECT DISTINCT '{c}' AS column_name, {_M10_MAP.format(c=c)} AS value_type FROM lineitem" for c in _M10_COLS))
def m10_value_types(spark, sf):
    """``type(x)`` of the values of each column (``typeof``): a column's values
    all have the schema's type, so each is one row, unless the table is empty."""
    li = Tables(spark, sf).lineitem
    kinds = S.catalogue(spark, {"lineitem": li}).select("column_name", F.col("type").alias("value_type"))
    return kinds.where(li.select(F.lit(1)).limit(1).agg(F.count("*")).scalar() > 0)


# DuckDB's names of Spark's types.
_TYPES_SQL = ("replace(replace(replace(replace(replace(replace(replace(data_type, 'TIMESTAMP', 'timestamp_ntz'), 'BIGINT', 'bigint'), 'INTEGER', 'int'), "
              "'DOUBLE', 'double'), 'VARCHAR', 'string'), 'FLOAT[]', 'array<float>'), 'BOOLEAN', 'boolean')")


@register("m1_catalogue", f"""
SELECT table_name, CAST(ordinal_position - 1 AS INTEGER) AS position, column_name, {_TYPES_SQL} AS type
FROM information_schema.columns WHERE table_name IN ({", ".join(f"'{t}'" for t in TABLE_NAMES)})""")
def m1_catalogue(spark, sf):
    """``df.columns`` and ``df.dtypes`` of every table, a row per column."""
    t = Tables(spark, sf)
    return S.catalogue(spark, {name: getattr(t, name) for name in TABLE_NAMES})


@register("s1_csv_round_trip", """
SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5, text IS NULL AS no_text, CAST(NULL AS VARCHAR) AS corrupt FROM documents""")
def s1_csv_round_trip(spark, sf):
    """``to_csv`` and ``read_csv``: ``documents`` with its line breaks, quotes
    and commas written to the shared folder and read with an explicit schema
    and a column for records that do not fit."""
    d = Tables(spark, sf).documents
    folder = scratch_dir(spark, "csv")
    write_csv(d, folder)
    back = read_csv(spark, folder, d.schema, corrupt_column="corrupt", **CSV_OPTIONS)
    return back.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"), F.col("text").isNull().alias("no_text"), "corrupt")


@register("m5_rename_columns", """
SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment
FROM customer""")
def m5_rename_columns(spark, sf):
    """``df.columns = [...]``: every column renamed at once, by position."""
    return Tables(spark, sf).customer.toDF("id", "name", "nation", "balance", "segment")


@register("m6_row_labels", """
SELECT c_custkey, 'row' || CAST(row_number() OVER (ORDER BY c_custkey) AS VARCHAR) AS label FROM customer""")
def m6_row_labels(spark, sf):
    """``df.index = ['row1', 'row2', ...]``: a label per row from its position
    in key order (a distributed ordinal, not a single-task window)."""
    c = Tables(spark, sf).customer.select("c_custkey")
    pos = O.ordinal(c, ["c_custkey"], name="pos")
    return pos.select("c_custkey", F.concat(F.lit("row"), (F.col("pos") + 1).cast("string")).alias("label"))
