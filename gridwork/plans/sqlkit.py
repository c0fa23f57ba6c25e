"""Fragments for the DuckDB oracle SQL.

DuckDB and Spark differ in a few result rules (see the README): DuckDB's
average of a DECIMAL is a DOUBLE, Spark's is a DECIMAL rounded half-up at
scale + 4. ``avg_dec`` reproduces the Spark rule with integer arithmetic so
both sides give the same double.
"""


def dec(expr: str, scale: int = 2, precision: int = 18) -> str:
    return f"CAST({expr} AS DECIMAL({precision},{scale}))"


def avg_dec(expr_dec: str, scale: int) -> str:
    """Half-up average of a DECIMAL expression with ``scale`` digits, at scale
    ``scale + 4``, returned as DOUBLE (Spark's ``avg`` on decimals)."""
    s = f"CAST(sum({expr_dec}) * {10 ** scale} AS HUGEINT)"
    n = f"count({expr_dec})"
    return (f"(CAST(sign({s}) * ((2 * abs({s}) * 10000 + {n}) // (2 * {n})) AS DOUBLE)"
            f" / {10 ** (scale + 4)}.0)")


SALES = "CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))"
COST = "CAST(l_quantity AS DECIMAL(18,2)) * CAST(p_retailprice AS DECIMAL(18,2))"
PROFIT = f"({SALES} - {COST})"

# Common table expressions matching plans.star.
LINES_CTE = f"""lines AS (
  SELECT l_orderkey, l_partkey, l_quantity, l_discount, l_shipdate, p_type, p_brand,
         {SALES} AS sales, {PROFIT} AS profit
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
CUST_CTE = """cust AS (
  SELECT c_custkey, c_mktsegment, n_nationkey, n_name, r_name
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
ORDERS_CTE = f"""ofacts AS (
  SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority, sum(sales) AS sales, sum(profit) AS profit,
         sum(CAST(l_quantity AS DECIMAL(18,2))) AS quantity, count(*) AS n_lines,
         sum(CAST(l_discount AS DECIMAL(4,2))) AS discount_sum
  FROM lines JOIN orders ON l_orderkey = o_orderkey
  GROUP BY o_orderkey, o_custkey, o_orderdate, o_orderpriority),
oc AS (SELECT * FROM ofacts JOIN cust ON o_custkey = c_custkey)"""
