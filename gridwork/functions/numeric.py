"""Python arithmetic rules on Spark columns.

Spark ``div`` and ``%`` truncate toward zero (``-7 div 3 = -2``, ``-7 % 3 =
-1``); Python floors (``-7 // 3 = -3``, ``-7 % 3 = 2``); ``pmod`` differs from
Python for a negative divisor (``pmod(7, -3) = 1``, Python ``7 % -3 = -2``).
A zero divisor gives NULL here (Python raises, ANSI Spark raises).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def py_mod(a, b, integral: bool = True) -> Column:
    """Python ``a % b``: the result takes the divisor's sign."""
    a, b = _c(a), _c(b)
    if not integral:
        return a - b * F.floor(F.try_divide(a, b))
    a, b = a.cast("long"), b.cast("long")
    r = F.try_mod(a, b)
    return F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r)


def floor_div(a, b, integral: bool = True) -> Column:
    """Python ``a // b``. Integral inputs use exact integer arithmetic (the
    remainder is taken off first, so the division is exact); otherwise
    ``floor(a / b)`` as a double."""
    a, b = _c(a), _c(b)
    if not integral:
        return F.floor(F.try_divide(a, b)).cast("double")
    a, b = a.cast("long"), b.cast("long")
    return F.try_divide((a - py_mod(a, b)).cast("decimal(20,0)"), b.cast("decimal(20,0)")).cast("long")


def bin_text(x) -> Column:
    """Python ``bin(x)``: ``0b101`` and ``-0b101`` (Spark ``bin`` has no
    prefix and writes negatives as 64-bit two's complement)."""
    x = _c(x).cast("long")
    return F.when(x < 0, F.concat(F.lit("-0b"), F.bin(-x))).otherwise(F.concat(F.lit("0b"), F.bin(x)))


def true_div(a, b) -> Column:
    """``a / b`` giving NULL for a zero divisor instead of raising."""
    return F.try_divide(_c(a), _c(b))


def percent_change(new, old) -> Column:
    """``(new - old) / old * 100``; NULL when ``old`` is 0."""
    new, old = _c(new), _c(old)
    return F.try_divide(new - old, old) * F.lit(100)


def is_truthy(x, kind: str = "number") -> Column:
    """Python truthiness of a scalar column: False for NULL/None and for 0
    (``kind='number'``) or '' (``kind='string'``)."""
    x = _c(x)
    falsy = (x == F.lit("")) if kind == "string" else (x == F.lit(0))
    return F.coalesce(~falsy, F.lit(False))


def divisible(x, k) -> Column:
    """``x % k == 0`` (parity for k=2)."""
    return py_mod(x, k) == 0
