"""Python list/set methods on Spark array columns.

Spark arrays are 1-based and ``element_at`` raises out of range under ANSI;
Python lists are 0-based with negative indexing. These helpers take Python
positions and give NULL (never an error) where Python would raise.
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


def _pos(a: Column, p) -> Column:
    """Normalise a Python position (may be negative) to 0-based."""
    p = _c(p)
    return F.when(p < 0, F.size(a) + p).otherwise(p)


def item(a, i) -> Column:
    """``a[i]``; NULL out of range."""
    a, i = _c(a), _c(i)
    return F.try_element_at(a, F.when(i >= 0, i + 1).otherwise(i))


def list_slice(a, start: int | None = None, stop: int | None = None) -> Column:
    """``a[start:stop]`` with negative bounds and clipping."""
    a = _c(a)
    n = F.size(a)

    def norm(b, default):
        if b is None:
            return default
        return F.greatest(n + F.lit(b), F.lit(0)) if b < 0 else F.least(F.lit(b), n)

    lo, hi = norm(start, F.lit(0)), norm(stop, n)
    return F.filter(a, lambda x, i: (i >= lo) & (i < hi))


def pop_at(a, p) -> Column:
    """The list after ``a.pop(p)`` (the popped item is ``item(a, p)``)."""
    a = _c(a)
    q = _pos(a, p)
    return F.filter(a, lambda x, i: i != q)


def remove_first(a, v) -> Column:
    """``a.remove(v)``: only the first match goes (``array_remove`` drops all);
    unchanged when ``v`` is absent (Python raises)."""
    a = _c(a)
    first = F.array_position(a, _c(v)) - 1
    return F.filter(a, lambda x, i: i != first)


def insert_at(a, p, v) -> Column:
    """``a.insert(p, v)``: negative ``p`` counts from the end and goes *before*
    that item; positions past either end clip."""
    a = _c(a)
    n = F.size(a)
    p = _c(p)
    q = F.when(p < 0, F.greatest(n + p, F.lit(0))).otherwise(F.least(p, n))
    return F.concat(F.filter(a, lambda x, i: i < q), F.array(_c(v)), F.filter(a, lambda x, i: i >= q))


def replace_at(a, p, v) -> Column:
    """``a[p] = v``."""
    a = _c(a)
    q = _pos(a, p)
    return F.transform(a, lambda x, i: F.when(i == q, _c(v)).otherwise(x))


def index_of(a, v) -> Column:
    """``a.index(v)``: first 0-based position; NULL when absent."""
    p = F.array_position(_c(a), _c(v))
    return F.when(p > 0, p - 1)


def count_of(a, v) -> Column:
    """``a.count(v)``."""
    return F.size(F.filter(_c(a), lambda x: x == _c(v)))


def symmetric_difference(x, y) -> Column:
    """``set(x) ^ set(y)``."""
    x, y = _c(x), _c(y)
    return F.array_union(F.array_except(x, y), F.array_except(y, x))


def is_subset(x, y) -> Column:
    """``set(x) <= set(y)``."""
    return F.size(F.array_except(_c(x), _c(y))) == 0


def is_disjoint(x, y) -> Column:
    """``set(x).isdisjoint(y)`` (NULL items are ignored)."""
    x, y = _c(x), _c(y)
    return F.size(F.array_intersect(x, y)) == 0


def add_item(a, v) -> Column:
    """``s.add(v)`` on a set-like array."""
    return F.array_union(_c(a), F.array(_c(v)))
