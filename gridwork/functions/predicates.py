"""pandas comparison rules on nullable columns.

Spark uses three-valued logic: a comparison with NULL is NULL and a filter
drops the row. pandas compares a missing value (NaN) as False, so ``=``,
``<`` and ``>`` keep the same rows in both, but ``!=`` and negated masks
(``~mask``, ``~s.isin(...)``) keep the missing row in pandas and drop it in
Spark. These helpers give the pandas answer as a non-NULL boolean.
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


def pd_eq(a, b) -> Column:
    """``a == b`` with a missing side giving False."""
    return F.coalesce(_c(a) == _c(b), F.lit(False))


def pd_ne(a, b) -> Column:
    """``a != b`` with a missing side giving True (NaN != x in pandas)."""
    return ~pd_eq(a, b)


def pd_isin(a, values) -> Column:
    """``s.isin(values)``: False for a missing value."""
    return F.coalesce(_c(a).isin(list(values)), F.lit(False))


def pd_not_isin(a, values) -> Column:
    """``~s.isin(values)``: True for a missing value (Spark ``NOT IN`` gives
    NULL there and drops the row)."""
    return ~pd_isin(a, values)


def pd_mask_not(mask) -> Column:
    """``~mask`` where a NULL mask entry counts as False first."""
    return ~F.coalesce(_c(mask), F.lit(False))
