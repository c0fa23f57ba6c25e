"""Date helpers for the order/ship date questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def weekday(d) -> Column:
    """Python ``date.weekday()``: Monday = 0 ... Sunday = 6 (Spark
    ``dayofweek`` is Sunday = 1 ... Saturday = 7)."""
    return ((F.dayofweek(_c(d)) + 5) % 7).cast("int")


def is_weekend(d) -> Column:
    return F.dayofweek(_c(d)).isin(1, 7)


def days_between(later, earlier) -> Column:
    """Whole days from ``earlier`` to ``later`` (negative when earlier is later)."""
    return F.datediff(F.to_date(_c(later)), F.to_date(_c(earlier)))


def parse_date(s, fmt: str = "yyyy-MM-dd") -> Column:
    """Text to DATE, NULL on malformed text."""
    return F.try_to_date(_c(s), fmt)


def parse_any(s, patterns) -> Column:
    """Text to DATE by the first of ``patterns`` ((regular expression, format)
    pairs) whose expression the whole text matches; NULL if none does or if
    there is no such day."""
    s, out = _c(s), F.lit(None).cast("date")
    for shape, fmt in reversed(list(patterns)):
        out = F.when(s.rlike(f"\\A(?:{shape})\\z"), parse_date(s, fmt)).otherwise(out)
    return out
