"""dict methods on Spark MAP columns.

Spark raises ``DUPLICATED_MAP_KEY`` when a map would get a key twice (unless
the session's dedup policy is LAST_WIN); Python's dict keeps the last value.
``put`` removes the key before adding it, so it needs no session setting.
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


def get(m, k) -> Column:
    """``d.get(k)``: NULL when absent."""
    return F.try_element_at(_c(m), _c(k))


def put(m, k, v) -> Column:
    """``d[k] = v`` (insert or overwrite)."""
    m, k = _c(m), _c(k)
    return F.map_concat(F.map_filter(m, lambda kk, vv: kk != k), F.create_map(k, _c(v)))


def remove(m, k) -> Column:
    """``del d[k]`` / ``d.pop(k)``."""
    k = _c(k)
    return F.map_filter(_c(m), lambda kk, vv: kk != k)


def from_pairs_last_wins(keys, values) -> Column:
    """``dict(zip(keys, values))``: on repeated keys the last value wins."""
    pairs = F.arrays_zip(_c(keys).alias("k"), _c(values).alias("v"))
    rev = F.reverse(pairs)
    firsts = F.filter(rev, lambda e, i: F.array_position(F.transform(rev, lambda x: x["k"]), e["k"]) == i + 1)
    return F.map_from_entries(F.reverse(firsts))
