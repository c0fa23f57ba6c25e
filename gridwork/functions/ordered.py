"""dict in insertion order: an array of (key, value) entries with unique keys.

Spark's MAP promises no order of its entries; Python's dict keeps the order in
which keys were first inserted, through overwriting (the place stays) and
deleting (a key inserted again goes to the end).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _entry(k, v) -> Column:
    return F.struct(_c(k).alias("key"), _c(v).alias("value"))


def empty(key_type: str = "string", value_type: str = "string") -> Column:
    """``{}``"""
    return F.array().cast(f"array<struct<key:{key_type},value:{value_type}>>")


def put(d, k, v) -> Column:
    """``d[k] = v``: the value of a known key changes in its place, a new key
    goes to the end."""
    d, k = _c(d), _c(k)
    known = F.exists(d, lambda e: e["key"] == k)
    return F.when(known, F.transform(d, lambda e: F.when(e["key"] == k, _entry(k, v)).otherwise(e))).otherwise(F.array_append(d, _entry(k, v)))


def delete(d, k) -> Column:
    """``d.pop(k, None)``"""
    k = _c(k)
    return F.filter(_c(d), lambda e: e["key"] != k)


def get(d, k) -> Column:
    """``d.get(k)``: NULL when absent."""
    k = _c(k)
    return F.get(F.filter(_c(d), lambda e: e["key"] == k), F.lit(0))["value"]


def from_pairs(pairs, key_type: str = "string", value_type: str = "string") -> Column:
    """``dict(pairs)`` of an array of (key, value) structs: a repeated key
    keeps its first place and its last value."""
    return F.reduce(_c(pairs), empty(key_type, value_type), lambda d, e: put(d, e["key"], e["value"]))


def keys(d) -> Column:
    """``list(d.keys())``"""
    return _c(d).getField("key")


def values(d) -> Column:
    """``list(d.values())``"""
    return _c(d).getField("value")


def items(d) -> Column:
    """``list(d.items())``: the entries themselves."""
    return _c(d)
