"""Joins with the pandas ``merge`` contract.

Catalyst picks broadcast-hash, shuffle-hash or sort-merge from sizes and AQE
re-plans at runtime from measured sizes, so these functions only state the
logical join; nothing here forces a broadcast.

pandas ``merge`` differences kept here:
* one key column in the output (from the right side for ``how='right'``);
* clashing non-key columns get suffixes ``_x`` / ``_y``;
* NULL keys match each other in pandas; Spark ``=`` does not. ``null_safe=True``
  uses ``<=>`` to get the pandas behaviour;
* pandas keeps the left row order; Spark gives no order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HOW = {"inner": "inner", "left": "left", "right": "right", "outer": "full",
        "full": "full", "left_anti": "left_anti", "left_semi": "left_semi"}


def merge(left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "inner",
          null_safe: bool = False, suffixes: tuple[str, str] = ("_x", "_y"),
          indicator: bool = False) -> DataFrame:
    """``pd.merge(left, right, on=on, how=how, indicator=indicator)``."""
    keys = [on] if isinstance(on, str) else list(on)
    if how not in _HOW:
        raise ValueError(f"how={how!r}")
    jt = _HOW[how]
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    lsel = [F.col(c).alias(c + suffixes[0] if c in clash else c) for c in left.columns]
    rsel = [F.col(c).alias(c + suffixes[1] if c in clash else c) for c in right.columns]
    l = left.select(*lsel)
    r = right.select(*rsel)
    if indicator:
        l = l.withColumn("_gw_l", F.lit(True))
        r = r.withColumn("_gw_r", F.lit(True))
    if jt in ("left_anti", "left_semi"):
        cond = [(l[k].eqNullSafe(r[k]) if null_safe else l[k] == r[k]) for k in keys]
        return l.join(r, cond, jt)
    if not null_safe:
        out = l.join(r, keys, jt)
    else:
        rk = r.select(*[F.col(c).alias("_gw_rk_" + c) if c in keys else F.col(c) for c in r.columns])
        cond = [l[k].eqNullSafe(rk["_gw_rk_" + k]) for k in keys]
        j = l.join(rk, cond, jt)
        keycols = [(F.col("_gw_rk_" + k) if jt == "right" else
                    F.coalesce(F.col(k), F.col("_gw_rk_" + k)) if jt == "full" else F.col(k)).alias(k)
                   for k in keys]
        rest = [c for c in j.columns if c not in keys and not c.startswith("_gw_rk_")]
        out = j.select(*keycols, *rest)
    if indicator:
        out = out.withColumn(
            "_merge",
            F.when(F.col("_gw_l").isNotNull() & F.col("_gw_r").isNotNull(), F.lit("both"))
             .when(F.col("_gw_l").isNotNull(), F.lit("left_only"))
             .otherwise(F.lit("right_only"))).drop("_gw_l", "_gw_r")
    return out


def anti_join(left: DataFrame, right: DataFrame, on: str | Sequence[str], null_safe: bool = False) -> DataFrame:
    """Rows of ``left`` with no match in ``right`` (``_merge == 'left_only'``)."""
    return merge(left, right.select(*([on] if isinstance(on, str) else on)),
                 on, "left_anti", null_safe=null_safe)


def semi_join(left: DataFrame, right: DataFrame, on: str | Sequence[str], null_safe: bool = False) -> DataFrame:
    """Rows of ``left`` with at least one match in ``right``, each once."""
    return merge(left, right.select(*([on] if isinstance(on, str) else on)),
                 on, "left_semi", null_safe=null_safe)
