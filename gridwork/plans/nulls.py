"""Missing-value queries (inventory N, A23) on ``events``.

The driver tables hold no NULLs, so ``events_with_gaps`` makes some: the
``value`` of error events and the ``props`` number ``k`` when it ends in 0 are
set missing. ``(user_id, ts)`` is unique, so it is a total order for fills.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwork.operators import aggregate as AG
from gridwork.operators import nulls as NL
from gridwork.plans.registry import register
from gridwork.plans.sqlkit import avg_dec
from gridwork.sources import Tables

_GAPS_SQL = """(SELECT event_id, user_id, ts, event_type,
        CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value,
        CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 = 0 THEN NULL
             ELSE CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS k
 FROM events)"""


def events_with_gaps(spark, sf) -> DataFrame:
    ev = Tables(spark, sf).events
    k = F.get_json_object("props", "$.k")
    return ev.select(
        "event_id", "user_id", "ts", "event_type",
        F.when(F.col("event_type") == "error", F.lit(None)).otherwise(F.col("value")).alias("value"),
        F.when(k.cast("long") % 10 == 0, F.lit(None)).otherwise(k.cast("double")).alias("k"))


@register("a23_null_counts", f"""
WITH g AS {_GAPS_SQL}
SELECT 'event_id' AS column_name, 'bigint' AS dtype, CAST(count_if(event_id IS NULL) AS BIGINT) AS null_count FROM g
UNION ALL SELECT 'user_id', 'bigint', CAST(count_if(user_id IS NULL) AS BIGINT) FROM g
UNION ALL SELECT 'ts', 'timestamp_ntz', CAST(count_if(ts IS NULL) AS BIGINT) FROM g
UNION ALL SELECT 'event_type', 'string', CAST(count_if(event_type IS NULL) AS BIGINT) FROM g
UNION ALL SELECT 'value', 'double', CAST(count_if(value IS NULL OR isnan(value)) AS BIGINT) FROM g
UNION ALL SELECT 'k', 'double', CAST(count_if(k IS NULL OR isnan(k)) AS BIGINT) FROM g""")
def a23_null_counts(spark, sf):
    """``df.isna().sum()`` with the column types, one aggregate pass."""
    return AG.null_counts(events_with_gaps(spark, sf))


@register("n1_fill_mean", f"""
WITH g AS {_GAPS_SQL}
SELECT event_id, COALESCE(value, (SELECT {avg_dec('CAST(value AS DECIMAL(18,2))', 2)} FROM g)) AS value
FROM g""")
def n1_fill_mean(spark, sf):
    """``df['value'].fillna(df['value'].mean())`` (mean of the present values)."""
    g = events_with_gaps(spark, sf).select("event_id", "value")
    return NL.fill_mean(g, ["value"], decimal_scale=2)


@register("n2_fill_all_means", f"""
WITH g AS {_GAPS_SQL}
SELECT event_id, COALESCE(value, (SELECT {avg_dec('CAST(value AS DECIMAL(18,2))', 2)} FROM g)) AS value,
       COALESCE(k, (SELECT {avg_dec('CAST(k AS DECIMAL(18,2))', 2)} FROM g)) AS k
FROM g""")
def n2_fill_all_means(spark, sf):
    """Every numeric column filled with its own mean, all means from one
    aggregate (not a job per column)."""
    g = events_with_gaps(spark, sf).select("event_id", "value", "k")
    return NL.fill_mean(g, ["value", "k"], decimal_scale=2)


@register("n3_bfill_by_user", f"""
WITH g AS {_GAPS_SQL}
SELECT event_id, first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts
       ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value
FROM g""")
def n3_bfill_by_user(spark, sf):
    """``bfill()`` per user in time order; trailing gaps stay NULL."""
    g = events_with_gaps(spark, sf).select("event_id", "user_id", "ts", "value")
    return NL.bfill(g, ["value"], ["ts"], ["user_id"]).select("event_id", "value")


@register("n4_ffill_by_user", f"""
WITH g AS {_GAPS_SQL}
SELECT event_id, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value,
       last_value(k IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k
FROM g""")
def n4_ffill_by_user(spark, sf):
    """``ffill()`` per user in time order; leading gaps stay NULL."""
    g = events_with_gaps(spark, sf).select("event_id", "user_id", "ts", "value", "k")
    return NL.ffill(g, ["value", "k"], ["ts"], ["user_id"]).select("event_id", "value", "k")


@register("n4_ffill_global", f"""
WITH g AS {_GAPS_SQL}
SELECT event_id, last_value(value IGNORE NULLS) OVER (ORDER BY ts, event_id
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
FROM g""")
def n4_ffill_global(spark, sf):
    """``ffill()`` down the whole table in time order: no key at all, still
    spread over all tasks (range chunks plus carried values)."""
    g = events_with_gaps(spark, sf).select("event_id", "ts", "value")
    return NL.ffill(g, ["value"], ["ts", "event_id"]).select("event_id", "value")


@register("n5_dropna_any", f"""
WITH g AS {_GAPS_SQL}
SELECT event_id, value, k FROM g WHERE value IS NOT NULL AND NOT isnan(value) AND k IS NOT NULL AND NOT isnan(k)""")
def n5_dropna_any(spark, sf):
    g = events_with_gaps(spark, sf).select("event_id", "value", "k")
    return NL.dropna(g, "any")


@register("n6_dropna_all", f"""
WITH g AS {_GAPS_SQL}
SELECT event_id, value, k FROM g WHERE (value IS NOT NULL AND NOT isnan(value)) OR (k IS NOT NULL AND NOT isnan(k))""")
def n6_dropna_all(spark, sf):
    """``dropna(how='all')`` over the two gap columns."""
    g = events_with_gaps(spark, sf).select("event_id", "value", "k")
    return NL.dropna(g, "all", subset=["value", "k"])


@register("f5_pandas_comparisons", f"""
WITH g AS {_GAPS_SQL}
SELECT event_type, count(*) FILTER (WHERE value <> 50) AS sql_ne,
       count(*) FILTER (WHERE value IS DISTINCT FROM 50) AS pandas_ne,
       count(*) FILTER (WHERE k NOT IN (1, 2, 3)) AS sql_not_in,
       count(*) FILTER (WHERE coalesce(k NOT IN (1, 2, 3), true)) AS pandas_not_in
FROM g GROUP BY event_type""")
def f5_pandas_comparisons(spark, sf):
    """``!=`` and ``~isin`` on columns with gaps: SQL drops the missing rows,
    pandas counts them as not equal; both answers side by side."""
    from gridwork.functions import predicates as P
    g = events_with_gaps(spark, sf)
    return g.groupBy("event_type").agg(
        F.count_if(F.col("value") != 50).alias("sql_ne"), F.count_if(P.pd_ne("value", 50)).alias("pandas_ne"),
        F.count_if(~F.col("k").isin(1, 2, 3)).alias("sql_not_in"),
        F.count_if(P.pd_not_isin("k", [1, 2, 3])).alias("pandas_not_in"))
