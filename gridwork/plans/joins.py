"""Joins with the ``merge`` contract (inventory J) on the driver tables.

documents x labels: 1,000 documents, 399 labelled at sf0.01, so left, right,
indicator, anti and semi joins all have both matched and unmatched rows.
The planner chooses the physical join from sizes (AQE broadcasts a side only
when its measured size is under the threshold, otherwise sort-merge).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwork.operators import joins as J
from gridwork.plans.registry import register
from gridwork.sources import Tables


@register("j1_join_inner", """
SELECT o_orderkey, custkey, c_mktsegment, o_totalprice
FROM (SELECT o_orderkey, o_custkey AS custkey, o_totalprice FROM orders)
JOIN (SELECT c_custkey AS custkey, c_mktsegment FROM customer) USING (custkey)""")
def j1_join_inner(spark, sf):
    """``pd.merge(orders, customer, on='custkey', how='inner')``."""
    t = Tables(spark, sf)
    o = t.orders.select("o_orderkey", F.col("o_custkey").alias("custkey"), "o_totalprice")
    c = t.customer.select(F.col("c_custkey").alias("custkey"), "c_mktsegment")
    return J.merge(o, c, "custkey", "inner").select("o_orderkey", "custkey", "c_mktsegment", "o_totalprice")


@register("j2_join_left", """
SELECT d.doc_id, d.lang, l.quality, l.toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def j2_join_left(spark, sf):
    """``how='left'``: every document, label columns NULL when unlabelled."""
    t = Tables(spark, sf)
    return J.merge(t.documents.select("doc_id", "lang"), t.labels, "doc_id", "left")


@register("j3_join_right", """
SELECT d.doc_id, l.quality, d.source
FROM labels l RIGHT JOIN documents d ON d.doc_id = l.doc_id""")
def j3_join_right(spark, sf):
    """``pd.merge(labels, documents, how='right')``: the key comes from the
    right side, so unmatched documents keep their id."""
    t = Tables(spark, sf)
    return J.merge(t.labels.select("doc_id", "quality"), t.documents.select("doc_id", "source"),
                   "doc_id", "right")


@register("j4_join_indicator", """
SELECT d.doc_id, l.toxic,
       CASE WHEN l.doc_id IS NOT NULL THEN 'both' ELSE 'left_only' END AS _merge
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def j4_join_indicator(spark, sf):
    """``merge(..., how='left', indicator=True)``: a ``_merge`` column with
    ``both`` / ``left_only``."""
    t = Tables(spark, sf)
    return J.merge(t.documents.select("doc_id"), t.labels.select("doc_id", "toxic"),
                   "doc_id", "left", indicator=True)


@register("j4_indicator_counts", """
SELECT CASE WHEN l.doc_id IS NOT NULL THEN 'both' ELSE 'left_only' END AS _merge, count(*) AS n
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""")
def j4_indicator_counts(spark, sf):
    """How many rows of each ``_merge`` kind (the usual follow-up)."""
    return j4_join_indicator(spark, sf).groupBy("_merge").agg(F.count(F.lit(1)).alias("n"))


@register("j7_anti_unlabelled", """
SELECT doc_id, lang, n_chars FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def j7_anti_unlabelled(spark, sf):
    """Rows with ``_merge == 'left_only'`` as an anti join (no right columns
    are carried)."""
    t = Tables(spark, sf)
    return J.anti_join(t.documents.select("doc_id", "lang", "n_chars"), t.labels, "doc_id")


@register("j8_semi_labelled", """
SELECT doc_id, lang FROM documents d
WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def j8_semi_labelled(spark, sf):
    """Documents that have a label, each once (a semi join)."""
    t = Tables(spark, sf)
    return J.semi_join(t.documents.select("doc_id", "lang"), t.labels, "doc_id")


@register("j_null_safe_keys", """
WITH e AS (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS kind FROM events),
     k AS (SELECT DISTINCT CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS kind,
                  CASE WHEN event_type = 'error' THEN 'unknown' ELSE upper(event_type) END AS label FROM events)
SELECT e.event_id, e.kind, k.label FROM e JOIN k ON e.kind IS NOT DISTINCT FROM k.kind""")
def j_null_safe_keys(spark, sf):
    """pandas matches missing keys to each other; ``null_safe=True`` does the
    same with ``<=>`` (a plain ``=`` would drop the NULL-keyed events)."""
    ev = Tables(spark, sf).events
    kind = F.when(F.col("event_type") == "error", F.lit(None)).otherwise(F.col("event_type"))
    e = ev.select("event_id", kind.alias("kind"))
    k = ev.select(kind.alias("kind"), F.when(F.col("event_type") == "error", F.lit("unknown"))
                  .otherwise(F.upper("event_type")).alias("label")).distinct()
    return J.merge(e, k, "kind", "inner", null_safe=True)
