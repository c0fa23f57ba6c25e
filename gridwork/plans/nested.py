"""Arrays, maps, nested records and JSON (inventory K) on the driver tables.

Lists: each vector's components as whole numbers, an array its row already
holds, accessed and edited with the Python list methods of
``functions.arrays``. Events: the JSON ``props`` text
parsed with a schema, and a per-event MAP edited with ``functions.maps``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwork.functions import arrays as AR
from gridwork.functions import maps as MP
from gridwork.plans.registry import register
from gridwork.sources import Tables


def _lists(spark, sf):
    """Each vector as whole numbers (``parts``) and as nested records with
    their position (``lines``), both arrays that a row already holds."""
    e = Tables(spark, sf).embeddings
    parts = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")))
    lines = F.transform("parts", lambda p, i: F.struct((i + 1).alias("n"), p.alias("p"), (p * 0.5).alias("q")))
    return e.select("vec_id", parts.alias("parts")).select("vec_id", "parts", lines.alias("lines"))


_LISTS_SQL = """(SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS parts FROM embeddings)"""


def _txt(a):
    return F.array_join(a.cast("array<string>"), ",")


@register("k1_list_methods", f"""
SELECT vec_id, CAST(len(parts) AS BIGINT) AS size, parts[-1] AS last_part,
       array_to_string(parts[2:3], ',') AS slice_1_3,
       array_to_string(list_append(parts, 0), ',') AS appended,
       array_to_string(list_concat(parts[1:len(parts) - 1], [0], parts[len(parts):len(parts)]), ',') AS inserted,
       array_to_string(list_concat(parts[1:2], parts[4:len(parts)]), ',') AS popped_2,
       array_to_string(parts[2:len(parts)], ',') AS removed_first,
       array_to_string(list_concat([222], parts[2:len(parts)]), ',') AS replaced_0,
       CAST(list_position(parts, list_max(parts)) - 1 AS BIGINT) AS index_of_max,
       array_to_string(list_reverse(parts), ',') AS reversed,
       array_to_string(list_sort(parts), ',') AS sorted
FROM {_LISTS_SQL}""")
def k1_list_methods(spark, sf):
    """``a[-1]``, ``a[1:3]``, ``append``, ``insert(-1, v)`` (before the last
    item), ``pop(2)``, ``remove(a[0])`` (first match only), ``a[0] = v``,
    ``index``, ``reverse``, ``sort`` on each vector's list."""
    b = _lists(spark, sf)
    p = F.col("parts")
    zero = F.lit(0).cast("long")
    return b.select(
        "vec_id", F.size(p).cast("long").alias("size"), AR.item(p, -1).alias("last_part"),
        _txt(AR.list_slice(p, 1, 3)).alias("slice_1_3"), _txt(F.array_append(p, zero)).alias("appended"),
        _txt(AR.insert_at(p, -1, zero)).alias("inserted"), _txt(AR.pop_at(p, 2)).alias("popped_2"),
        _txt(AR.remove_first(p, AR.item(p, 0))).alias("removed_first"),
        _txt(AR.replace_at(p, 0, F.lit(222).cast("long"))).alias("replaced_0"),
        AR.index_of(p, F.array_max(p)).cast("long").alias("index_of_max"),
        _txt(F.reverse(p)).alias("reversed"), _txt(F.sort_array(p)).alias("sorted"))


@register("k11_nested_access", f"""
SELECT vec_id, parts[1] AS first_part, parts[-1] * 0.5::DOUBLE AS last_quantity, CAST(list_sum(parts) AS DOUBLE) / 2 AS total_quantity
FROM {_LISTS_SQL}""")
def k11_nested_access(spark, sf):
    """``order['lines'][0]['p']``, ``order['lines'][-1]['q']`` on nested
    records, and a reduction over a nested field."""
    b = _lists(spark, sf)
    return b.select("vec_id", AR.item("lines", 0)["p"].alias("first_part"),
                    AR.item("lines", -1)["q"].alias("last_quantity"),
                    F.aggregate("lines.q", F.lit(0.0), lambda acc, x: acc + x).alias("total_quantity"))


@register("k17_json_parse", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
       json_extract_string(props, '$.missing') AS missing
FROM events""")
def k17_json_parse(spark, sf):
    """JSON text to a typed record (``from_json`` with a schema) and a path
    lookup that is NULL when the key is absent."""
    ev = Tables(spark, sf).events
    rec = F.from_json("props", "k BIGINT")
    return ev.select("event_id", rec["k"].alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


@register("k12_map_methods", """
WITH e AS (SELECT event_id, event_type AS t, json_extract_string(props, '$.k') AS k, CAST(user_id AS VARCHAR) AS u FROM events)
SELECT event_id, k AS got_k, CASE WHEN t = 'click' THEN u END AS got_click, array_to_string(list_sort([t, 'k', 'user']), ',') AS keys,
       CASE WHEN t = 'view' THEN 'new' ELSE CAST(NULL AS VARCHAR) END AS seen_view, t = 'error' AS has_error,
       CAST(CASE WHEN t = 'view' THEN 3 ELSE 4 END AS INT) AS size_after_put, CAST(CASE WHEN t = 'signup' THEN 2 ELSE 3 END AS INT) AS size_after_del,
       CASE WHEN t = 'a' THEN t ELSE u END AS last_wins, CASE WHEN t = 'click' THEN k ELSE 'first' END AS click_wins
FROM e""")
def k12_map_methods(spark, sf):
    """``d.get``, ``k in d``, ``d.keys()``, ``d[k] = v`` (overwrite in some
    rows, insert in others), ``del d[k]``, and ``dict(pairs)`` where a repeated
    key keeps its last value, on a MAP with a key of the row's own."""
    ev = Tables(spark, sf).events
    k, t, u = F.from_json("props", "k BIGINT")["k"].cast("string"), F.col("event_type"), F.col("user_id").cast("string")
    m = F.create_map(t, u, F.lit("k"), k, F.lit("user"), u)
    put = MP.put(m, F.lit("view"), F.lit("new"))
    pairs = MP.from_pairs_last_wins(F.array(F.lit("a"), F.lit("click"), F.lit("a"), t), F.array(t, F.lit("first"), u, k))
    return ev.select(
        "event_id", MP.get(m, F.lit("k")).alias("got_k"), MP.get(m, F.lit("click")).alias("got_click"),
        F.array_join(F.array_sort(F.map_keys(m)), ",").alias("keys"),
        F.when(F.map_contains_key(m, F.lit("view")), MP.get(put, F.lit("view"))).alias("seen_view"),
        F.map_contains_key(m, F.lit("error")).alias("has_error"), F.size(put).alias("size_after_put"),
        F.size(MP.remove(m, F.lit("signup"))).alias("size_after_del"),
        MP.get(pairs, F.lit("a")).alias("last_wins"), MP.get(pairs, F.lit("click")).alias("click_wins"))


@register("k18_explode_baskets", """
SELECT vec_id, CAST(i AS INTEGER) AS n, parts[i] AS p FROM (SELECT vec_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM """ + _LISTS_SQL + ")")
def k18_explode_lists(spark, sf):
    """Nested lists back to rows (``explode`` / ``inline``)."""
    b = _lists(spark, sf)
    return b.select("vec_id", F.inline("lines")).select("vec_id", "n", "p")
