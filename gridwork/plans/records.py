"""Records whose shape differs by row (VARIANT), dicts in insertion order, and
dates found in text."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwork.functions import dates as DT
from gridwork.functions import ordered as OD
from gridwork.functions import regex as RX
from gridwork.plans.registry import register
from gridwork.sources import Tables

# -- K11, M10: irregular records ---------------------------------------------

# Each event as a JSON text of its own depth and types.
_EVENT_JSON_SQL = """CASE event_type
  WHEN 'view' THEN props
  WHEN 'click' THEN concat('{"k": "', json_extract_string(props, '$.k'), '", "at": {"user": ', user_id, '}}')
  WHEN 'purchase' THEN concat('{"k": ', json_extract_string(props, '$.k'), ', "lines": [{"sku": "s', user_id, '", "n": 1}, {"sku": "t", "n": ', event_id, '}]}')
  WHEN 'error' THEN concat('[', json_extract_string(props, '$.k'), ', [', user_id, ', "failed"]]')
  ELSE concat('"', event_type, '"') END"""
# JSON's type names as the variant's.
_KIND_SQL = """CASE json_type({0}) WHEN 'OBJECT' THEN 'OBJECT' WHEN 'ARRAY' THEN 'ARRAY' WHEN 'VARCHAR' THEN 'STRING' WHEN 'NULL' THEN 'VOID'
  WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'BIGINT' THEN 'BIGINT' END"""


def _kind(v):
    """Outermost type of a variant's value."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


@register("k11_irregular_records", f"""
SELECT event_id, {_KIND_SQL.format("j")} AS kind, {_KIND_SQL.format("json_extract(j, '$.k')")} AS k_kind,
       TRY_CAST(json_extract_string(j, '$.k') AS BIGINT) AS k, CAST(json_extract_string(j, '$.at.user') AS BIGINT) AS at_user,
       json_extract_string(j, '$.lines[0].sku') AS first_sku, CAST(json_extract_string(j, '$.lines[1].n') AS BIGINT) AS last_n,
       CAST(json_extract_string(j, '$[0]') AS BIGINT) AS first_item, json_extract_string(j, '$[1][1]') AS inner_text
FROM (SELECT event_id, CAST({_EVENT_JSON_SQL} AS JSON) AS j FROM events)""")
def k11_irregular_records(spark, sf):
    """``record['at']['user']``, ``record['lines'][1]['n']``, ``record[1][1]``
    and ``type(record['k'])`` on values of which no two kinds have the same
    depth: one VARIANT column, NULL where a row has no such path."""
    ev = Tables(spark, sf).events
    k, user = F.get_json_object("props", "$.k"), F.col("user_id").cast("string")
    kind = F.col("event_type")
    text = (F.when(kind == "view", F.col("props"))
            .when(kind == "click", F.concat(F.lit('{"k": "'), k, F.lit('", "at": {"user": '), user, F.lit("}}")))
            .when(kind == "purchase", F.concat(F.lit('{"k": '), k, F.lit(', "lines": [{"sku": "s'), user, F.lit('", "n": 1}, {"sku": "t", "n": '),
                                               F.col("event_id").cast("string"), F.lit("}]}")))
            .when(kind == "error", F.concat(F.lit("["), k, F.lit(", ["), user, F.lit(', "failed"]]')))
            .otherwise(F.concat(F.lit('"'), kind, F.lit('"'))))
    v = F.col("v")
    at = lambda path, kind: F.try_variant_get(v, path, kind)
    return ev.select("event_id", F.parse_json(text).alias("v")).select(
        "event_id", _kind(v).alias("kind"), _kind(F.variant_get(v, "$.k", "variant")).alias("k_kind"), at("$.k", "bigint").alias("k"),
        at("$.at.user", "bigint").alias("at_user"), at("$.lines[0].sku", "string").alias("first_sku"), at("$.lines[1].n", "bigint").alias("last_n"),
        at("$[0]", "bigint").alias("first_item"), at("$[1][1]", "string").alias("inner_text"))


@register("k11_depth_by_row", """
SELECT conv_id, turn, length(text) AS chars, CASE WHEN conv_id % 2 = 0 THEN role END AS named FROM conversations WHERE text IS NOT NULL""")
def k11_depth_by_row(spark, sf):
    """Lists nested to different depth: ``[role, [[turn, chars]]]`` in every
    other conversation, ``[[turn, chars]]`` in the rest; the number is read by
    whichever path the row has."""
    cv = Tables(spark, sf).conversations.where(F.col("text").isNotNull())
    pair = F.concat(F.lit("[["), F.col("turn").cast("string"), F.lit(", "), F.length("text").cast("string"), F.lit("]]"))
    text = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("["), F.to_json(F.array("role")), F.lit(","), pair, F.lit("]"))).otherwise(pair)
    v = F.col("v")
    cv = cv.select("conv_id", "turn", F.parse_json(text).alias("v"))
    return cv.select("conv_id", "turn", F.coalesce(F.try_variant_get(v, "$[1][0][1]", "bigint"), F.try_variant_get(v, "$[0][1]", "bigint")).alias("chars"),
                     F.try_variant_get(v, "$[0][0]", "string").alias("named")).withColumn("named", F.when(~F.col("named").rlike("^[0-9]+$"), F.col("named")))


# -- K13: keys, values, items in insertion order --------------------------------

@register("k13_ordered_items", """
WITH e AS (SELECT event_id, unnest([event_type, 'k', 'u' || user_id % 3, 'view', 'u1']) AS key,
    unnest([CAST(event_id AS VARCHAR), json_extract_string(props, '$.k'), 'a', 'b', 'c']) AS value, unnest(range(5)) AS place FROM events),
d AS (SELECT event_id, key, min(place) AS place, arg_max(value, place) AS value FROM e GROUP BY event_id, key),
p AS (SELECT event_id, key, value, place FROM d WHERE key NOT IN ('error', 'click')
  UNION ALL SELECT event_id, 'click', 'put', coalesce(max(place) FILTER (key = 'click'), 8) FROM d GROUP BY event_id
  UNION ALL SELECT event_id, 'error', 'again', 9 FROM d GROUP BY event_id)
SELECT event_id, string_agg(key, ',' ORDER BY place) AS keys, string_agg(value, ',' ORDER BY place) AS "values",
       string_agg(key || '=' || value, ';' ORDER BY place) AS items, max(value) FILTER (key = 'u1') AS got_u1, count(*) AS size
FROM p GROUP BY event_id""")
def k13_ordered_items(spark, sf):
    """``d.keys()``, ``d.values()`` and ``d.items()`` in the order of first
    insertion, after ``dict(pairs)`` with keys that repeat in some rows, a
    ``d['click'] = ...`` that overwrites or appends, and a ``pop`` and new
    insertion of ``'error'``."""
    ev = Tables(spark, sf).events
    pair = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    pairs = F.array(pair(F.col("event_type"), F.col("event_id").cast("string")), pair(F.lit("k"), F.get_json_object("props", "$.k")),
                    pair(F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")), F.lit("a")), pair(F.lit("view"), F.lit("b")), pair(F.lit("u1"), F.lit("c")))
    # a projection a step, so that no step is written out twice in the next one
    d = ev.select("event_id", OD.from_pairs(pairs).alias("d"))
    for step in (lambda d: OD.put(d, F.lit("click"), F.lit("put")), lambda d: OD.delete(d, F.lit("error")), lambda d: OD.put(d, F.lit("error"), F.lit("again"))):
        d = d.withColumn("d", step("d"))
    items = F.transform(OD.items("d"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return d.select("event_id", F.array_join(OD.keys("d"), ",").alias("keys"), F.array_join(OD.values("d"), ",").alias("values"),
                    F.array_join(items, ";").alias("items"), OD.get("d", F.lit("u1")).alias("got_u1"), F.size("d").cast("long").alias("size"))


# -- dates in text ---------------------------------------------------------------

# Our choice of shapes: (regular expression, Spark's format), tried in this order.
DATES = [(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", "yyyy-MM-dd"), (r"[0-9]{2}/[0-9]{2}/[0-9]{4}", "dd/MM/yyyy"), (r"[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{2,4}", "d.M.yyyy"),
         (r"[A-Z][a-z]{2,8} [0-9]{1,2}, [0-9]{4}", "MMMM d, yyyy")]
_ANY = "|".join(shape for shape, _ in DATES)
_DATE_SQL = """CASE WHEN m LIKE '%-%' THEN CAST(try_strptime(m, '%Y-%m-%d') AS DATE) WHEN m LIKE '%/%' THEN CAST(try_strptime(m, '%d/%m/%Y') AS DATE)
  WHEN m LIKE '%,%' THEN CAST(try_strptime(m, '%B %d, %Y') AS DATE) WHEN regexp_full_match(m, '.*[.][0-9]{4}') THEN CAST(try_strptime(m, '%d.%m.%Y') AS DATE) END"""


@register("d1_dates_in_documents", f"""
SELECT doc_id, count(m) AS n_found, count(d) AS n_dates, count(m) - count(d) AS n_bad, strftime(min(d), '%Y-%m-%d') AS first_date
FROM (SELECT doc_id, m, {_DATE_SQL} AS d FROM (SELECT doc_id, unnest(CASE WHEN len(l) > 0 THEN l ELSE [NULL] END) AS m
  FROM (SELECT doc_id, regexp_extract_all(text, '{_ANY}') AS l FROM documents))) GROUP BY doc_id""")
def d1_dates_in_documents(spark, sf):
    """Whatever looks like a date in a document, as DATE by the format it is
    written in; such as are no day of the calendar (parts of an address, say)
    are counted as bad."""
    d = Tables(spark, sf).documents.select("doc_id", RX.findall("text", _ANY).alias("found"))
    d = d.select("doc_id", "found", F.transform("found", lambda m: DT.parse_any(m, DATES)).alias("dates"))
    good = F.filter("dates", lambda x: x.isNotNull())
    return d.select("doc_id", F.size("found").cast("long").alias("n_found"), F.size(good).cast("long").alias("n_dates"),
                    (F.size("found") - F.size(good)).cast("long").alias("n_bad"), F.array_min("dates").cast("string").alias("first_date"))


@register("d2_dates_in_order_notes", f"""
WITH n AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, 'on %Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y, late')
    WHEN 2 THEN strftime(o_orderdate, 'due %B %-d, %Y.') WHEN 3 THEN strftime(o_orderdate, '%Y-%m-') || (20 + o_orderkey % 13)
    ELSE strftime(o_orderdate, '%-d.%-m.%Y or %d/%m/%Y') END AS note FROM orders),
f AS (SELECT o_orderkey, unnest(regexp_extract_all(note, '{_ANY}')) AS m FROM n)
SELECT o_orderkey, m AS found, strftime({_DATE_SQL}, '%Y-%m-%d') AS date, ({_DATE_SQL}) IS NULL AS bad FROM f""")
def d2_dates_in_order_notes(spark, sf):
    """Notes of orders in five ways of writing, a fifth of them with days that
    some months lack, some with two dates: a row per date found."""
    o = Tables(spark, sf).orders.select("o_orderkey", "o_orderdate")
    at = lambda fmt: F.date_format("o_orderdate", fmt)
    way = F.col("o_orderkey") % 5
    note = (F.when(way == 0, at("'on' yyyy-MM-dd")).when(way == 1, at("dd/MM/yyyy', late'")).when(way == 2, at("'due' MMMM d, yyyy."))
            .when(way == 3, F.concat(at("yyyy-MM-"), (20 + F.col("o_orderkey") % 13).cast("string"))).otherwise(at("d.M.yyyy 'or' dd/MM/yyyy")))
    found = o.select("o_orderkey", F.explode(RX.findall(note, _ANY)).alias("found"))
    day = DT.parse_any("found", DATES)
    return found.select("o_orderkey", "found", day.cast("string").alias("date"), day.isNull().alias("bad"))
