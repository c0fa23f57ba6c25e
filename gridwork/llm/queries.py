"""The registered queries of this subpackage and, where SQL can say it, their
DuckDB SQL. Each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    compression_toxicity, gru_language, merge_replay, periodic_runs, pii_spans, pivot_permutation, prefix_chat, soft_mixing, sorted_lists, suffix_pieces,
    superminhash, target_resampling, token_frames,
)
from .common import is_held_out, new_dir, ship, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
END_ID = 2
MIX = {"clean": 0.84, "low": 0.08, "toxic": 0.08}


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return run
    return deco


def domains(labels: DataFrame) -> DataFrame:
    """The labelled table as (doc_id, domain)."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low")
                         .when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), "clean").alias("domain"))


@register("op1_pivot_permutation", """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r(u, w) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.u, l.v FROM r JOIN l ON r.w = l.u),
c AS (SELECT u, min(w) AS component_id FROM r GROUP BY u),
n AS (SELECT u, count(*) AS n_links FROM l GROUP BY u)
SELECT e.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, coalesce(c.component_id, e.vec_id) AS component_id,
  e.vec_id = coalesce(c.component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN c ON c.u = e.vec_id LEFT JOIN n ON n.u = e.vec_id""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_permutation.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


@register("op2_token_frames")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_frames.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END_ID)


@register("op3_soft_mixing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return soft_mixing.document_rates(table(spark, sf_dir, "documents"), domains(table(spark, sf_dir, "labels")), MIX)


@register("op4_sorted_lists", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorted_lists.top_k(table(spark, sf_dir, "embeddings"))


@register("op5_suffix_pieces")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = suffix_pieces.round_trip(F.col("text"), public_tokenizers.path("piece_bpe_32k.model"))
    docs = table(spark, sf_dir, "documents").select("doc_id", coded.alias("c"))
    return docs.select("doc_id", F.size("c.ids").cast("long").alias("n_pieces"), F.col("c.ids").alias("ids"), F.col("c.same").alias("round_trip"))


@register("op6_prefix_chat", r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (SELECT *, 14 + length(role) + 2 * length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '#', ''))
    + length(role) - length(replace(replace(replace(replace(replace(role, '\', ''), '<', ''), '#', ''), ':', ''), chr(10), '')) AS size,
  row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM t
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
g AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM f)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
FROM g GROUP BY conv_id""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    turns = turns.unionByName(spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema))
    folder = new_dir(spark, "chat")
    examples = prefix_chat.expand(turns)
    examples.write.option("compression", "zstd").parquet(folder)
    return prefix_chat.digests(spark.read.schema(examples.schema).parquet(folder))


@register("op7_compression_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = compression_toxicity.learn(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", is_held_out("doc_id").alias("held_out"), compression_toxicity.toxicity(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= compression_toxicity.THRESHOLD).cast("int"))


@register("op8_gru_language")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = gru_language.learn(docs)
    return docs.select("doc_id", is_held_out("doc_id").alias("held_out"), gru_language.predict(F.col("text"), model).alias("p")).select("doc_id", "held_out", "p.*")


@register("op9_pii_spans")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans.personal_data(table(spark, sf_dir, "documents"))


@register("op10_superminhash", r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS a FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(a) < 3 THEN array_to_string(a, chr(10)) ELSE array_to_string(a[i:i+2], chr(10)) END AS g
  FROM (SELECT doc_id, a, unnest(range(1, greatest(len(a) - 2, 1) + 1)) AS i FROM w WHERE len(a) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS u, y.doc_id AS v, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 85 * (a.n + b.n - c)),
r(u, w) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.u, l.v FROM r JOIN l ON r.w = l.u),
c AS (SELECT u, min(w) AS component_id FROM r GROUP BY u)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id,
  d.doc_id = coalesce(c.component_id, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.u = d.doc_id""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, num=85, den=100)


@register("op11_merge_replay")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = merge_replay.round_trip(F.col("text"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").select("doc_id", coded.alias("c"))
    return docs.select("doc_id", F.expr("octet_length(c.ids) div 4").alias("n_tokens"), F.sha2("c.ids", 256).alias("ids_sha256"), F.sha2("c.decoded", 256).alias("decoded_sha256"))


# crc32 in SQL: the table of the 256 remainders, then a step a byte.
CRC_TABLE = """SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))"""


def crc_sql(text_bytes: str) -> str:
    return f"xor(list_reduce([4294967295] || {text_bytes}, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


def periodic_text(words, doc_id) -> F.Column:
    """``words`` of every tenth document (by h = crc32 of the id) turned
    periodic from word a on with period p; as one text."""
    h, n = F.crc32(doc_id.cast("string").cast("binary")), F.size(words).cast("long")
    g = F.floor(h / 10)
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + g % 8))
    tail = F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int")))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.slice(F.concat(F.slice(words, 1, a.cast("int")), tail), 1, n.cast("int")), " "))


@register("op12_suffix_tree_runs", rf"""
WITH t AS ({CRC_TABLE}),
o AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS o,
  {crc_sql("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))")} AS h FROM documents, t),
a AS (SELECT doc_id, o, len(o) AS n, h, h // 10 AS g, CASE WHEN len(o) > 0 THEN (h // 10) % len(o) END AS a FROM o),
b AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
w AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN o[i + 1] ELSE o[a + (i - a) % p + 1] END) ELSE o END AS w FROM b),
k AS (SELECT doc_id, n, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS k FROM (SELECT *, unnest(range(n - 2)) AS i FROM w WHERE n > 2)),
m AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.k = y.k AND x.i < y.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT doc_id, q, min(i) AS s, count(*) + 2 + q AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS r FROM m) GROUP BY doc_id, q, r),
r AS (SELECT doc_id, s, l, min(q) AS q FROM s WHERE l >= greatest(6, 4 * q) GROUP BY doc_id, s, l),
best AS (SELECT doc_id, s, l, q, row_number() OVER (PARTITION BY doc_id ORDER BY l / CAST(q AS DOUBLE) DESC, s, q) AS at FROM r),
drops AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM r),
kept AS (SELECT w.doc_id, string_agg(w.w[u.i + 1], ' ' ORDER BY u.i) AS c FROM (SELECT doc_id, unnest(range(n)) AS i FROM w) u
  JOIN w USING (doc_id) ANTI JOIN drops d ON d.doc_id = u.doc_id AND d.i = u.i GROUP BY w.doc_id),
digest AS (SELECT doc_id, count(*) AS n_runs, sha256(string_agg(concat(s, ',', l, ',', q, chr(10)), '' ORDER BY s, q)) AS d FROM r GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(g.n_runs, 0) AS BIGINT) AS n_runs, CAST(e.s AS BIGINT) AS start, CAST(e.l AS BIGINT) AS length, CAST(e.q AS BIGINT) AS period,
  CAST(1000 * e.l // e.q AS BIGINT) AS exponent_milli, coalesce(g.d, sha256('')) AS runs_sha256, sha256(coalesce(c.c, '')) AS collapsed_sha256
FROM w LEFT JOIN digest g USING (doc_id) LEFT JOIN best e ON e.doc_id = w.doc_id AND e.at = 1 LEFT JOIN kept c ON c.doc_id = w.doc_id""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    periodic = F.coalesce(periodic_text(words, F.col("doc_id")), F.col("text"))
    found = docs.select("doc_id", periodic_runs.periodic_runs(periodic).alias("f")).select("doc_id", "f.*")
    better = lambda x, y: (y["length"] * x["period"] > x["length"] * y["period"])
    best = F.reduce(F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.get("runs", F.lit(0)), lambda x, y: F.when(better(x, y), y).otherwise(x))
    found = found.select("doc_id", "runs", "collapsed", best.alias("best"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@register("op13_target_resampling", rf"""
WITH t AS ({CRC_TABLE}),
f AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
u AS (SELECT side, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM f),
x AS (SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM u)),
c AS (SELECT w, {crc_sql("list_transform(range(len(x) // 2), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT))")} % 10000 AS b FROM x, t),
n AS (SELECT b, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM u JOIN c USING (w) GROUP BY b),
z AS (SELECT CAST(sum(s) AS DOUBLE) + 10000 AS s, CAST(sum(t) AS DOUBLE) + 10000 AS t FROM n),
g AS (SELECT b, CAST(floor(1000 * ln((n.t + 1.0::DOUBLE) * z.s / ((n.s + 1.0::DOUBLE) * z.t))) AS BIGINT) AS gain FROM n, z),
d AS (SELECT id AS doc_id, count(*) AS k, CAST(sum(gain) AS BIGINT) AS weight FROM u JOIN c USING (w) JOIN g USING (b) WHERE side = 0 GROUP BY id),
h AS (SELECT doc_id, CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h FROM documents),
e AS (SELECT doc_id, coalesce(k, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM h LEFT JOIN d USING (doc_id)),
p AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM e WHERE n_features >= 20)
SELECT e.doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
  CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM e LEFT JOIN p USING (doc_id)""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
