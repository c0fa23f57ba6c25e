"""A corpus pipeline of five stages over ``documents``.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwork.llm import gru_language, pii_spans, soft_mixing, suffix_pieces, superminhash
from gridwork.llm.common import shared_dir, ship, table
from gridwork.llm.queries import MIX, domains


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined; ``und`` and near-chance scores go.
    Null and empty texts and texts without a letter are ``und``. Rows are judged
    one by one, so repeated rows share their fate; languages that score alike:
    the first by name. Without a labelled language, and on an empty table, the
    result is empty."""
    return gru_language.identified(docs, gru_language.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at 0.8 or more: the
    one of least id. Null, empty and blank texts are linked with nothing and
    stay, as do rows with a null id. Empty table: empty result."""
    return superminhash.drop_near_duplicates(docs, width=5, num=80, den=100)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind and ``n_chars`` counted
    anew. Null text stays null, an empty one empty; repeated rows are treated
    alike. Empty table: empty result."""
    return pii_spans.redacted(docs, "text", "n_chars")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted rates say. Null and empty texts have no
    tokens and get the rate of the domains' shares; a null id is drawn like any
    other; repeated rows of one id are drawn alike. Labels with a null id or
    without a domain are not learned from; without labels all rates are 1. A
    target out of reach is logged. Empty table: empty result."""
    return soft_mixing.mixed(docs, domains(table(spark, sf_dir, "labels")), MIX)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document. Null and empty texts have none; a row does
    not depend on any other. Empty table: empty result."""
    coded = suffix_pieces.round_trip(F.col("text"), public_tokenizers.path("piece_bpe_32k.model"))
    out = docs.select("doc_id", "lang", "source", coded.alias("c"))
    return out.select("doc_id", "lang", "source", F.size("c.ids").cast("long").alias("n_pieces"), F.col("c.ids").alias("ids"), F.col("c.same").alias("round_trip"))


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("sentencepiece", pieces),
]

# A recurrent network, a fitted classifier and a tokenizer decide the rows: SQL
# cannot express the stages; tests/llm holds each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return docs
