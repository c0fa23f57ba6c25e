"""File-stream sources and an ``availableNow`` runner."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwork.functions import regex as RX
from gridwork.functions import text as TX


def read_stream(spark: SparkSession, path: str, like: str | None = None,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """A parquet file stream over the folder ``path`` (or over the single
    file ``path``: its folder, filtered to that file name). A stream needs its
    schema up front: it is taken from ``like`` (a parquet path) or from
    ``path`` itself."""
    schema = spark.read.parquet(like or path).schema
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if os.path.isfile(path):
        r = r.option("pathGlobFilter", os.path.basename(path))
        path = os.path.dirname(path)
    return r.parquet(path)


def text_profile_stream(docs: DataFrame) -> DataFrame:
    """Per-document profile (length, words, lines, e-mails, cleaned length):
    stateless, so each micro-batch is independent."""
    return docs.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"),
        TX.word_count("text").cast("long").alias("n_words"),
        F.size(TX.split_lines("text")).cast("long").alias("n_lines"),
        RX.count_matches("text", RX.EMAIL).cast("long").alias("n_emails"),
        F.length(RX.strip_punct("text")).cast("long").alias("clean_len"))


def run_available_now(df: DataFrame, out_path: str, checkpoint: str) -> None:
    """Process everything available now into parquet at ``out_path`` and stop.
    The stream keeps its progress in the folder ``checkpoint`` (shared storage
    on a cluster)."""
    q = (df.writeStream.format("parquet").option("path", out_path)
           .option("checkpointLocation", checkpoint).outputMode("append")
           .trigger(availableNow=True).start())
    q.awaitTermination()
