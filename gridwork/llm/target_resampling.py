"""Importance resampling towards a target text, with Arrow kernels.

Features of a text are its runs of 1 to n words; hashed into buckets they give
two bags, of the corpus and of the target. A document's weight is the sum of
its features' log ratios of the two bags (whole thousandths, so sums are exact
in any order); Gumbel noise from the document's id and the largest sums are a
draw without replacement by those weights.

The text work is done by Arrow's kernels on a record batch: ``ascii_lower``,
``split_pattern_regex``, ``list_flatten`` and ``dictionary_encode``; shifted
dictionary indices form the word runs, each distinct one is hashed once, and
``take`` with a sum per document gives the weights.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwork.operators import order

from .common import materialize

# Fixed value: what stands between words (ASCII other than letters and digits).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
PART = 16_000_000        # bytes of text handled at a time (a longer text on its own)


def parts(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of at most ``PART`` bytes, or one text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, PART + (sizes[at - 1] if at else 0), side="right")))
        yield texts.slice(at, end - at)
        at = end


def features(texts: pa.Array, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For word runs of 1, 2, ... ``longest`` words: the text's number and the
    bucket of each."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), BETWEEN)
    doc, words = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists)
    there = pc.not_equal(words, "")
    coded = words.filter(there).dictionary_encode()
    doc, code = doc[there.to_numpy(zero_copy_only=False)], coded.indices.to_numpy()
    words = [w.encode() for w in coded.dictionary.to_pylist()]
    runs, crc = code, np.array([zlib.crc32(w) for w in words], np.uint32)
    for n in range(1, longest + 1):
        if n > 1:
            # runs of n - 1 words and the word after them; each distinct pair's checksum goes on from the run's
            inside = doc[n - 1:] == doc[:max(0, len(doc) - n + 1)]
            pairs, runs_on = np.unique((runs[:-1].astype(np.int64) << 32 | code[n - 1:])[inside], return_inverse=True)
            crc = np.array([zlib.crc32(b" " + words[p & 0xFFFFFFFF], int(crc[p >> 32])) for p in pairs.tolist()], np.uint32)
            # numbers of the runs by the word that they begin with; those that reach over a text's end are never used
            runs = np.zeros(len(inside), np.int64)
            runs[inside] = runs_on
            yield doc[:len(inside)][inside], (crc % buckets)[runs_on] if len(crc) else crc
        else:
            yield doc, np.asarray(pc.take(pa.array(crc % buckets), pa.array(runs)))
        if len(doc) <= n:
            break


def bucket_counts(texts: DataFrame, text_col: str = "text", longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """Rows (bucket, n): how many features of all texts fall into a bucket;
    counted in each task before the shuffle."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in parts(batch.column(0)):
                for _, bucket in features(part, longest, buckets):
                    total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "n"])
    return texts.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Each bucket's log ratio in whole thousandths, rounded down, with one
    added to every count. Comes to the driver: ``buckets`` numbers, whatever
    the input."""
    both = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).alias("t")).unionByName(target.select("bucket", F.lit(0).alias("s"), F.col("n").alias("t")))
    rows = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect()
    s, t = [0] * buckets, [0] * buckets
    for r in rows:
        s[r.bucket], t[r.bucket] = r.s, r.t
    all_s, all_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return np.array([math.floor(1000 * math.log((b + 1.0) * all_s / ((a + 1.0) * all_t))) for a, b in zip(s, t, strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, text_col: str = "text", id_col: str = "doc_id", longest: int = 1) -> DataFrame:
    """Rows (doc_id, n_words, n_features, weight): sums of ``gain`` over each
    text's features."""
    table = pa.array(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in parts(batch.column(1)):
                words = number = total = np.zeros(len(part), np.int64)
                for n, (doc, bucket) in enumerate(features(part, longest, len(gain))):
                    sizes = np.bincount(doc, minlength=len(part))
                    if not n:
                        words = sizes
                    held = np.flatnonzero(sizes)
                    sums = np.zeros(len(part), np.int64)
                    if len(held):
                        begin = np.concatenate([[0], np.cumsum(sizes[held])[:-1]])
                        sums[held] = np.add.reduceat(np.asarray(table.take(pa.array(bucket))), begin)
                    number, total = number + sizes, total + sums
                ids = batch.column(0).slice(at, len(part))
                at += len(part)
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, (words, number, total))], ["doc_id", "n_words", "n_features", "weight"])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def gumbel(id_col: str, seed: int):
    """Noise of an id in whole thousandths, rounded down: the same in every
    run; a null id counts as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, longest: int = 1, buckets: int = BUCKETS, seed: int = 2024,
             text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Every document's doc_id, n_features, weight, score (weight and noise)
    and rank: of the N documents of ``min_words`` words or more, the
    floor(percent * N / 100) highest scores, ties to the smaller id, have ranks
    from 1; the rank of all others is null.

    ``docs`` is read twice (counts, then weights); the weights are written to
    the shared folder, so that ranks are taken from what was scored. Null or
    empty text: no features, weight 0. Null ids sort last among ties, repeated
    rows count and rank each on their own. Other columns are not read. Empty
    tables: no rows, or gains from the other table alone."""
    gain = gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, text_col, longest, buckets), buckets)
    scored = weights(docs, gain, text_col, id_col, longest).withColumn("score", F.col("weight") + gumbel("doc_id", seed))
    scored = materialize(scored, "weights")
    able = F.col("n_words") >= min_words
    drawn = F.floor(F.lit(percent) * scored.where(able).agg(F.count("*")).scalar() / 100)
    placed = order.ordinal(scored.where(able).withColumn("no_id", F.col("doc_id").isNull()), ["-score", "no_id", "doc_id"], name="place")
    columns = ["doc_id", "n_features", "weight", "score"]
    placed = placed.select(*columns, F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank"))
    return placed.unionByName(scored.where(~able).select(*columns, F.lit(None).cast("long").alias("rank")))
