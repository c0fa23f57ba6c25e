"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic text.
A text is cut into overlapping windows; each window is compressed with either
dictionary. A window that the toxic dictionary shortens more holds wording
that is common in toxic and rare in ordinary text. How much clearer the toxic
use of a phrase must be for the toxic dictionary, and how much excess counts,
is calibrated on labelled documents not trained on.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hash01, is_held_out, materialize

FIT = 6000                 # labelled documents of each class the classifier is fitted on, about, at most
WINDOW, STEP = 96, 64      # bytes
ORDINARY = 8192            # bytes of the ordinary dictionary
TOXIC = 2048               # bytes the toxic dictionary has for wording of its own
LEVEL = 5
THRESHOLD = 0.3            # score from which a document counts as toxic
MOST = 10                  # evidence is told apart up to here
CLEAR = (5.0, 4.0, 3.0, 2.5, 2.0, 1.5, 1.0)  # how clearly toxic a phrase must be, in standard deviations: calibration takes one
PHRASE = r"[^\x00-\x40\x5b-\x60\x7b-\x7f]+"       # letters and non-ASCII characters
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
EXCESSES = tuple(range(1, 13))


def normalize(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def windows(data: bytes) -> list[bytes]:
    """Windows that cover all of ``data``, each sharing bytes with the next."""
    return [data[i:i + WINDOW] for i in range(0, max(1, len(data) - (WINDOW - STEP)), STEP)]


def _packed(phrases: list[str], size: int) -> bytes:
    """The phrases that fit, the best ones, which come first, nearest to the
    data."""
    out, held = [], 0
    for w in (p.encode("utf-8", "surrogatepass") for p in phrases):
        if held + len(w) + 1 > size:
            break
        out.append(b" " + w)
        held += len(w) + 1
    return b"".join(reversed(out))


def train_dictionaries(sample: DataFrame) -> tuple[bytes, list[bytes]]:
    """Dictionaries of the phrases most worth storing, from rows (_y, _t): the
    ordinary one, and toxic ones to choose from, one for each of ``CLEAR`` that
    adds a phrase. All hold what is common in ordinary text; the toxic ones
    hold besides, in front of it, what documents marked toxic use more than
    twice as often as ordinary ones do, so that equal wording is stored at
    equal distances and costs the same with any.

    Documents that hold a phrase are counted in Spark; to the driver come only
    as many phrases as a dictionary can hold."""
    found = F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce("_t", F.lit("")), UPPER, UPPER.lower()), F.lit(PHRASE), 0))
    words = sample.select("_y", F.explode(found).alias("w")).where(F.octet_length("w").between(3, 40))
    counts = materialize(words.groupBy("w").agg(F.count_if(F.col("_y") == 0).alias("c"), F.count_if(F.col("_y") == 1).alias("d")), "phrases")
    sizes = {r[0]: r[1] for r in sample.groupBy("_y").count().collect()}
    n, m = max(1, sizes.get(0, 0)), max(1, sizes.get(1, 0))
    saved = F.octet_length("w") - 2

    def best(rows: DataFrame, worth: Column, size: int) -> DataFrame:
        return rows.where(worth > 0).orderBy((-worth * saved).asc(), "w").limit(size // 4).withColumn("worth", worth * saved)
    ordinary = [r.w for r in best(counts.where("c > 2"), F.col("c") / n, ORDINARY).collect()]
    usual = F.lit(float(m)) * (F.col("c") + 1) / n
    clear = counts.where("d >= 2").where(F.octet_length("w") >= 4).withColumn("clear", (F.col("d") - 2 * usual) / F.sqrt("d"))
    each = [best(clear.where(F.col("clear") >= x), (F.col("d") - usual) / m, TOXIC).select("w", "worth", F.lit(i).alias("i")) for i, x in enumerate(CLEAR)]
    rows = functools.reduce(DataFrame.unionByName, each).collect()
    base = _packed(ordinary, ORDINARY)
    own = [_packed([r.w for r in sorted(rows, key=lambda r: (-r.worth, r.w.encode())) if r.i == i], TOXIC) for i in range(len(CLEAR))]
    return base, [o + base for o in dict.fromkeys(own)]


class Lengths:
    """Compressed lengths of windows with one dictionary."""

    def __init__(self, dictionary: bytes):
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(dictionary), source_size=WINDOW, min_match=4,
                                                                write_content_size=0, write_checksum=0, write_dict_id=0)
        d = zstandard.ZstdCompressionDict(dictionary or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        self._compress = zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress

    def __call__(self, parts: list[bytes]) -> np.ndarray:
        return np.fromiter((len(self._compress(p)) for p in parts), np.int64, len(parts))


@dataclass(frozen=True)
class Model:
    """Dictionaries, the calibrated excess from which a window counts, and the
    probability of label 1 by the evidence: the sum of what the windows' excess
    has over the threshold, plus one for each, up to ``MOST``."""
    ordinary: bytes
    toxic: bytes
    excess: int
    chance: tuple[float, ...]

    def scorer(self):
        a, b = Lengths(self.ordinary), Lengths(self.toxic)

        def hits(texts) -> np.ndarray:
            out = []
            for t in texts:
                parts = windows(normalize(t))
                out.append(evidence(a(parts) - b(parts), self.excess))
            return np.array(out, np.int64)
        return hits


def _rising(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Share of ones in each bin, neighbouring bins pooled until it rises."""
    pools: list[list[float]] = []
    for a, b in zip(ones, zeros, strict=True):
        pools.append([a, b, 1])
        while len(pools) > 1 and pools[-2][0] * (pools[-1][0] + pools[-1][1]) >= pools[-1][0] * (pools[-2][0] + pools[-2][1]):
            x = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], x, strict=True)]
    return np.concatenate([np.full(int(n), a / (a + b)) for a, b, n in pools])


def evidence(extra: np.ndarray, excess: int) -> int:
    return min(MOST, int(np.maximum(extra - excess + 1, 0).sum()))


def _tried(base: bytes, own: list[bytes]):
    """A text's evidence with each toxic dictionary and each excess."""
    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        usual, others = Lengths(base), [Lengths(o) for o in own]
        for texts in batches:
            out = []
            for t in texts:
                parts = windows(normalize(t))
                length = usual(parts)
                out.append([evidence(extra, e) for extra in (length - o(parts) for o in others) for e in EXCESSES])
            yield pd.Series(out)
    return run


def fit(sample: DataFrame, weights: tuple[float, float] = (1.0, 1.0)) -> Model:
    """Train on half of the documents (rows _id, _y, _t, bounded by ``FIT``;
    every other one of a class in the order of ids), calibrate on the rest. Each toxic dictionary gets the
    threshold whose chances give the least log loss; taken is the one of the
    clearest phrases whose loss is within a standard error of the least, as
    copies of a text in both halves make phrases of it look better than they
    are. A document of either class stands for as many as its weight says.
    Texts stay on the executors: what is gathered are phrases that fit a
    dictionary, and how many documents of a class show each evidence."""
    nth = F.row_number().over(Window.partitionBy("_y").orderBy("_id", "_t"))
    halves = materialize(sample.select("_y", "_t", (nth % 2).alias("_half")), "toxic")
    base, own = train_dictionaries(halves.where("_half = 1"))
    tried = halves.where("_half = 0").select("_y", F.posexplode(_tried(base, own)("_t")).alias("which", "evidence"))
    count = np.zeros((2, len(own) * len(EXCESSES), MOST + 1))
    for y, which, hits, n in tried.groupBy("_y", "which", "evidence").count().collect():
        count[y, which, hits] = n
    each = []
    for which in range(count.shape[1]):
        zeros, ones = count[0, which] * weights[0], count[1, which] * weights[1]
        chance = _rising(ones + 0.2 * weights[1], zeros + 0.8 * weights[0])
        losses, n = np.concatenate([-np.log(1 - chance) * weights[0], -np.log(chance) * weights[1]]), np.concatenate(count[:, which])
        loss = float(losses @ n)
        error = math.sqrt(max(0.0, float(losses ** 2 @ n) - loss ** 2 / max(1.0, n.sum())))
        each.append((loss, which, error, chance))
    least, _, error, _ = min(each, key=lambda e: e[:2])
    _, which, _, chance = min((e for e in each if e[0] <= least + error), key=lambda e: (e[1] // len(EXCESSES), e[0]))
    return Model(base, own[which // len(EXCESSES)], EXCESSES[which % len(EXCESSES)], tuple(chance.tolist()))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on the whole texts of a sample of the labelled rows that are not held
    out, bounded for each class. Rows are weighted by what they stand for, so
    scores are chances among such rows. Only the sample's ids, about 2 ``FIT``
    at most, go to where the texts are; no text is shuffled for the join, none
    comes to the driver.

    Null ids and labels other than 0 and 1 are not learned from; an id labelled
    both 0 and 1 is one document of each class; repeated rows count as often
    as they are there. Null text counts as empty. Other columns are not read.
    Nothing to learn from (empty tables, too): dictionaries without phrases,
    one chance for every text."""
    marks = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)").distinct()
    own = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).where(~is_held_out("_id")))
    counts = {r[0]: r[1] for r in marks.where(~is_held_out("_id")).groupBy("_y").count().collect()}
    share = [min(1.0, FIT / max(1, counts.get(y, 0))) for y in (0, 1)]
    picked = marks.where(hash01("_id") < F.when(F.col("_y") == 1, share[1]).otherwise(share[0]))
    return fit(own.join(F.broadcast(picked), "_id").select("_id", "_y", "_t"), (1 / share[0], 1 / share[1]))


def toxicity(text: Column, model: Model) -> Column:
    """Probability that a whole text is toxic. Null and empty texts get the
    chance of a text without a suspicious window."""
    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hits, chance = model.scorer(), np.array(model.chance)
        for s in batches:
            yield pd.Series(chance[np.minimum(hits(s), len(chance) - 1)])
    return run(text)
