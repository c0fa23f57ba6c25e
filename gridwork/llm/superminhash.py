"""MinHash near-duplicates with SuperMinHash signatures.

Every shingle of a document draws a random permutation of the signature's
components and one uniform number a step: at step j it offers j + r to the
component the permutation names. A component keeps the least offer. The ranks
of one element are a permutation, so its offers to different components are
correlated and spread evenly, which lowers the variance against independent
hash functions. A document stops as soon as every component holds an offer
below the next step. Equal bands of components make candidate buckets; links
are confirmed on the full shingle sets; linked documents form groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, mix64, tidied, tidy

ROWS = 4                 # components of a band
MISS = 1e-7              # chance that a pair at the threshold shares no band
SLACK = 6.0              # standard deviations below the threshold at which signatures already rule a pair out
BLOCK = 512              # members of a block of a large bucket
GROUP = 5000             # members of small buckets that are handled at a time, about
CHUNK = 200_000          # shingles whose permutations are held at once


def n_bands(threshold: float) -> int:
    return max(1, math.ceil(math.log(MISS) / math.log(1 - threshold ** ROWS)))


class _WordHashes(dict):
    """Word (bytes) to its 64-bit hash; forgets everything when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, width: int, words: _WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text:
    A-Z lower-cased, words split at space and 0x09-0x0D. Fewer words than
    ``width``: the whole sequence is the one shingle. None or no word: empty."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(found)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, n)
    size = min(width, n)
    with np.errstate(over="ignore"):
        out = np.full(n - size + 1, size, np.uint64)
        for i in range(size):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i:n - size + 1 + i])
    return np.unique(out)


def signatures(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash of each set (documents x ``m``): the step j in the high
    bits and 24 bits of the uniform number below it; empty sets keep the
    largest value everywhere."""
    out = np.full((len(sets), m), 0xFFFFFFFF, np.uint32)
    first, held = 0, 0
    for i, s in enumerate(sets):
        held += len(s)
        if held >= CHUNK or i == len(sets) - 1:
            _sign(sets[first:i + 1], out[first:i + 1], m)
            first, held = i + 1, 0
    return out


def _draw(elements: np.ndarray, step: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each element at a step: a place in [step, m) and a 24-bit fraction."""
    with np.errstate(over="ignore"):
        bits = mix64(elements + np.uint64(((step + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
    place = step + (((bits & np.uint64(0xFFFFFFFF)) * np.uint64(m - step)) >> np.uint64(32)).astype(np.int64)
    return place, (bits >> np.uint64(40)).astype(np.uint32)


def _sign(sets: list[np.ndarray], out: np.ndarray, m: int) -> None:
    flat = out.reshape(-1)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    elements = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    place, frac = _draw(elements, 0, m)
    np.minimum.at(flat, doc * m + place, frac)
    perm = None
    for step in range(1, m):
        # early stop: only documents with a component that a later step can still lower go on
        on = (out.max(axis=1) >= (step << 24))[doc]
        if not on.any():
            return
        if perm is None:
            doc, elements, place = doc[on], elements[on], place[on]
            perm = np.tile(np.arange(m, dtype=np.uint16), (len(doc), 1))
            row = np.arange(len(doc))
            perm[row, 0], perm[row, place] = place, 0
        elif on.mean() < 0.7:
            doc, elements, perm = doc[on], elements[on], perm[on]
            row = np.arange(len(doc))
        place, frac = _draw(elements, step, m)
        component = perm[row, place]
        perm[row, place] = perm[:, step]
        np.minimum.at(flat, doc * m + component, frac | np.uint32(step << 24))


def _sketcher(width: int, m: int):
    @F.pandas_udf("n long, a long, b long, sig binary")
    @tidied
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = _WordHashes()
        for texts in batches:
            sets = [shingle_set(t, width, words) for t in texts]
            sig = signatures(sets, m)
            with np.errstate(over="ignore"):
                short = ((sig * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)
                sums = [(mix64(s).sum(dtype=np.uint64), mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) for s in sets]
            yield pd.DataFrame({"n": [len(s) for s in sets],
                                "a": np.array([x for x, _ in sums], np.uint64).view(np.int64),
                                "b": np.array([x for _, x in sums], np.uint64).view(np.int64),
                                "sig": [x.tobytes() for x in short]})
    return sketch


def _least_equal(num: int, den: int, m: int) -> int:
    """Equal components below which a pair is not a candidate."""
    t = num / den
    return max(1, math.floor(m * t - SLACK * math.sqrt(m * t * (1 - t))))


def _agree(least: int):
    @F.pandas_udf("boolean")
    def agree(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=bool)
        x, y = (np.frombuffer(b"".join(s), np.uint16).reshape(len(s), -1) for s in (a, b))
        return pd.Series((x == y).sum(axis=1) >= least)
    return agree


def _confirm(width: int, num: int, den: int):
    @F.pandas_udf("boolean")
    @tidied
    def confirm(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        words = _WordHashes()
        for left, right in batches:
            last, of, out = None, None, []
            for a, b in zip(left, right, strict=True):
                if a is not last and a != last:
                    last, of = a, shingle_set(a, width, words)
                s = shingle_set(b, width, words)
                both = len(np.intersect1d(of, s, assume_unique=True))
                out.append(both > 0 and den * both >= num * (len(of) + len(s) - both))
            yield pd.Series(out, dtype=bool)
    return confirm


def _meeting(pdf: pd.DataFrame, i: int, j: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each bucket of a group of buckets the row numbers (left, right) of
    its pairs that agree, belong to different groups and meet in no earlier
    band."""
    sig = np.frombuffer(b"".join(pdf.sig), np.uint16).reshape(len(pdf), -1)
    band = sig.reshape(len(pdf), -1, ROWS).copy().view(np.uint64)[:, :, 0]
    block, label, number, rep = (pdf[c].to_numpy() for c in ("block", "label", "band", "rep"))
    keys = pdf.key.to_numpy()
    order = np.argsort(keys, kind="stable")
    for rows in np.split(order, np.nonzero(np.diff(keys[order]))[0] + 1):
        left, right = rows[block[rows] == i], rows[block[rows] == j]
        for x in left:
            y = right[rep[right] > rep[x]] if i == j else right
            y = y[label[y] != label[x]]
            y = y[(band[y, :number[x]] != band[x, :number[x]]).all(axis=1)] if len(y) else y
            y = y[(sig[y] == sig[x]).sum(axis=1) >= least] if len(y) else y
            if len(y):
                yield np.full(len(y), x), y


def _flagged(least: int):
    """Members of open buckets that have a pair still to be compared."""
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, i, j = key
        hit = np.zeros(len(pdf), bool)
        for x, y in _meeting(pdf, i, j, least):
            hit[x] = hit[y] = True
        return pdf[hit]
    return run


def _joined(least: int, width: int, num: int, den: int):
    """Links between different groups, confirmed on the full sets: for each
    member one to each other group."""
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, i, j = key
        words, sets, out = _WordHashes(), {}, set()
        text, rep, label = pdf.text.to_numpy(), pdf.rep.to_numpy(), pdf.label.to_numpy()

        def full(r: int) -> np.ndarray:
            if r not in sets:
                sets[r] = shingle_set(text[r], width, words)
            return sets[r]
        for xs, ys in _meeting(pdf, i, j, least):
            a, done = full(xs[0]), set()
            for y in ys:
                if label[y] not in done:
                    b = full(y)
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    if both and den * both >= num * (len(a) + len(b) - both):
                        done.add(label[y])
                        out.add((int(rep[xs[0]]), int(rep[y])))
        sets.clear()
        tidy()
        return pd.DataFrame(sorted(out), columns=["u", "v"]).astype("int64")
    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                    num: int = 80, den: int = 100) -> DataFrame:
    """Groups of documents whose ``width``-word shingle sets are linked by
    ``den`` * intersection >= ``num`` * union. Returns one row per input row:
    doc_id, n_shingles, component_id (smallest doc_id reachable), kept.

    Equal sets become one class before any bucket is formed. In every bucket
    all members are compared with the least one; after grouping, buckets that
    still hold members of different groups are compared again between those
    groups (many small ones at a time, a large one in blocks), so no candidate
    link between groups is missed and no pairs but links are written out. A pair at
    the threshold shares no band with a chance of ``MISS``.

    Null, empty or word-free text: empty set, linked with nothing. Repeated
    rows: each is returned; rows that repeat an id are one document, linked if
    any of their texts is. A null id takes no part: component_id null, kept
    true. Other columns are not read. Empty table: empty result."""
    m = ROWS * (bands := n_bands(num / den))
    sk = docs.select(F.col(id_col).cast("long").alias("doc_id"), _sketcher(width, m)(F.col(text_col)).alias("s")).select("doc_id", "s.*")
    sk = materialize(sk, "superminhash")
    classes = materialize(sk.where("n > 0 and doc_id is not null").groupBy("a", "b", "n")
                          .agg(F.min("doc_id").alias("rep"), F.min("sig").alias("sig")).select("rep", "a", "b", "n", "sig"), "superminhash")
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("sig", 2 * ROWS * i + 1, 2 * ROWS)) for i in range(bands)])
    entries = classes.select("rep", F.explode(keys).alias("key"))
    pivots = entries.groupBy("key").agg(F.min("rep").alias("pivot"), F.count("*").alias("size")).where("size > 1")
    pivots = materialize(pivots, "superminhash")
    star = entries.join(pivots, "key").where("rep <> pivot").select(F.col("pivot").alias("u"), F.col("rep").alias("v")).distinct()
    least = _least_equal(num, den, m)
    found = materialize(_linked(star, docs, classes, id_col, text_col, _agree(least), _confirm(width, num, den)), "superminhash")
    several = sk.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.countDistinct("a", "b", "n").alias("k")).where("k > 1")
    versions = (sk.join(several.select("doc_id"), "doc_id", "left_semi").join(classes.drop("sig"), ["a", "b", "n"])
                .select(F.col("doc_id").alias("u"), F.col("rep").alias("v")))
    edges = found.unionByName(versions)
    labels = materialize(components(edges), "superminhash")

    # what the star left open: members other than the pivot that are in different groups
    named = classes.select("rep", "sig").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        "rep", "sig", F.coalesce("root", "rep").alias("label"))
    wide = named.select("rep", "label", F.posexplode(keys).alias("band", "key")).join(pivots.where("size > 2"), "key").where("rep <> pivot")
    still = wide.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("k")).where("x <> y").select("key", "k")
    members = materialize(wide.select("key", "band", "rep", "label").join(still, "key"), "superminhash")
    groups = max(1, members.count() // GROUP)
    blocks = F.ceil(F.col("k") / BLOCK).cast("int")
    # small buckets are handled many at a time; a large one in pairs of blocks
    dealt = (members.join(named.select("rep", "sig"), "rep")
             .withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select(F.when(F.col("blocks") == 1, F.pmod(F.col("key"), F.lit(groups))).otherwise(F.col("key")).alias("g"),
                     F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "key", "band", "block", "rep", "label", "sig"))
    flagged = materialize(dealt.groupBy("g", "i", "j").applyInPandas(_flagged(least), dealt.schema), "superminhash")
    texts = _texts(docs, flagged.select(F.col("rep").alias("id")).distinct(), id_col, text_col).withColumnRenamed("id", "rep")
    more = materialize(flagged.join(texts, "rep").groupBy("g", "i", "j").applyInPandas(_joined(least, width, num, den), "u long, v long"), "superminhash")
    if more.limit(1).count():
        labels = materialize(components(edges.unionByName(more)), "superminhash")
    out = (sk.join(classes.select("a", "b", "n", "rep"), ["a", "b", "n"], "left")
           .select("doc_id", "n", F.when(F.col("doc_id").isNull() | (F.col("n") == 0), F.col("doc_id")).otherwise(F.col("rep")).alias("rep"))
           .join(labels.withColumnRenamed("node", "rep"), "rep", "left"))
    root = F.coalesce("root", "rep")
    return out.select("doc_id", F.col("n").alias("n_shingles"), root.alias("component_id"),
                      F.coalesce(F.col("doc_id") == root, F.lit(True)).alias("kept"))


def _linked(pairs: DataFrame, docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, agree, confirm) -> DataFrame:
    """Of candidate pairs (u, v): first those whose signatures agree, then
    those whose full sets do."""
    def sig(name: str, out: str) -> DataFrame:
        return classes.select(F.col("rep").alias(name), F.col("sig").alias(out))
    pairs = pairs.join(sig("u", "su"), "u").join(sig("v", "sv"), "v").where(agree(F.col("su"), F.col("sv"))).select("u", "v").distinct()
    pairs = materialize(pairs, "superminhash")
    texts = _texts(docs, pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))).distinct(), id_col, text_col)
    left = texts.select(F.col("id").alias("u"), F.col("text").alias("tu"))
    right = texts.select(F.col("id").alias("v"), F.col("text").alias("tv"))
    both = pairs.join(right, "v").join(left, "u")
    return both.where(confirm(F.col("tu"), F.col("tv"))).select("u", "v").distinct()


def _texts(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts of the documents with the wanted ids, written down."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    return materialize(own.join(wanted.hint("shuffle_hash"), "id", "left_semi"), "superminhash")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of one document of each group, all columns as they were. Of
    rows that repeat the kept id only one stays; rows with a null id and
    documents without words are all kept. ``options`` as in
    :func:`near_duplicates`."""
    gone = near_duplicates(docs, id_col, text_col, **options).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    twice = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_twice")).count().where("count > 1").select("_twice")
    kept = docs.join(gone, F.col(id_col).cast("long") == F.col("_gone"), "left_anti")
    same = F.col(id_col) == F.col("_twice")
    return kept.join(twice, same, "left_anti").unionByName(kept.join(twice, same, "left_semi").dropDuplicates([id_col]))


__all__: list[str] = ["near_duplicates", "drop_near_duplicates", "shingle_set", "signatures", "n_bands"]
