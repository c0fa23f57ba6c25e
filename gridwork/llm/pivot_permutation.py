"""Embedding near-duplicates through a pivot-permutation index.

A vector is described by its nearest reference points (pivots) in order. The
index is an inverted list for every set of ``SHARED`` pivots: two vectors meet
in a list exactly if their descriptions share at least ``SHARED`` pivots.
Every pair is verified once, in the list of its ``SHARED`` smallest common
pivots, by the cosine in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize

SAMPLE = 8192        # rows the pivots are chosen from, at most (the least by hash)
BITS = 13            # of a pivot's number in a list's key, so 8,192 pivots at most
APART = 0.8          # greatest cosine between two pivots
PREFIX = 8           # nearest pivots that describe a vector
SHARED = 3           # pivots two vectors must share to be compared
SMALL = 32           # lists up to this size are joined; larger ones are multiplied in blocks
BLOCK = 512          # vectors of a block of a large list


def choose_pivots(sample: np.ndarray, n_rows: int) -> np.ndarray:
    """Unit reference points for ``n_rows`` vectors: about 4 * sqrt(n_rows)
    rows of the sample, in its order, leaving out those near one already taken
    (a group of near copies would otherwise fill its members' descriptions
    with pivots that differ by noise alone)."""
    n = min(1 << BITS, max(64, round(4 * math.sqrt(n_rows))))
    taken = np.empty((0, sample.shape[1] if sample.ndim == 2 else 0))
    for v in sample:
        v = v / np.linalg.norm(v)
        if len(taken) < n and not (taken @ v > APART).any():
            taken = np.vstack([taken, v])
    return taken


def nearest_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The PREFIX nearest pivots of each vector, in order of nearness."""
    k = min(PREFIX, len(pivots))
    sims = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ pivots.T
    some = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    return np.take_along_axis(some, np.argsort(-np.take_along_axis(sims, some, axis=1), axis=1, kind="stable"), axis=1)


def _describer(by_dim: dict[int, np.ndarray]):
    @F.pandas_udf("array<int>")
    def describe(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = [None] * len(s)
            sizes = np.array([len(v) for v in s])
            for d in np.unique(sizes) if len(s) else ():
                at = np.nonzero(sizes == d)[0]
                x = np.stack([np.asarray(s.iloc[i], np.float64) for i in at])
                for i, row in zip(at, nearest_pivots(x, by_dim[int(d)]), strict=True):
                    out[i] = row.astype(np.int32)
            yield pd.Series(out)
    return describe


def _list_keys():
    """The lists a description is entered in: every SHARED of its pivots (all
    of them, if it has fewer), as one number with the dimension."""
    def keys(pivots, d):
        k = min(SHARED, len(pivots))
        return [int(d) << (3 * BITS) | sum(int(p) << (BITS * i) for i, p in enumerate(c)) for c in combinations(sorted(pivots), k)]

    @F.pandas_udf("array<long>")
    def enter(order: pd.Series, dim: pd.Series) -> pd.Series:
        return pd.Series([keys(p, d) for p, d in zip(order, dim, strict=True)])
    return enter


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x @ y.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1))


def _summed(a: np.ndarray, b: np.ndarray) -> float:
    """Cosine with sums in the order of the components, as small lists are
    compared, so that a pair at the threshold is decided alike in any list."""
    def dot(x, y):
        total = 0.0
        for p, q in zip(x.tolist(), y.tolist(), strict=True):
            total += p * q
        return total
    return dot(a, b) / (math.sqrt(dot(a, a)) * math.sqrt(dot(b, b)))


def _block(threshold: float):
    """Links of a block pair of a large list: for every vector the number of
    vectors linked (with copies) and one edge to its local group's first."""
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        code, i, j = key
        left, right = pdf[pdf.block == i], pdf[pdf.block == j]
        empty = pd.DataFrame({"rep": [], "n": [], "mate": []}).astype("int64")
        if not len(left) or not len(right):
            return empty
        triple = [(int(code) >> (BITS * t)) & ((1 << BITS) - 1) for t in range(SHARED)]
        top = max(triple)

        def lower(d):  # one-hot of the pivots below the list's greatest
            hot = np.zeros((len(d), top + 1), np.float32)
            for r, p in enumerate(d.pivots):
                hot[r, [q for q in p if q < top]] = 1
            return hot
        a, b = (np.stack([np.asarray(v, np.float64) for v in d.embedding]) for d in (left, right))
        least = min(SHARED, len(left.pivots.iloc[0]))
        close = _cosines(a, b)
        for r, c in zip(*np.nonzero(np.abs(close - threshold) < 1e-9), strict=True):
            close[r, c] = _summed(a[r], b[c])
        link = (close >= threshold) & (lower(left) @ lower(right).T == least - 1)
        ids = left.rep.to_numpy(), right.rep.to_numpy()
        if i == j:
            np.fill_diagonal(link, False)
        rows = [pd.DataFrame({"rep": ids[0], "n": link @ right.copies.to_numpy()})]
        if i != j:
            rows.append(pd.DataFrame({"rep": ids[1], "n": left.copies.to_numpy() @ link}))
        out = pd.concat(rows)
        names = np.concatenate(ids) if i != j else ids[0]
        first = names.copy()
        while True:  # least id reachable inside the block pair
            was = first.copy()
            l, r = first[:len(ids[0])], first[-len(ids[1]):]
            np.minimum(l, np.where(link, r[None, :], np.iinfo(np.int64).max).min(axis=1), out=l)
            np.minimum(r, np.where(link, l[:, None], np.iinfo(np.int64).max).min(axis=0), out=r)
            if (first == was).all():
                break
        out["mate"] = first
        return out[(out.n > 0)].astype("int64")
    return run


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                           threshold: float = 0.95) -> DataFrame:
    """Links between vectors with cosine >= ``threshold``. One row per vector:
    vec_id, n_links (other vectors linked directly), component_id (smallest
    vec_id reachable), kept.

    Pivots come from a bounded sample (``SAMPLE`` rows, the least by hash);
    every vector is indexed. Equal vectors are one class with a count. Large
    lists (a big group of near copies) are compared in blocks of ``BLOCK``
    vectors that only give counts and one edge a vector.

    Null, zero or non-finite vectors and null components: linked with nothing.
    Vectors of different lengths are never linked. Repeated rows count as
    copies. A null id: n_links 0, component_id null, kept true. Other columns
    are not read. Empty table: empty result."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("embedding"))
    inf = float("inf")
    fine = (F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: F.coalesce((F.abs(x) < inf) & ~F.isnan(x), F.lit(False)))
            & F.exists("embedding", lambda x: x != 0))
    good = rows.where(F.coalesce(fine, F.lit(False)))
    classes = materialize(good.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "pivots")
    sizes = {r[0]: r[1] for r in classes.groupBy(F.size("embedding")).count().collect()}
    by_dim = {}
    for d, n in sizes.items():
        own = classes.where(F.size("embedding") == d).orderBy(F.xxhash64("embedding"), "rep").limit(SAMPLE).select("embedding").collect()
        by_dim[d] = choose_pivots(np.array([r[0] for r in own], np.float64).reshape(len(own), d), n)
    named = classes.withColumn("pivots", _describer(by_dim)("embedding"))
    named = materialize(named.withColumn("keys", _list_keys()("pivots", F.size("embedding"))), "pivots")
    entries = named.select("rep", F.explode("keys").alias("key"))
    lists = materialize(entries.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "pivots")

    # small lists: joined; a pair counts in the list of its smallest common pivots
    short = entries.join(lists.where(F.col("size") <= SMALL), "key").join(named.select("rep", "pivots"), "rep")
    other = short.select("key", F.col("rep").alias("v"), F.col("pivots").alias("pv"))
    common = F.array_sort(F.array_intersect("pivots", "pv"))
    mine = F.aggregate(F.slice(common, 1, SHARED), F.struct(F.lit(0).cast("long").alias("code"), F.lit(0).alias("at")),
                       lambda s, p: F.struct((s["code"] + p.cast("long") * F.pow(F.lit(float(1 << BITS)), s["at"]).cast("long")).alias("code"), (s["at"] + 1).alias("at")),
                       lambda s: s["code"])
    pairs = (short.join(other, "key").where("rep < v").where(mine == F.col("key").bitwiseAND(F.lit((1 << 3 * BITS) - 1)))
             .select(F.col("rep").alias("u"), "v"))
    x = named.select(F.col("rep").alias("u"), F.col("embedding").alias("x"), F.col("copies").alias("cu"))
    y = named.select(F.col("rep").alias("v"), F.col("embedding").alias("y"), F.col("copies").alias("cv"))

    def dot(a: str, b: str):
        return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    cosine = dot("x", "y") / (F.sqrt(dot("x", "x")) * F.sqrt(dot("y", "y")))
    near = materialize(pairs.join(x, "u").join(y, "v").where(cosine >= threshold).select("u", "v", "cu", "cv"), "pivots")

    # large lists: in blocks
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    long = (entries.join(lists.where(F.col("size") > SMALL), "key").join(named.select("rep", "pivots", "embedding", "copies"), "rep")
            .withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "pivots", "embedding", "copies"))
    far = materialize(long.groupBy("key", "i", "j").applyInPandas(_block(threshold), "rep long, n long, mate long"), "pivots")

    groups = components(near.select("u", "v").unionByName(far.where("rep <> mate").select(F.col("rep").alias("u"), F.col("mate").alias("v"))))
    counted = (near.select(F.col("u").alias("rep"), F.col("cv").alias("n")).unionByName(near.select(F.col("v").alias("rep"), F.col("cu").alias("n")))
               .unionByName(far.select("rep", "n")).groupBy("rep").agg(F.sum("n").alias("n")))
    out = classes.join(counted, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left").select(
        "embedding", F.coalesce("n", F.lit(0)).alias("n"), "copies", F.coalesce("root", "rep").alias("root"))
    ok = F.coalesce(fine, F.lit(False))
    joined = rows.withColumn("e", F.when(ok, F.col("embedding"))).drop("embedding").join(out.withColumnRenamed("embedding", "e"), "e", "left")
    root = F.coalesce("root", "vec_id")
    return joined.select("vec_id", F.coalesce(F.col("n") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
                         F.when(F.col("vec_id").isNotNull(), root).alias("component_id"),
                         F.coalesce(F.col("vec_id") == root, F.lit(True)).alias("kept"))
