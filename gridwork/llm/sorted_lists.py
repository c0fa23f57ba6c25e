"""Exact top-k by no-random-access aggregation over sorted lists.

For each dimension there is a list of the candidates sorted by their component
(read from the top for a positive query weight, from the bottom for a negative
one). Lists are read in step; what was read of a candidate's
components bounds its score from below (unread ones count with the worst value
of their list) and from above (unread ones count with the value the list has
reached). Entries are taken up in steps; those of a step are summed by a matrix
product, and rows that no query can still want are read no further. Reading
stops when no outsider's upper bound reaches a score that k
candidates are known to reach; the few that are left are then resolved to
final scores.

Candidates are dealt into blocks with lists of their own. One block is read
first; the k-th score that a query finds there is where reading for it stops in
every other block.
"""

from __future__ import annotations

from operator import neg

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

CANDIDATES = 4096     # vectors of a block of candidates
QUERIES = 4096        # queries of a block of queries: so often is every candidate copied less
TOGETHER = 128        # queries whose bounds are held at a time
DEPTHS = (0.02, 0.06, 0.12, 0.2, 0.3, 0.45, 0.7, 1.0)   # shares of the lists after which bounds are compared
ROUNDING = 1e-12      # bounds in doubles are off by less than this share of the greatest sum


class Lists:
    """The sorted lists of a block of candidates (rows of ``x``, whole numbers
    in doubles)."""

    def __init__(self, x: np.ndarray):
        self.x, self.n = x, len(x)
        self.order = np.argsort(x, axis=0, kind="stable")
        self.rank = np.empty(x.shape, np.int32)
        np.put_along_axis(self.rank, self.order, np.arange(self.n, dtype=np.int32)[:, None], axis=0)
        self.least, self.most = x.min(axis=0), x.max(axis=0)
        self.size = np.abs(x).max(axis=0)

    def at(self, place: int) -> np.ndarray:
        """The components at a place of every list, the least first."""
        return self.x[self.order[place], np.arange(self.x.shape[1])]


def block_top_k(lists: Lists, q: np.ndarray, k: int, own: np.ndarray, ids: np.ndarray, known: np.ndarray) -> tuple[list[np.ndarray], int]:
    """For every query row the candidates (row numbers) that can be among its
    ``k`` best, and how many list entries were read for all of them. ``own[i]``
    is the id query i must not find, ``known[i]`` a score that k candidates of
    its are known to reach."""
    x, n = lists.x, lists.n
    k += n - len(np.unique(ids))                    # rows of one id may turn out to be one result
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    # a row a candidate, a column a query
    rows, rank = np.arange(n), lists.rank
    low = np.repeat((plus @ lists.least + minus @ lists.most)[None, :], n, axis=0)
    slack = ROUNDING * (np.abs(q) @ lists.size)
    alive, depth, reads = np.arange(len(q)), 0, 0
    out: list[np.ndarray] = [np.empty(0, int)] * len(q)
    for share in DEPTHS:
        before, depth = depth, min(n, max(depth + 1, int(np.ceil(share * n))))
        # the next entries of every list, from either end; those not read now are zero
        low += np.where((rank >= n - depth) & (rank < n - before), x - lists.least, 0) @ plus.T
        low += np.where((rank >= before) & (rank < depth), x - lists.most, 0) @ minus.T
        reads += (depth - before) * int((q != 0).sum())
        # an unread component is at most where its list has been read to
        top, bottom = plus * (lists.at(n - depth) - lists.least), minus * (lists.at(depth - 1) - lists.most)
        mine = ids[rows][:, None] == own[alive][None, :]
        bound = np.where(mine, -np.inf, low)
        kth = np.partition(bound, len(rows) - k, axis=0)[len(rows) - k] if len(rows) > k else np.full(len(alive), -np.inf)
        least = np.maximum(kth, known[alive]) - slack
        high = low + (rank < n - depth).astype(np.float64) @ top.T + (rank >= depth).astype(np.float64) @ bottom.T
        left = ~(high < least[None, :]) & ~mine
        done = (left.sum(axis=0) <= 4 * k) | (depth == n)
        for c in np.nonzero(done)[0]:
            out[alive[c]] = rows[left[:, c]]
        alive, go = alive[~done], ~done
        if not len(alive):
            break
        # rows that none of the other queries can want are read no further
        stay = left[:, go].any(axis=1)
        if done.any() or stay.mean() < 0.9:
            q, plus, minus, slack, low = q[go], plus[go], minus[go], slack[go], low[np.ix_(stay, go)]
            rows, rank, x = rows[stay], rank[stay], x[stay]
    return out, reads


def _score(a: list[int], b: list[int]) -> int:
    """Inner product of whole numbers of any size, held at 64 bits."""
    return min(max(sum(map(int.__mul__, a, b)), -2**63), 2**63 - 1)


def _resolver(k: int, scale: float):
    most = np.finfo(np.float64).max

    def whole(vectors: pd.Series) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.clip(np.floor(np.stack([np.asarray(v, np.float64) for v in vectors]) * scale), -most, most)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        queries, found = pdf[pdf.is_query], pdf[~pdf.is_query]
        rows: list[tuple[int, int, int]] = []
        if len(queries) and len(found):
            again = found.vec_id.duplicated(keep=False)
            same = pd.Series([v.tobytes() if a else b"" for v, a in zip(found.e, again, strict=True)], index=found.index)
            found = found[~(again & pd.DataFrame({"i": found.vec_id, "v": same}).duplicated())]
            ids, lists = found.vec_id.to_numpy(), Lists(whole(found.e))
            for lo in range(0, len(queries), TOGETHER):
                part = queries.iloc[lo:lo + TOGETHER]
                q, own = whole(part.e), part.vec_id.to_numpy()
                with np.errstate(over="ignore", invalid="ignore"):
                    left, _ = block_top_k(lists, q, k, own, ids, part.known.fillna(-np.inf).to_numpy())
                    small = np.abs(q) @ lists.size < 2**53      # every sum is a whole number that a double holds
                for i, mates in enumerate(left):
                    if small[i]:
                        scores = (lists.x[mates] @ q[i]).astype(np.int64).tolist()
                    else:
                        scores = [_score(list(map(int, q[i])), list(map(int, lists.x[r]))) for r in mates]
                    scored = sorted(zip(map(neg, scores), ids[mates].tolist(), strict=True))
                    rows += [(int(own[i]), c, -score) for score, c in scored[:k]]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")
    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding",
          scale: int = 256) -> DataFrame:
    """The ``k`` highest integer inner products of floor(scale * x) between
    each query (id divisible by ``every``) and all other rows: query_id, rank
    (from 1), vec_id, score; ties to the smaller vec_id.

    Queries and candidates are dealt into blocks. The first block of candidates
    gives each query a score to beat; then each other pair of blocks gives at
    most ``k`` rows a query, which one aggregate a query merges.

    Null vectors, null or non-finite components and null ids take no part.
    Vectors of other lengths than the query's are no candidates. Sums are
    exact for whole numbers of any size (scaled components are doubles, held
    at the greatest one); a score beyond 64 bits is held at 64. Rows that
    repeat both id and vector count once; no row of a query's own id is its
    candidate. Other columns are not read. Empty table: empty result."""
    inf = float("inf")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("e"))
    fine = F.col("vec_id").isNotNull() & F.forall("e", lambda x: F.coalesce((F.abs(x) < inf) & ~F.isnan(x), F.lit(False)))
    good = materialize(rows.where(F.coalesce(fine, F.lit(False))).select("vec_id", "e", F.size("e").alias("dim")), "topk")
    sizes = good.agg(F.count("*"), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    n_x, n_q = max(1, -(-sizes[0] // CANDIDATES)), max(1, -(-sizes[1] // QUERIES))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(n_x)).cast("int")
    candidates = good.withColumn("x", block).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    # queries by their own hash, so that a block of them does not depend on the rows' order
    queries = good.where(F.col("vec_id") % every == 0).withColumn("q", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(n_q)).cast("int"))

    def read(blocks: Column, asking: DataFrame) -> DataFrame:
        """What the queries find in some blocks of candidates, ``k`` rows of
        each block at most."""
        dealt = candidates.where(F.col("x").isin(0) == blocks).select("dim", "q", "x", "vec_id", "e", F.lit(None).cast("double").alias("known"), F.lit(False).alias("is_query"))
        asked = asking.withColumn("x", F.explode(F.when(blocks, F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), F.lit(max(1, n_x - 1))))))
        asked = asked.select("dim", "q", "x", "vec_id", "e", "known", F.lit(True).alias("is_query"))
        found = dealt.unionByName(asked).groupBy("dim", "q", "x").applyInPandas(_resolver(k, float(scale)), "query_id long, vec_id long, score long")
        return materialize(found.distinct(), "topk")
    first = read(F.lit(True), queries.withColumn("known", F.lit(None).cast("double")))
    # a query of that id and length reaches at least this with k rows
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    known = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("known"))
    lengths = queries.groupBy("vec_id").agg(F.count("*").alias("n")).where("n = 1").select("vec_id")
    rest = read(F.lit(False), queries.join(known.join(lengths, "vec_id"), "vec_id", "left")) if n_x > 1 else first.limit(0)
    found = first.unionByName(rest)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
