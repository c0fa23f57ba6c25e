"""Runs of repeated word sequences in whole texts, by suffix trees.

A run is a stretch of consecutive words with smallest period q that no
neighbouring word extends. Ukkonen's suffix trees of a document's words and of
their reversal give, through Euler tours and constant-time range minima, the
longest common extension of any two positions to the right and to the left. By
the runs theorem every run holds a Lyndon root: the longest Lyndon word at one of
its positions, in one of two opposite orders of the words. So each position's two
longest Lyndon words are extended both ways, and what is long enough is a run.

Words that no run of the asked length and exponent can hold are set apart first:
in such a run every three consecutive words stand several times (``least``), so
stretches between words of rarer triples are all that the trees have to hold.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

PART = 8_000_000         # characters handled at a time (a longer text on its own)
BLOCK = 16               # of the range minima


class RangeMin:
    """Least value of any range: minima of blocks in a sparse table, running
    minima from both ends inside a block."""

    def __init__(self, values: np.ndarray):
        n = -(-len(values) // BLOCK)
        self.rows = np.full((n, BLOCK), np.iinfo(np.int32).max, np.int32)
        self.rows.reshape(-1)[:len(values)] = values
        self.upto = np.minimum.accumulate(self.rows, axis=1).reshape(-1)
        self.onward = np.minimum.accumulate(self.rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        self.flat, self.table = self.rows.reshape(-1), [self.rows.min(axis=1)]
        while 2 ** len(self.table) <= n:
            half = 2 ** (len(self.table) - 1)
            last = self.table[-1]
            self.table.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least of values a..b, both included, for arrays of bounds."""
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        first, last = lo // BLOCK, hi // BLOCK
        out = np.minimum(self.onward[lo], self.upto[hi])
        same = np.flatnonzero(first == last)
        if len(same):
            at, end, least = lo[same], hi[same], self.flat[lo[same]]
            for _ in range(BLOCK - 1):
                at = np.minimum(at + 1, end)
                least = np.minimum(least, self.flat[at])
            out[same] = least
        wide = np.flatnonzero(last - first > 1)
        if len(wide):
            level = np.frexp(last[wide] - first[wide] - 1)[1] - 1
            for k in np.unique(level).tolist():
                w = wide[level == k]
                out[w] = np.minimum(out[w], np.minimum(self.table[k][first[w] + 1], self.table[k][last[w] - 2 ** k]))
        return out


class SuffixTree:
    """Ukkonen's suffix tree of a row of symbols whose last one stands nowhere
    else. Symbols below zero mark ends and sort before all others in both
    orders."""

    def __init__(self, row: list[int]):
        self.n = n = len(row)
        start, end, link, child = [0], [0], [0], {}
        node = edge = length = waiting = 0
        for i, c in enumerate(row):
            waiting, made = waiting + 1, 0
            while waiting:
                if not length:
                    edge = i
                key = (node, row[edge])
                to = child.get(key)
                if to is None:
                    child[key] = len(start)
                    start.append(i), end.append(n), link.append(0)
                    if made:
                        link[made], made = node, 0
                else:
                    size = min(end[to], i + 1) - start[to]
                    if length >= size:
                        edge, length, node = edge + size, length - size, to
                        continue
                    if row[start[to] + length] == c:
                        if made:
                            link[made] = node
                        length += 1
                        break
                    # split the edge, hang a leaf on the new node
                    between = len(start)
                    child[key] = between
                    start.append(start[to]), end.append(start[to] + length), link.append(0)
                    child[between, c] = between + 1
                    start.append(i), end.append(n), link.append(0)
                    start[to] += length
                    child[between, row[start[to]]] = to
                    if made:
                        link[made] = between
                    made = between
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        self.edges = np.array([(p, s, to) for (p, s), to in child.items()], np.int64).reshape(-1, 3)
        self.size = (np.array(end) - np.array(start)).tolist()
        self.inner = len(start)

    def _children(self, falling: bool) -> tuple[list[int], list[int]]:
        """Children of all nodes in order of their symbols, and where each
        node's begin."""
        parent, symbol, to = self.edges.T
        order = np.lexsort((np.where(falling & (symbol >= 0), -symbol, symbol - (symbol < 0) * 2**40), parent))
        return to[order].tolist(), np.searchsorted(parent[order], np.arange(self.inner + 1)).tolist()

    def tour(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Euler tour: the depth (in symbols) at every step, and for every
        suffix the step of its leaf and its rank."""
        kids, begin = self._children(False)
        depths, step, rank = [0], [0] * self.n, [0] * self.n
        path, seen, size, n = [(0, 0)], 0, self.size, self.n
        at = begin[:]
        while path:
            node, depth = path[-1]
            if at[node] == begin[node + 1]:
                path.pop()
                if path:
                    depths.append(path[-1][1])
                continue
            to = kids[at[node]]
            at[node] += 1
            deep = depth + size[to]
            if begin[to] == begin[to + 1]:                    # a leaf
                step[n - deep], rank[n - deep] = len(depths), seen
                seen += 1
                depths += (deep, depth)
            else:
                depths.append(deep)
                path.append((to, deep))
        return np.array(depths, np.int32), np.array(step), np.array(rank)

    def ranks(self) -> np.ndarray:
        """Ranks of the suffixes when the order of the symbols from zero up is
        turned round."""
        kids, begin = self._children(True)
        rank, seen, path, size = [0] * self.n, 0, [(0, 0)], self.size
        while path:
            node, depth = path.pop()
            if begin[node] == begin[node + 1]:
                rank[self.n - depth] = seen
                seen += 1
            else:
                path += [(to, depth + size[to]) for to in reversed(kids[begin[node]:begin[node + 1]])]
        return np.array(rank)


def lyndon_lengths(rank: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at each position: up to the next
    smaller suffix."""
    rank = rank.tolist()
    out, open_ = [0] * len(rank), []
    for i, r in enumerate(rank):
        while open_ and rank[open_[-1]] > r:
            j = open_.pop()
            out[j] = i - j
        open_.append(i)
    for j in open_:
        out[j] = len(rank) - j
    return np.array(out)


def find_runs(row: np.ndarray, min_length: int, min_exponent: int) -> np.ndarray:
    """Runs (start, length, period) by start and period, of words given as
    numbers from zero up; numbers below zero are ends that no run crosses.
    ``min_exponent`` is 2 at least."""
    marks = np.flatnonzero(row < 0)
    row = np.concatenate([[-1], row, [-1]])
    row[np.concatenate([[0], marks + 1, [len(row) - 1]])] = -1 - np.arange(len(marks) + 2)
    n = len(row)
    there, back = SuffixTree(row.tolist()), SuffixTree(row[::-1].tolist())
    depths, step, rank = there.tour()
    depths_back, step_back, _ = back.tour()
    onward, backward = RangeMin(depths), RangeMin(depths_back)
    found = []
    for order in (rank, there.ranks()):
        i = np.flatnonzero(row >= 0)
        p = lyndon_lengths(order)[i]
        right = onward(step[i], step[i + p])
        left = backward(step_back[n - i], step_back[n - i - p])
        start, length = i - left, left + p + right
        good = length >= np.maximum(min_length, min_exponent * p)
        found.append(np.stack([start[good] - 1, length[good], p[good]], axis=1))
    return np.unique(np.concatenate(found), axis=0)


def least_triples(min_length: int, min_exponent: int) -> int:
    """How often, at least, each three consecutive words of a run stand in it."""
    shortest = [(max(min_length, min_exponent * q) - 2) // q for q in range(1, min_length + 1)]
    return max(0, min(*shortest, min_exponent - 1))


def stretches(words: np.ndarray, doc: np.ndarray, min_length: int, min_exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches that can hold runs; no run is cut. All
    documents of a batch at once: ``words`` one after another, ``doc`` the
    number of each one's document."""
    n, least = len(words), least_triples(min_length, min_exponent)
    if least < 2:                                             # triples tell nothing: whole documents
        cut = np.flatnonzero(doc[1:] != doc[:-1]) + 1
        return (np.concatenate([[0], cut]), np.concatenate([cut, [n]])) if n else (cut, cut)
    # triples as numbers, only inside a document
    at = np.flatnonzero(doc[2:] == doc[:-2]) if n > 2 else np.zeros(0, np.int64)
    _, pair = np.unique(words[:-1].astype(np.int64) << 32 | words[1:], return_inverse=True) if n > 1 else (0, words)
    _, triple = np.unique(pair[at].astype(np.int64) << 32 | words[at + 2], return_inverse=True)
    part = doc[at]
    while True:
        _, where, count = np.unique(part.astype(np.int64) << 32 | triple, return_inverse=True, return_counts=True)
        often = count[where] >= least
        new_part = np.cumsum(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (part[1:] != part[:-1]) | ~often[1:] | ~often[:-1]])[:len(at)])
        wide = np.bincount(new_part[often], minlength=len(at) + 2)
        keep = often & (wide[new_part] + 2 >= min_length)
        if keep.all():
            break
        at, triple, part = at[keep], triple[keep], new_part[keep]
    if not len(at):
        return at, at
    cut = np.flatnonzero(new_part[1:] != new_part[:-1]) + 1
    return at[np.concatenate([[0], cut])], at[np.concatenate([cut - 1, [len(at) - 1]])] + 3


def collapse(texts: Iterable[str], min_length: int, min_exponent: int) -> Iterator[tuple[np.ndarray, str]]:
    """For each text its runs and the words that no run drops, joined by one
    space."""
    lists = [(t or "").encode().split() for t in texts]
    sizes = np.array([len(x) for x in lists], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    words = pa.array([w for x in lists for w in x], pa.large_binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(lists)), sizes)
    starts, ends = stretches(words, doc, min_length, min_exponent)
    owner = doc[starts] if len(starts) else starts
    for d, held in enumerate(lists):
        mine = range(*np.searchsorted(owner, [d, d + 1]))
        if not mine:
            yield np.zeros((0, 3), np.int64), b" ".join(held).decode()
            continue
        # the stretches one after another, an end after each; back maps to word numbers
        row = np.concatenate([x for s in mine for x in (words[starts[s]:ends[s]], [-1])])
        back = np.concatenate([x for s in mine for x in (np.arange(starts[s], ends[s]), [-1])]) - begin[d]
        runs = find_runs(row, min_length, min_exponent)
        runs[:, 0] = back[runs[:, 0]]
        runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
        drop = np.zeros(len(held) + 1, np.int64)
        np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
        np.add.at(drop, runs[:, 0] + runs[:, 1], -1)
        kept = np.cumsum(drop[:-1]) == 0
        yield runs, b" ".join([w for w, k in zip(held, kept.tolist(), strict=True) if k]).decode()


def periodic_runs(text: Column | str, min_length: int = 6, min_exponent: int = 4) -> Column:
    """Struct (runs array<struct<start, length, period>>, collapsed string) of a
    whole text: its runs of at least ``min_length`` words and ``min_exponent``
    (a whole number from 2 up) periods, by start and period, words numbered
    from 0; and the text without what repeats: of each run only the first
    period stays, words joined by one space.

    Words are separated by ASCII white space. Null, empty or blank text: no
    runs, empty collapsed text. No row depends on another, so ties, repeated
    rows, other columns and empty tables do not matter. Long texts are taken
    whole: trees and tours grow with a text's length."""
    @F.pandas_udf("start array<long>, length array<long>, period array<long>, collapsed string")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            part, held, out = [], 0, []
            for t in texts:
                part.append(t)
                held += len(t or "")
                if held >= PART:
                    out += collapse(part, min_length, min_exponent)
                    part, held = [], 0
            out += collapse(part, min_length, min_exponent)
            yield pd.DataFrame({"start": [r[:, 0] for r, _ in out], "length": [r[:, 1] for r, _ in out],
                                "period": [r[:, 2] for r, _ in out], "collapsed": [c for _, c in out]}, dtype=object)
    f = found(text)
    return F.struct(F.arrays_zip(f["start"], f["length"], f["period"]).alias("runs"), f["collapsed"].alias("collapsed"))
