"""Byte-level BPE: corpus-level merge replay.

The distinct pieces of a batch of texts stand in one row of symbols, a byte
each at first. An inverted index holds, for every pair of neighbours that some
token joins, where in the row it stands. Merges are replayed over all pieces at
once in the order of their ranks: the pair of least rank is looked up in the
index, joined wherever it still stands, and only the neighbours of those places
are entered anew. Pieces met before are remembered, so a piece is replayed once
however many texts hold it.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import Memory

PART = 8_000_000         # characters handled at a time (a longer text on its own)
KNOWN = 320_000          # pieces in a generation of those remembered
WIDE = re.compile("[\U00010000-\U0010ffff]")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file (base64 and rank a line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _matched(pattern: str, top: int) -> list[int]:
    """The code points up to ``top`` that tiktoken's pattern engine matches.
    Python's engines follow other versions of Unicode."""
    import tiktoken
    one_byte = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    found = []
    for low in range(0, top, 4096):
        text = "".join(chr(c) for c in range(low, low + 4096) if not 0xD800 <= c < 0xE000)
        found += map(ord, bytes(one_byte.encode_ordinary(text)).decode())
    return found


def _ranges(codes: list[int]) -> str:
    """A character class's inside for sorted code points."""
    cuts = np.flatnonzero(np.diff(codes) > 1)
    firsts, lasts = [codes[0], *(codes[i + 1] for i in cuts)], [*(codes[i] for i in cuts), codes[-1]]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(firsts, lasts, strict=True))


def pieces_pattern(top: int = 0x110000) -> re.Pattern:
    """``public_tokenizers.PATTERN`` for texts of code points below ``top``,
    its classes spelled out. Without the high planes Python tests a class by
    a table, which is several times faster."""
    letter, digit, space = (_ranges(_matched(p, top)) for p in (r"\p{L}", r"\p{N}", r"\s"))
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{digit}]+| ?[^{space}{letter}{digit}]+|[{space}]+(?![^{space}])|[{space}]+")


class Replay:
    """Pieces to ids by the ranks of a file."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {r: b for b, r in ranks.items()}
        if any(bytes([i]) not in ranks for i in range(256)):
            raise ValueError("every single byte needs a rank")
        self.byte_rank = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        # rank of what two bytes make, -1 if nothing
        self.two = np.array([[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)], np.int32)
        self.joined: dict[int, int] = {}                 # pair of ids, packed -> rank of what it makes, -1

    def _made(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of what each pair makes, -1 if nothing."""
        pairs, where = np.unique(left.astype(np.int64) << 32 | right, return_inverse=True)
        made = []
        for pair in pairs.tolist():
            if pair not in self.joined:
                self.joined[pair] = self.ranks.get(self.token[pair >> 32] + self.token[pair & 0xFFFFFFFF], -1)
            made.append(self.joined[pair])
        return np.array(made, np.int32)[where]

    def alone(self, piece: bytes) -> list[int]:
        """One piece, pair by pair: least rank first, leftmost first."""
        ids = [int(self.byte_rank[b]) for b in piece]
        while len(ids) > 1:
            made, i = min((r, i) for i in range(len(ids) - 1) if (r := self.ranks.get(self.token[ids[i]] + self.token[ids[i + 1]], len(self.token) + 2**40)) >= 0)
            if made >= 2**40:
                break
            ids[i:i + 2] = [made]
        return ids

    def __call__(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers.

        With ranks in the order in which a vocabulary was learned, joining a
        pair makes only pairs of higher rank. Should a table break that rule,
        the pieces where it happens are encoded one by one."""
        whole = [self.ranks.get(p) for p in pieces]
        split = [p for p, w in zip(pieces, whole, strict=True) if w is None and p]
        ids, ends, odd = self._replayed(split)
        out, at = [], 0
        for p, w in zip(pieces, whole, strict=True):
            if w is not None:
                out.append(w.to_bytes(4, "little"))
            elif not p:
                out.append(b"")
            else:
                out.append(np.array(self.alone(p), "<u4").tobytes() if at in odd else ids[4 * ends[at]:4 * ends[at + 1]])
                at += 1
        return out

    def _replayed(self, pieces: list[bytes]) -> tuple[bytes, list[int], set[int]]:
        """All ids, where each piece's begin (and the end of the last), and the
        numbers of pieces that made a pair of lower rank."""
        if not pieces:
            return b"", [0], set()
        row = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(row)
        ends = np.cumsum([len(p) for p in pieces])
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[ends - 1] = -1                                  # no pair reaches over a piece's end
        before[np.concatenate([[0], ends[:-1]])] = -1
        makes = np.full(n, -1, np.int32)                      # what each symbol and the next one make
        makes[:-1] = self.two[row[:-1], row[1:]]
        makes[ends - 1] = -1
        # the inverted index: what a pair makes -> where pairs that make it stand
        index: dict[int, list[np.ndarray]] = defaultdict(list)
        queue: list[int] = []

        def enter(at: np.ndarray, makes: np.ndarray) -> None:
            order = np.argsort(makes, kind="stable")
            at, makes = at[order], makes[order]
            cuts = np.flatnonzero(makes[1:] != makes[:-1]) + 1
            for rank, spots in zip(makes[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts), strict=True):
                if rank >= 0:
                    if rank not in index:
                        heapq.heappush(queue, rank)
                    index[rank].append(spots)

        sym, odd = self.byte_rank[row], []
        enter(np.arange(n, dtype=np.int32), makes)
        while queue:
            rank = heapq.heappop(queue)
            spots = np.unique(np.concatenate(index.pop(rank)))
            spots = spots[makes[spots] == rank]                # others lost a neighbour to an earlier merge
            if not len(spots):
                continue
            chained = np.flatnonzero(after[spots[:-1]] == spots[1:])
            if len(chained):                                  # aaa: from the left, every other one
                nth = np.arange(len(spots))
                first = nth.copy()
                first[chained + 1] = 0
                spots = spots[(nth - np.maximum.accumulate(first)) % 2 == 0]
            right = after[spots]
            beyond = after[right]
            near = np.flatnonzero(beyond[:-1] == spots[1:])   # joins side by side: the first meets the second's left half
            if len(near):
                met = self._made(np.full(len(near), rank, np.int32), sym[spots[near + 1]])
                odd += spots[near[(met >= 0) & (met <= rank)]].tolist()
            sym[spots], sym[right], makes[right] = rank, -1, -1
            after[spots] = beyond
            inner = beyond >= 0
            before[beyond[inner]] = spots[inner]
            # only the neighbours change
            makes[spots] = -1
            left = before[spots]
            left = left[left >= 0]
            changed = np.concatenate([left, spots[inner]])
            if len(changed):
                new = self._made(sym[changed], sym[after[changed]])
                makes[changed] = new
                odd += changed[(new >= 0) & (new <= rank)].tolist()
                enter(changed, new)
        alive = sym >= 0
        counts = np.concatenate([[0], np.cumsum(alive)])
        return sym[alive].astype("<u4").tobytes(), [0, *counts[ends].tolist()], set(np.searchsorted(ends, odd, side="right").tolist())


class Coder:
    """Whole texts to ids and back."""

    def __init__(self, path: str):
        self.replay = Replay(read_ranks(path))
        self.known = Memory(KNOWN)
        self.narrow, self.wide = pieces_pattern(0x10000), pieces_pattern()

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        part, held = [], 0
        for t in texts:
            part.append((self.wide if WIDE.search(t) else self.narrow).findall(t) if t else [])
            held += len(t or "")
            if held >= PART:
                yield from self._encode(part)
                part, held = [], 0
        yield from self._encode(part)

    def _encode(self, part: list[list[str]]) -> Iterator[bytes]:
        return map(b"".join, self.known.recall(part, lambda new: dict(zip(new, self.replay([p.encode() for p in new]), strict=True))))

    def decode(self, ids: bytes) -> bytes:
        """The bytes of little-endian unsigned 32-bit ids."""
        return b"".join(map(self.replay.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODERS: dict[str, Coder] = {}           # of this worker process


def coder(path: str) -> Coder:
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def encode(text: Column | str, path: str) -> Column:
    """Ids of whole texts by the rank file ``path``, as array<long>, equal to
    what the tiktoken library gives without special tokens. Null and empty
    text: no ids. No row depends on another, so ties, repeated rows, other
    columns and empty tables do not matter. A long text is taken whole."""
    @F.pandas_udf("array<long>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([np.frombuffer(x, "<u4").astype(np.int64) for x in coder(path).encode(texts)], dtype=object)
    return ids(text)


def decode(ids: Column | str, path: str) -> Column:
    """The bytes of an array of ids, as binary. Null: no bytes. An id that the
    file does not hold, or a null one, is an error."""
    @F.pandas_udf("binary")
    def raw(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lists in batches:
            yield pd.Series([b"" if x is None else coder(path).decode(np.asarray(x, "<u4").tobytes()) for x in lists], dtype=object)
    return raw(ids)


def round_trip(text: Column | str, path: str) -> Column:
    """Struct (ids binary, decoded binary): the ids of :func:`encode` as
    little-endian unsigned 32-bit integers, and the bytes they decode to."""
    @F.pandas_udf("ids binary, decoded binary")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            own = coder(path)
            ids = list(own.encode(texts))
            yield pd.DataFrame({"ids": ids, "decoded": [own.decode(x) for x in ids]}, dtype=object)
    return both(text)
