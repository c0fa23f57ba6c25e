"""SentencePiece encoding and decoding by suffix-array matching.

The distinct words of a batch are concatenated and indexed by a suffix array
(sorted by up to the longest piece's length). Every piece is binary-searched
for the range of suffixes that begin with it; the occurrences are the edges of
a lattice, sorted by position. Relaxing the lattice gives the segmentation: a
unigram model takes the best-scored path; a BPE model, whose scores are merge
ranks and not path costs, contracts in every word the best-scored edge that
spans two neighbouring segments until none is left, which is the library's
segmentation. Words are cut where no piece can reach across: before a space
mark that follows another character, at line ends if no piece holds one, and
between a letter and a punctuation mark that no piece holds side by side.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import Memory, tidied

MARK = "▁"
ROWS = 1000               # texts encoded before their ids are handed on
PART = 3_000_000          # characters of text encoded at a time
INDEX = 400_000           # characters of a suffix array, if no single word is longer
KNOWN = 150_000           # words in a generation of those remembered
SPAN = 1 << 15            # characters of a word above which it is relaxed on its own
NONE = np.iinfo(np.int32).max


def _word_pattern(pieces: list[str]) -> re.Pattern:
    """Words no piece reaches out of (see the module's text)."""
    beside = {(a, b) for p in pieces for a, b in zip(p, p[1:], strict=False)}
    alone = "\n" if not any("\n" in p for p in pieces) else ""
    cut = "".join(c for c in ".,!|%&*#$" if not any(re.match(r"[^\W\d_]", x) and y == c for x, y in beside))
    if not cut:
        return re.compile(f"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+|[{MARK}{alone}]")
    # a word ends after its letters if one of the marks above follows
    cut = re.escape(cut)
    return re.compile(f"{MARK}*[^\\W\\d_]+(?=[{cut}])|{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+|[{MARK}{alone}]")


class Model:
    """What is needed of a sentencepiece model file (identity normalizer)."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb
        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only identity normalization is implemented")
        if m.trainer_spec.model_type not in (1, 2):
            raise ValueError("unigram and BPE models only")
        self.bpe = m.trainer_spec.model_type == 2
        self.dummy_prefix = m.normalizer_spec.add_dummy_prefix
        self.pieces = [p.piece for p in m.pieces]
        kinds = [p.type for p in m.pieces]
        if 4 in kinds:
            raise ValueError("user-defined pieces are not implemented")
        self.unk = kinds.index(2)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == 6}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.is_byte = np.array([k == 6 for k in kinds])
        self.shown = ["" if k == 3 else " ⁇ " if k == 2 else p.replace(MARK, " ") for p, k in zip(self.pieces, kinds, strict=True)]
        own = [(p.piece, i, p.score) for i, p in enumerate(m.pieces) if p.type == 1]
        if any(re.search(f"[^{MARK}]{MARK}", p) for p, _, _ in own):
            raise ValueError("a piece crosses a space")
        self.words = _word_pattern([p for p, _, _ in own])
        self.alphabet = {c: i + 1 for i, c in enumerate(sorted({c for p, _, _ in own for c in p}))}
        self.longest = max(len(p) for p, _, _ in own)
        self.scores = np.zeros(len(self.pieces))
        for _, i, s in own:
            self.scores[i] = s
        # rank: position in descending score, the lower the earlier a merge
        order = sorted(own, key=lambda x: (-x[2], x[1]))
        self.rank = np.full(len(self.pieces), NONE, np.int64)
        self.rank[[i for _, i, _ in order]] = np.arange(len(order))
        table = np.zeros((len(own), self.longest), np.int64)
        for r, (p, _, _) in enumerate(own):
            table[r, :len(p)] = [self.alphabet[c] for c in p]
        self.codes, self.lengths, self.ids = table, np.array([len(p) for p, _, _ in own]), np.array([i for _, i, _ in own])


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` (codes, 0 = separator) sorted by their first
    ``depth`` codes at least, by prefix doubling."""
    n, width = len(text), 4
    padded = np.concatenate([text, np.zeros(width, text.dtype)])
    key = _packed(padded[:n], padded[1:n + 1], padded[2:n + 2], padded[3:n + 3])
    order, rank = np.argsort(key), None
    while width < depth or rank is None:
        if rank is not None:
            key = rank << 32
            key[:n - width] |= rank[width:] if width < n else 0
            order = np.argsort(key)
            width *= 2
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        if rank.max(initial=0) == n:
            break
    return order


def _packed(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return (a << 48) | (b << 32) | (c << 16) | d


def piece_ranges(text: np.ndarray, order: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """For every piece, by binary search, the range of suffixes that begin
    with it (first, one past the last)."""
    pad = np.concatenate([text, np.zeros(max(4, model.longest), text.dtype)])
    heads = _packed(pad[order], pad[order + 1], pad[order + 2], pad[order + 3])
    c = np.pad(model.codes, ((0, 0), (0, 4)))
    head = _packed(c[:, 0], c[:, 1], c[:, 2], c[:, 3])
    # the first four characters narrow the range at once; shorter pieces are done
    begin = np.searchsorted(heads, head, "left")
    end = np.searchsorted(heads, head + (np.int64(1) << (16 * (4 - np.minimum(model.lengths, 4)))), "left")
    long = model.lengths > 4

    def search(after: bool) -> np.ndarray:
        lo, hi = np.where(long | (not after), begin, end), np.where(long | after, end, begin)
        while (lo < hi).any():
            on = np.nonzero(lo < hi)[0]
            mid = (lo[on] + hi[on]) // 2
            start = order[mid]
            state = np.zeros(len(on), np.int8)         # suffix against piece: -1 below, 0 begins with it, 1 above
            for k in range(model.longest):
                live = (state == 0) & (k < model.lengths[on])
                if not live.any():
                    break
                c, p = pad[start[live] + k], model.codes[on[live], k]
                state[live] = np.sign(c - p)
            right = state < 0 if not after else state <= 0
            lo[on[right]], hi[on[~right]] = mid[right] + 1, mid[~right]
        return lo
    return search(False), search(True)


def edges(text: np.ndarray, model: Model) -> np.ndarray:
    """Occurrences of all pieces, sorted by position: a table with a row for
    each position and a column for each length, holding piece ids (0: none)."""
    order = suffix_array(text, model.longest)
    first, last = piece_ranges(text, order, model)
    count = last - first
    which = np.repeat(np.arange(len(count)), count)
    at = order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[which]]
    table = np.zeros((len(text), model.longest + 1), np.uint16 if len(model.pieces) < 65536 else np.int32)
    table[at, model.lengths[which]] = model.ids[which]
    return table


def _contract(start: np.ndarray, size: np.ndarray, table: np.ndarray, model: Model) -> list[np.ndarray]:
    """BPE: segment ends of each word, contracting the best-ranked edge over
    two neighbouring segments, leftmost first, in all words in step."""
    rank = model.rank
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(start)
    by_size = np.argsort(size, kind="stable")
    lo = 0
    while lo < len(by_size):
        hi = lo + 1                                    # words of similar size share a matrix
        limit = max(8, int(size[by_size[lo]] * 1.5))
        hi = int(np.searchsorted(size[by_size], limit, side="right"))
        hi = min(hi, lo + max(1, 2_000_000 // limit))
        rows = by_size[lo:hi]
        lo = hi
        width = int(size[rows].max())
        ends = np.minimum(np.arange(1, width + 1)[None, :], size[rows][:, None]) + np.zeros((len(rows), 1), np.int64)
        count = size[rows].copy()

        def price(r, left, end):
            """Rank of the edge from position ``left`` to ``end`` of row r's word."""
            length = end - left
            fits = (length >= 2) & (length <= model.longest)
            piece = table[np.where(fits, start[rows[r]] + left, 0), np.where(fits, length, 0)]
            return np.where(fits & (piece > 0), rank[piece], NONE)
        cost = np.full((len(rows), max(1, width)), NONE, np.int64)       # of contracting segments i and i + 1
        if width > 1:
            r = np.repeat(np.arange(len(rows)), width - 1)
            i = np.tile(np.arange(width - 1), len(rows))
            real = i + 1 < count[r]
            cost[r[real], i[real]] = price(r[real], i[real], i[real] + 2)
        live = np.arange(len(rows))
        while len(live):
            best = cost[live].argmin(axis=1)
            ok = cost[live, best] < NONE
            live, best = live[ok], best[ok]
            if not len(live):
                break
            # remove the border after segment ``best``: shift what follows to the left
            cols = np.arange(width)[None, :]
            take = np.minimum(cols + (cols >= best[:, None]), width - 1)
            ends[live] = np.take_along_axis(ends[live], take, axis=1)
            moved = np.minimum(cols + (cols >= best[:, None]), width - 1)
            new = np.take_along_axis(cost[live], moved, axis=1)
            count[live] -= 1
            new[np.arange(width)[None, :] >= (count[live] - 1)[:, None]] = NONE
            cost[live] = new
            left = np.where(best > 0, np.take_along_axis(ends[live], np.maximum(best - 1, 0)[:, None], axis=1)[:, 0], 0)
            more = best + 1 < count[live]
            nxt = np.minimum(best + 1, width - 1)
            cost[live[more], best[more]] = price(live[more], left[more], ends[live[more], nxt[more]])
            back = best > 0
            begin = np.where(best > 1, np.take_along_axis(ends[live], np.maximum(best - 2, 0)[:, None], axis=1)[:, 0], 0)
            cost[live[back], best[back] - 1] = price(live[back], begin[back], ends[live[back], best[back]])
        for r, w in enumerate(rows):
            out[w] = ends[r, :count[r]]
    return out


def _contract_long(begin: int, size: int, table: np.ndarray, model: Model) -> np.ndarray:
    """The same for one very long word, with a heap of edges."""
    import heapq
    after, before = np.arange(1, size + 1), np.arange(-1, size - 1)
    end, alive, heap = np.arange(1, size + 1), np.ones(size, bool), []

    def push(i: int) -> None:
        j = after[i]
        if j < size and end[j] - i <= model.longest and (p := table[begin + i, end[j] - i]):
            heapq.heappush(heap, (int(model.rank[p]), i, int(end[j])))
    for i in range(size - 1):
        push(i)
    while heap:
        _, i, to = heapq.heappop(heap)
        j = after[i] if alive[i] else size
        if j >= size or end[j] != to:
            continue
        end[i], alive[j], after[i] = to, False, after[j]
        if after[j] < size:
            before[after[j]] = i
        push(i)
        if before[i] >= 0:
            push(int(before[i]))
    return end[alive]


def _best_path(begin: int, size: int, table: np.ndarray, model: Model) -> np.ndarray:
    """Unigram: forward relaxation over the edges in position order. A
    character without an edge costs 10 below the least score."""
    least = float(model.scores.min()) - 10
    best, back = np.full(size + 1, -np.inf), np.zeros(size + 1, np.int64)
    best[0] = 0
    for i in range(size):
        row = table[begin + i]
        found = np.nonzero(row)[0]
        for n in found[found <= size - i]:
            s = best[i] + model.scores[row[n]]
            if s > best[i + n]:
                best[i + n], back[i + n] = s, i
        if not row[1] and best[i] + least > best[i + 1]:
            best[i + 1], back[i + 1] = best[i] + least, i
    ends, at = [], size
    while at > 0:
        ends.append(at)
        at = int(back[at])
    return np.array(ends[::-1], np.int64)


class Codec:
    """Encodes and decodes whole texts with a sentencepiece model file."""

    def __init__(self, path: str):
        self.model = Model(path)
        self.known = Memory(KNOWN)

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        part, held = [], 0
        for t in texts:
            text = (MARK if self.model.dummy_prefix else "") + t.replace(" ", MARK) if t else ""
            part.append(text)
            held += len(text)
            if held >= PART:
                yield from self._encode(part)
                part, held = [], 0
        yield from self._encode(part)

    def _encode(self, part: list[str]) -> Iterator[np.ndarray]:
        for got in self.known.recall(map(self.model.words.findall, part), self._indexed):
            yield np.frombuffer(b"".join(got), np.int32)

    def _indexed(self, new: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        lo = 0
        while lo < len(new):
            hi, held = lo, 0
            while hi < len(new) and (held == 0 or held + len(new[hi]) < INDEX):
                held += len(new[hi]) + 1
                hi += 1
            out.update(zip(new[lo:hi], self._index(new[lo:hi]), strict=True))
            lo = hi
        return out

    def _index(self, words: list[str]) -> list[bytes]:
        m = self.model
        joined = "\0".join(words) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.zeros(max(int(points.max()), max(map(ord, m.alphabet))) + 1, np.int64)
        code[[ord(c) for c in m.alphabet]] = list(m.alphabet.values())
        unknown = len(m.alphabet) + 1
        size = np.array([len(w) for w in words])
        start = np.cumsum(size + 1) - size - 1
        text = np.where(code[points] > 0, code[points], unknown)
        text[start + size] = 0
        table = edges(text, m)
        if m.bpe:
            ends: list = [None] * len(words)
            short = np.nonzero(size <= SPAN)[0]
            for w, e in zip(short, _contract(start[short], size[short], table, m), strict=True):
                ends[w] = e
            for w in np.nonzero(size > SPAN)[0]:
                ends[w] = _contract_long(int(start[w]), int(size[w]), table, m)
        else:
            ends = [_best_path(int(b), int(s), table, m) for b, s in zip(start, size, strict=True)]
        lengths = np.array([len(e) for e in ends])
        flat = np.concatenate(ends)
        word = np.repeat(np.arange(len(words)), lengths)
        first = np.concatenate([[True], word[1:] != word[:-1]])
        begin = np.where(first, 0, np.concatenate([[0], flat[:-1]]))
        ids = table[start[word] + begin, np.minimum(flat - begin, m.longest)].astype(np.int32)
        raw, to = ids.tobytes(), (4 * np.cumsum(lengths)).tolist()
        out = [raw[a:b] for a, b in zip([0, *to[:-1]], to, strict=True)]
        for w in np.unique(word[ids == 0]):            # characters no piece covers
            out[w] = self._fall_back(words[w], ends[w], np.frombuffer(out[w], np.int32)).tobytes()
        return out

    def _fall_back(self, word: str, ends: np.ndarray, ids: np.ndarray) -> np.ndarray:
        m, out, begin, was_unknown = self.model, [], 0, False
        for end, i in zip(ends, ids, strict=True):
            if i:
                out.append(int(i))
            elif m.bytes:
                out += [m.bytes[b] for b in word[begin:end].encode("utf-8", "surrogatepass")]
            elif not was_unknown:
                out.append(m.unk)
            was_unknown, begin = not i, end
        return np.array(out, np.int32)

    def decode(self, ids: Iterable[int]) -> str:
        """Pieces joined, runs of byte pieces decoded, marks turned into spaces
        and the space that encoding put first removed."""
        m = self.model
        ids = np.asarray(ids, np.int64)
        raw = m.is_byte[ids]
        if raw.any():
            border = np.concatenate([[0], np.flatnonzero(raw[1:] != raw[:-1]) + 1, [len(ids)]])
            text = "".join(bytes(map(m.byte_of.__getitem__, ids[a:b].tolist())).decode("utf-8", "replace") if raw[a]
                           else "".join(map(m.shown.__getitem__, ids[a:b].tolist())) for a, b in zip(border[:-1], border[1:], strict=True))
        else:
            text = "".join(map(m.shown.__getitem__, ids.tolist()))
        return text[1:] if m.dummy_prefix and text[:1] == " " else text


_CODECS: dict[str, Codec] = {}       # of this worker process


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _parts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The batches in parts of ``ROWS`` rows, so that few results are held at once."""
    for s in batches:
        for lo in range(0, len(s), ROWS):
            yield s.iloc[lo:lo + ROWS]


def encode(text: Column, path: str) -> Column:
    """Piece ids (array<int>) of whole texts. Null or empty text: empty array.
    Other columns are not touched."""
    @F.pandas_udf("array<int>")
    @tidied
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in _parts(batches):
            yield pd.Series(list(codec(path).encode(s)), dtype=object)
    return run(text)


def decode(ids: Column, path: str) -> Column:
    """Text of piece ids. Null ids: null."""
    @F.pandas_udf("string")
    @tidied
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in _parts(batches):
            yield pd.Series([None if x is None else codec(path).decode(x) for x in s], dtype=object)
    return run(ids)


def round_trip(text: Column, path: str) -> Column:
    """Struct of ids and whether decoding them gives the text back (the mark
    itself decodes to a space; null counts as empty)."""
    @F.pandas_udf("ids array<int>, same boolean")
    @tidied
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in _parts(batches):
            c = codec(path)
            ids = list(c.encode(s))
            yield pd.DataFrame({"ids": ids, "same": [c.decode(i) == (t or "").replace(MARK, " ") for i, t in zip(ids, s, strict=True)]})
    return run(text)
