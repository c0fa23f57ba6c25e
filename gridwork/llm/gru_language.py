"""Language identification by a bidirectional gated recurrent network over
bytes, in numpy, trained by backpropagation through time.

A text's bytes are cut into windows that together cover all of it. In each
window one recurrent pass reads forward and one backward; both states label
every position with language probabilities, and a document's probabilities are
the means over all its positions.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash01, is_held_out, tidied

SPAN = 64             # bytes of a window
HIDDEN = 8            # units of each direction
FIT = 400             # documents of each language to learn from, about
STEPS, BATCH, RATE = 260, 128, 0.03
TOGETHER = 4096       # windows that run in step
UNDETERMINED = "und"


def cut(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Windows of a text: SPAN x n bytes, and the length of each."""
    n = -(-len(data) // SPAN)
    raw = np.zeros(n * SPAN, np.uint8)
    raw[:len(data)] = np.frombuffer(data, np.uint8)
    return raw.reshape(n, SPAN).T, np.minimum(SPAN, len(data) - SPAN * np.arange(n))


@dataclass(frozen=True)
class Model:
    """For each direction the byte table (256 x 3h: update, reset, candidate),
    the recurrent weights (h x 2h gates, h x h candidate); the output weights
    (2h x languages) and bias."""
    languages: tuple[str, ...]
    table: np.ndarray
    gates: np.ndarray
    state: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def positions(self, data: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Probabilities at every position: SPAN x windows x languages."""
        held = [_states(data, length, self.table[d], self.gates[d], self.state[d], d) for d in (0, 1)]
        h = self.bias.size, HIDDEN
        logits = (held[0].reshape(-1, h[1]) @ self.out[:h[1]] + held[1].reshape(-1, h[1]) @ self.out[h[1]:] + self.bias)
        logits -= functools.reduce(np.maximum, logits.T)[:, None]       # by column: there are few languages
        np.exp(logits, out=logits)
        logits /= functools.reduce(np.add, logits.T)[:, None]
        return logits.reshape(SPAN, -1, h[0])

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities of each text's positions (zeros if it has none)."""
        total = np.zeros((len(texts), len(self.languages)))
        parts: list = []
        held = 0

        def flush():
            data = np.concatenate([p[1] for p in parts], axis=1)
            length = np.concatenate([p[2] for p in parts])
            owner = np.repeat([p[0] for p in parts], [p[1].shape[1] for p in parts])
            for lo in range(0, data.shape[1], TOGETHER):
                x, n, who = data[:, lo:lo + TOGETHER], length[lo:lo + TOGETHER], owner[lo:lo + TOGETHER]
                p = self.positions(x, n)
                p *= (np.arange(SPAN)[:, None] < n[None, :])[:, :, None]
                np.add.at(total, who, p.sum(axis=0, dtype=np.float64))
        for i, t in enumerate(texts):
            if t:
                parts.append((i, *cut(t)))
                held += parts[-1][1].shape[1]
            if held >= TOGETHER or (parts and i == len(texts) - 1):
                flush()
                parts, held = [], 0
        return total / np.maximum(total.sum(axis=1, keepdims=True), 1e-12)


def _run(data: np.ndarray, length: np.ndarray, table: np.ndarray, gates: np.ndarray, state: np.ndarray, back: int):
    """States at every position in one direction; past a window's end the
    state stays zero. Also what backpropagation needs."""
    n, h = data.shape[1], state.shape[0]
    held = np.zeros((SPAN, n, h), np.float32)
    kept = np.empty((SPAN, n, 3 * h), np.float32)
    s = np.zeros((n, h), np.float32)
    full = length >= SPAN
    whole = full.all()
    for t in range(SPAN - 1, -1, -1) if back else range(SPAN):
        x = table[data[t]]
        g = s @ gates
        g += x[:, :2 * h]
        g *= 0.5
        np.tanh(g, out=g)
        g += 1
        g *= 0.5                                   # update and reset gates
        c = (g[:, h:] * s) @ state
        c += x[:, 2 * h:]
        np.tanh(c, out=c)
        kept[t, :, :2 * h], kept[t, :, 2 * h:] = g, c
        s = s + g[:, :h] * (c - s)
        if not whole:
            s *= (t < length)[:, None]
        held[t] = s
    return held, kept


def _states(data: np.ndarray, length: np.ndarray, table: np.ndarray, gates: np.ndarray, state: np.ndarray, back: int) -> np.ndarray:
    """The states of :func:`_run` alone, in place, each gate in an array of its
    own. A gate is (1 + tanh(x / 2)) / 2; its halves are drawn into the weights."""
    n, h = data.shape[1], state.shape[0]
    byte = [np.ascontiguousarray(table[:, k * h:(k + 1) * h] * np.float32(0.5 if k < 2 else 1)) for k in range(3)]
    weights = [np.ascontiguousarray(gates[:, :h] * np.float32(0.5)), np.ascontiguousarray(gates[:, h:] * np.float32(0.5)), state * np.float32(0.5)]
    held = np.empty((SPAN, n, h), np.float32)
    x, z, r, c = (np.empty((n, h), np.float32) for _ in range(4))
    s = np.zeros((n, h), np.float32)
    whole = (length >= SPAN).all()

    def squash(at: np.ndarray, k: int, before: np.ndarray, out: np.ndarray) -> None:
        np.matmul(before, weights[k], out=out)
        byte[k].take(at, axis=0, out=x, mode="clip")
        out += x
        np.tanh(out, out=out)
    for t in range(SPAN - 1, -1, -1) if back else range(SPAN):
        squash(data[t], 0, s, z)
        squash(data[t], 1, s, r)
        r += 1                                     # twice the reset gate
        r *= s
        squash(data[t], 2, r, c)
        z += 1                                     # twice the update gate
        c -= s
        c *= z
        c *= 0.5
        s = np.add(s, c, out=held[t])
        if not whole:
            s *= (t < length)[:, None]
    return held


def loss_and_gradients(w: list[np.ndarray], data: np.ndarray, length: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy over all positions of the windows, and its gradient
    in each weight by backpropagation through time."""
    n, h, k = data.shape[1], w[2].shape[1], w[4].size
    runs = [_run(data, length, w[0][d], w[1][d], w[2][d], d) for d in (0, 1)]
    both = np.concatenate([runs[0][0], runs[1][0]], axis=2)
    logits = both @ w[3] + w[4]
    p = np.exp(logits - logits.max(axis=2, keepdims=True))
    p /= p.sum(axis=2, keepdims=True)
    there = ((np.arange(SPAN)[:, None] < length[None, :]) / max(1, length.sum()))
    loss = -float((np.log(p[:, np.arange(n), y]) * there).sum())
    p[:, np.arange(n), y] -= 1
    p *= there[:, :, None]
    grad = [np.zeros_like(x) for x in w]
    grad[3] = both.reshape(-1, 2 * h).T @ p.reshape(-1, k)
    grad[4] = p.sum(axis=(0, 1))
    up = p @ w[3].T
    for d in (0, 1):
        held, kept = runs[d]
        ds = np.zeros((n, h), np.float32)
        order = range(SPAN) if d else range(SPAN - 1, -1, -1)
        for t in order:
            before = t + 1 if d else t - 1
            s = held[before] if 0 <= before < SPAN else np.zeros((n, h), np.float32)
            z, r, c = kept[t, :, :h], kept[t, :, h:2 * h], kept[t, :, 2 * h:]
            ds = (ds + up[t, :, d * h:(d + 1) * h]) * (t < length)[:, None]
            dc = ds * z * (1 - c * c)
            dz = ds * (c - s) * z * (1 - z)
            drs = dc @ w[2][d].T
            dr = drs * s * r * (1 - r)
            dg = np.concatenate([dz, dr], axis=1)
            grad[2][d] += (r * s).T @ dc
            grad[1][d] += s.T @ dg
            np.add.at(grad[0][d], data[t], np.concatenate([dg, dc], axis=1))
            ds = ds * (1 - z) + drs * r + dg @ w[1][d].T
    return loss, grad


def train(texts: list[bytes], marks: list[str], seed: int = 7) -> Model:
    """Cross entropy at every position, Adam, gradients by backpropagation
    through time. Languages weigh alike however many documents they have."""
    languages = tuple(sorted(set(marks)))
    k, h, rng = len(languages), HIDDEN, np.random.default_rng(seed)
    if not k:
        empty = np.zeros((2, 256, 3 * h), np.float32)
        return Model((), empty, empty[:, :h, :2 * h], empty[:, :h, :h], np.zeros((2 * h, 0), np.float32), np.zeros(0, np.float32))
    pool: list = []
    for lang in languages:
        own = [cut(t) for t, m in zip(texts, marks, strict=True) if m == lang and t]
        pool.append((np.concatenate([d for d, _ in own], axis=1), np.concatenate([n for _, n in own])) if own else (np.zeros((SPAN, 1), np.uint8), np.zeros(1, int)))

    def start(*shape):
        return (rng.standard_normal(shape) * 0.3).astype(np.float32)
    w = [start(2, 256, 3 * h), start(2, h, 2 * h), start(2, h, h), start(2 * h, k), np.zeros(k, np.float32)]
    first, second = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    for step in range(1, STEPS + 1):
        y = rng.integers(0, k, BATCH)
        at = [rng.integers(0, pool[i][0].shape[1]) for i in y]
        data = np.stack([pool[i][0][:, a] for i, a in zip(y, at, strict=True)], axis=1)
        length = np.array([pool[i][1][a] for i, a in zip(y, at, strict=True)])
        _, grad = loss_and_gradients(w, data, length, y)
        size = np.sqrt(sum(float((g * g).sum()) for g in grad))
        rate = RATE * (1 - 0.9 * step / STEPS)
        for x, g, m, v in zip(w, grad, first, second, strict=True):
            g = g * min(1.0, 1.0 / max(size, 1e-9))
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= (rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return Model(languages, *w)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Train on the whole texts of a bounded sample (about ``FIT`` documents of
    each language) of the documents that are not held out and have a language
    and text. Only text and language are learned from; the id decides which
    documents are in the sample.

    Documents with a null id are held out. Repeated rows are learned from as
    often as they are there; documents that differ in nothing but the language
    are learned under each. Other columns are not read. Nothing to learn from
    (an empty table, too): a model of no language, which finds ``und``
    everywhere. Languages that score alike: the first by name."""
    own = docs.where(F.col(lang_col).isNotNull() & ~is_held_out(id_col) & (F.length(text_col) > 0))
    counts = {r[0]: r[1] for r in own.groupBy(F.col(lang_col).alias("l")).count().collect()}
    if not counts:
        return train([], [])
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, FIT / n))]), F.col(lang_col))
    rows = own.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_l"), F.col(text_col).alias("_t"), share.alias("_s"))
    rows = rows.where(hash01("_id") < F.col("_s")).orderBy("_id", "_t", "_l").collect()
    return train([r._t.encode("utf-8", "surrogatepass") for r in rows], [r._l for r in rows])


def predict(text: Column, model: Model) -> Column:
    """Struct of lang_pred and score (mean probability of that language) for a
    whole text. ``und`` with score 0 if the text is null or has no letter, or
    if no language was learned."""
    @F.pandas_udf("lang_pred string, score double")
    @tidied
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            ok = np.array([t is not None and any(map(str.isalpha, t)) for t in s], bool)
            lang, score = np.full(len(s), UNDETERMINED, object), np.zeros(len(s))
            if model.languages and ok.any():
                p = model.pooled([t.encode("utf-8", "surrogatepass") if o else b"" for t, o in zip(s, ok, strict=True)])
                best = p.argmax(axis=1)
                lang[ok] = np.array(model.languages, object)[best[ok]]
                score[ok] = p[np.arange(len(s)), best][ok]
            yield pd.DataFrame({"lang_pred": lang, "score": score})
    return run(text)


def identified(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """The rows whose text has a language: not ``und``, and scored ``least`` or
    more. All columns as they were."""
    p = predict(F.col(text_col), model)
    kept = docs.select(*[docs[c] for c in docs.columns], p.alias("__language"))
    return kept.where((F.col("__language.lang_pred") != UNDETERMINED) & (F.col("__language.score") >= least)).drop("__language")
