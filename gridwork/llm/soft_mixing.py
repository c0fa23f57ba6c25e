"""Mixing sources to target weights by soft membership.

A classifier fitted on a labelled table predicts for each document the
probabilities of its domains. Nonnegative document rates are then fitted by
projected gradient descent on the least squares distance between the expected
tokens of the domains and their targets; a rate says how often a document is
expected in the mix. DataFrame functions only.
"""

from __future__ import annotations

import logging
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash01, materialize, split_no

FIT = 20_000              # labelled documents the classifier is fitted on, about, at most
BUCKETS = 1 << 14         # hashed words
DOUBT = 4.0               # standard deviations at which a word's weight counts half
RIDGE = 1.0               # pull of the calibration's slopes towards zero
CLOSE = 1e-6              # a fit ends when a step moves the mix's tokens by less than this share
MET = 0.01                # relative distance up to which a target counts as met
log = logging.getLogger(__name__)


def _words(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s.,]+|(?<=\pL)(?=[^\pL\s.,])")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


class Classifier:
    """Weights of hashed words for each domain (evidence is their sum over a
    text's different words), and the calibration: logits of the domains, each
    linear in the evidence."""

    def __init__(self, domains: list[str], prior: list[float], weights: list[list[float]]):
        self.domains, self.prior, self.weights = domains, prior, weights
        self.bias = [math.log(max(p, 1e-12)) for p in prior]
        self.slopes = [[0.0] * len(domains) for _ in domains]

    def evidence(self, text: Column) -> Column:
        """Struct of n (words of the whole text) and e.s0, e.s1, ...: the sums
        of its different words' weights for each domain."""
        # one foldable literal a domain, not a tree of numbers
        tables = [F.split(F.lit(",".join(f"{x:.6g}" for x in w)), ",").cast("array<double>") for w in self.weights]
        hashed = F.filter(F.transform(_words(text), lambda w: F.when(w != "", _bucket(w))), lambda b: b.isNotNull())
        zero = F.struct(*[F.lit(0.0).alias(f"s{i}") for i in range(len(tables))], F.lit(0).alias("k"))

        def add(s: Column, b: Column) -> Column:
            return F.struct(*[(s[f"s{i}"] + F.get(t, b)).alias(f"s{i}") for i, t in enumerate(tables)], (s["k"] + 1).alias("k"))
        # the list of words is made once: it is the only element of an array that is folded
        return F.transform(F.array(hashed), lambda h: F.struct(F.size(h).cast("long").alias("n"), F.aggregate(F.array_distinct(h), zero, add).alias("e")))[0]

    def probabilities(self, found: str) -> list[Column]:
        """The domains' probabilities, from a column of :meth:`evidence`."""
        s = [F.col(f"{found}.e.s{i}") for i in range(len(self.domains))]
        logits = []
        for bias, row in zip(self.bias, self.slopes, strict=True):
            logit = F.lit(bias)
            for x, slope in zip(s, row, strict=True):
                logit = logit + x * F.lit(slope)
            logits.append(logit)
        top = F.greatest(*logits) if len(logits) > 1 else logits[0]
        parts = [F.exp(x - top) for x in logits]
        return [x / sum(parts[1:], parts[0]) for x in parts]

    def calibrate(self, seen: list[tuple[str, list[float]]]) -> None:
        """Multinomial logistic regression of the domains of documents that the
        words were not learned from on their evidence; without any, the
        domains' shares stay."""
        k = len(self.domains)
        if not seen or k < 2:
            return
        x = np.array([e for _, e in seen])
        y = np.array([self.domains.index(d) for d, _ in seen])
        scale = np.maximum(x.std(axis=0), 1e-9)
        x = np.hstack([np.ones((len(x), 1)), x / scale])
        start = np.zeros((k, k + 1))
        start[:, 0] = self.bias
        theta = start.copy()
        hot = np.eye(k)[y]
        pull = np.full((k, k + 1), RIDGE)

        def loss(t):
            z = x @ t.T
            z = z - z.max(axis=1, keepdims=True)
            return float(np.log(np.exp(z).sum(axis=1)).sum() - (z * hot).sum() + 0.5 * (pull * (t - start) ** 2).sum())
        now = loss(theta)
        while True:
            z = x @ theta.T
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            grad = ((p - hot).T @ x + pull * (theta - start)).reshape(-1)
            curve = np.diag(pull.reshape(-1))
            for i in range(k):
                for j in range(k):
                    w = p[:, i] * ((i == j) - p[:, j])
                    curve[i * (k + 1):(i + 1) * (k + 1), j * (k + 1):(j + 1) * (k + 1)] += (x * w[:, None]).T @ x
            step = np.linalg.solve(curve, grad).reshape(theta.shape)
            size = 1.0
            while (new := loss(theta - size * step)) > now and size > 1e-6:
                size /= 2
            if now - new < 1e-9 * (1 + abs(now)):
                break
            theta, now = theta - size * step, new
        self.bias = [float(f"{v:.12g}") for v in theta[:, 0]]
        self.slopes = [[float(f"{v:.12g}") for v in row] for row in theta[:, 1:] / scale]


def word_weights(table: dict[str, list[int]], size: dict[str, int]) -> list[list[float]]:
    """For each domain the weight of every bucket: the logarithm of the
    documents that hold it against the expected number, less the less clearly
    the two differ."""
    total, out = max(1, sum(size.values())), []
    for d in table:
        row = []
        for b in range(BUCKETS):
            usual = size[d] * sum(t[b] for t in table.values()) / total
            off = (table[d][b] - usual) ** 2 / (usual + 1)
            row.append(math.log((table[d][b] + 1) / (usual + 1)) * off / (off + DOUBT ** 2))
        out.append(row)
    return out


def fit_classifier(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain") -> Classifier:
    """Word weights learned on one half of a bounded sample of the labelled
    rows (about ``FIT``), calibrated on the other half (halves by the id's
    crc32). To the driver come at most a count for each domain and bucket and
    the evidence of half of the sample."""
    marks = labelled.select(F.col(id_col).alias("_id"), F.col(domain_col).cast("string").alias("_d")).where("_id is not null and _d is not null").distinct()
    counts = {r[0]: r[1] for r in marks.groupBy("_d").count().collect()}
    domains = sorted(counts)
    total = sum(counts.values())
    picked = marks.where(hash01("_id") < min(1.0, FIT / max(1, total))).withColumn("_learn", split_no("_id") < 2)
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    fitted = own.join(F.broadcast(picked), "_id").dropDuplicates(["_t", "_d"])          # at most about FIT rows; a copy counts once
    fitted = materialize(fitted, "mixing")
    learned = fitted.where("_learn")
    words = (learned.select("_d", F.explode(F.array_distinct(F.transform(_words(F.col("_t")), lambda w: F.when(w != "", _bucket(w))))).alias("b")).where("b is not null"))
    table = {d: [0] * BUCKETS for d in domains}
    for d, b, n in words.groupBy("_d", "b").count().collect():      # at most domains x BUCKETS rows
        table[d][b] = n
    size = {d: 0 for d in domains} | {r[0]: r[1] for r in learned.groupBy("_d").count().collect()}
    out = Classifier(domains, [counts[d] / total for d in domains], word_weights(table, size))
    if domains:
        tried = fitted.where("not _learn").select("_d", out.evidence(F.col("_t")).alias("_e")).select("_d", "_e.e.*").drop("k")
        out.calibrate(sorted((r[0], list(r[1:])) for r in tried.collect()))          # at most about FIT / 2 rows
    return out


def memberships(docs: DataFrame, classifier: Classifier, text_col: str = "text", out: str = "__mix") -> DataFrame:
    """All columns of ``docs`` and ``out``: struct of tokens (words of the
    whole text) and p0, p1, ... Null or empty text: no tokens, the domains'
    shares."""
    found = docs.withColumn(out, classifier.evidence(F.col(text_col)))
    p = classifier.probabilities(out) if classifier.domains else []
    return found.withColumn(out, F.struct(F.col(f"{out}.n").alias("tokens"), *[x.alias(f"p{i}") for i, x in enumerate(p)]))


def fit_rates(scored: DataFrame, targets: list[float], mix: str = "__mix") -> tuple[Column, dict]:
    """The rate of each row as an expression of its memberships, and what was
    reached: the domains' totals before and after, the moves, and whether each
    target is met (within ``MET``).

    Projected gradient descent on the squared relative distances of the
    domains' expected tokens from their targets. A step moves every rate along
    the document's memberships and clips it at zero, so a few sums over all
    documents are all that is gathered in a step. The gradient is scaled by
    the curvature of the documents that are not clipped; where such a step
    does not lower the distance, the plain gradient with its safe length is
    taken, which always does. The end is where a step no longer moves the
    tokens of the mix: the least distance that nonnegative rates can reach,
    whether or not it is zero."""
    k = len(targets)
    p = [F.col(f"{mix}.p{i}") for i in range(k)]
    t = F.col(f"{mix}.tokens").cast("double")
    goal = np.array(targets, float)
    weight = 1.0 / np.maximum(goal, 1e-6 * goal.sum()) ** 2
    cells = [(i, j) for i in range(k) for j in range(i, k)]

    def at(rate: Column, old: Column) -> tuple[np.ndarray, np.ndarray, float]:
        """Totals, curvature of what is not clipped, tokens moved from ``old``."""
        free = F.when(rate > 0, t).otherwise(0.0)
        row = scored.agg(*[F.sum(t * x * rate) for x in p], *[F.sum(free * p[i] * p[j]) for i, j in cells], F.sum(t * F.abs(rate - old))).first()
        found = [float(v or 0.0) for v in row]
        curve = np.zeros((k, k))
        for (i, j), v in zip(cells, found[k:-1], strict=True):
            curve[i, j] = curve[j, i] = v
        return np.array(found[:k]), curve, found[-1]

    def far(totals: np.ndarray) -> float:
        return float((weight * (totals - goal) ** 2).sum())
    rate: Column = F.lit(1.0)
    now, curve, _ = at(rate, rate)
    before, moves, whole = now, [], curve
    # the steepest that the distance can get, whatever is clipped
    safe = 1.0 / max(float(np.linalg.eigvalsh(np.sqrt(weight)[:, None] * whole * np.sqrt(weight)).max()), 1e-300)
    while far(now) > CLOSE ** 2:
        off = now - goal
        lift = 1e-9 * np.trace(whole) * np.eye(k)
        for pull in (np.linalg.solve(curve + lift, off), safe * weight * off):
            move = [float(f"{v:.12g}") for v in pull]
            tried = _move(rate, p, move)
            totals, tried_curve, moved = at(tried, rate)
            if far(totals) < far(now):
                break
        else:
            break
        ended = moved < CLOSE * max(goal.sum(), 1.0)
        rate, now, curve = tried, totals, tried_curve
        moves.append(move)
        if ended:
            break
    met = [bool(abs(a - b) <= MET * max(b, 1e-9)) for a, b in zip(now, goal, strict=True)]
    return rate, {"before": before.tolist(), "after": now.tolist(), "targets": goal.tolist(), "met": met, "moves": moves, "steps": len(moves)}


def _move(rate: Column, p: list[Column], g: list[float]) -> Column:
    pull = F.lit(0.0)
    for x, v in zip(p, g, strict=True):
        pull = pull + x * F.lit(v)
    return F.greatest(F.lit(0.0), rate - pull)


def report(spark: SparkSession, domains: list[str], reached: dict) -> DataFrame:
    """Rows (domain, target, reached, met) of what a fit reached."""
    rows = list(zip(domains, reached.get("targets", []), reached.get("after", []), reached.get("met", []), strict=False))
    return spark.createDataFrame(rows, "domain string, target double, reached double, met boolean")


def rated(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], total_tokens: float | None = None, id_col: str = "doc_id",
          text_col: str = "text", domain_col: str = "domain", keep: list[str] | None = None) -> tuple[DataFrame, list[str], dict]:
    """``keep`` columns of every row (default: all), with ``__mix`` (tokens and
    memberships) and ``__rate``; the domains in order; what fitting reached.

    ``weights`` are the domains' shares of the mix (a labelled domain without
    one gets 0; they need not add up to 1); ``total_tokens`` the mix's size,
    by default the documents' own.

    Null or empty texts have no tokens and get a rate from the domains'
    shares. Repeated rows get a rate each. Null ids and domains are not
    learned from. No labelled rows or documents: all rates 1."""
    classifier = fit_classifier(docs, labelled, id_col, text_col, domain_col)
    scored = materialize(memberships(docs, classifier, text_col).select(*[f"`{c}`" for c in (keep or docs.columns)], "__mix"), "mixing")
    share = [max(0.0, weights.get(d, 0.0)) for d in classifier.domains]
    tokens = total_tokens if total_tokens is not None else float(scored.agg(F.sum("__mix.tokens")).first()[0] or 0)
    if not sum(share) or not tokens:
        return scored.withColumn("__rate", F.lit(1.0)), classifier.domains, {"steps": 0}
    rate, reached = fit_rates(scored, [tokens * s / sum(share) for s in share])
    for d, target, after, met in zip(classifier.domains, reached["targets"], reached["after"], reached["met"], strict=True):
        if not met:
            log.warning("domain %s: target %.6g tokens is out of reach of these memberships, reached %.6g", d, target, after)
    return scored.withColumn("__rate", rate), classifier.domains, reached


def document_rates(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: doc_id, n_tokens, a probability for each domain
    (p_<domain>) and rate; and, the same in every row, each domain's expected
    tokens as a share of its target (reached_<domain>; null without a target)
    and whether all are met. ``options`` as in :func:`rated`."""
    out, domains, reached = rated(docs, labelled, weights, id_col=id_col, keep=[id_col], **options)
    ends = dict(zip(domains, zip(reached.get("after", []), reached.get("targets", []), strict=False), strict=False))
    shares = [F.lit(ends[d][0] / ends[d][1] if d in ends and ends[d][1] else None).cast("double").alias(f"reached_{d}") for d in domains]
    return out.select(F.col(id_col).alias("doc_id"), F.col("__mix.tokens").alias("n_tokens"),
                      *[F.col(f"__mix.p{i}").alias(f"p_{d}") for i, d in enumerate(domains)], F.col("__rate").alias("rate"),
                      *shares, F.lit(all(reached.get("met", []))).alias("targets_met"))


def mixed(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], id_col: str = "doc_id", **options) -> DataFrame:
    """The mix itself: each document as often as its rate's whole part says,
    and once more with the chance of the rest (decided by its id alone). All
    columns as they were."""
    out, _, _ = rated(docs, labelled, weights, id_col=id_col, **options)
    whole = F.floor("__rate")
    more = hash01(id_col, "__salt") < F.col("__rate") - whole
    out = out.withColumn("__salt", F.lit(3)).withColumn("__copies", (whole + more.cast("int")).cast("int"))
    once = out.where("__copies >= 1").withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return once.select(*[f"`{c}`" for c in docs.columns])
