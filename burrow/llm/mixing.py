"""Mixing to target weights by soft membership.

A softmax classifier, trained on a bounded sample of a labelled table, gives each document a posterior over domains
from its byte histogram and its words' log odds. Nonnegative document rates are then fitted so that the expected tokens of
each domain, the sum over documents of rate x tokens x posterior, match the targets: projected gradient steps on
the squared residuals, from rates of 1. Rates have no upper bound unless the caller gives one; targets out of reach
(of a given bound, or of the posteriors) are approached as near as they allow. A step is taken in the metric of the
domains' overlap among documents off the bounds, and, where that doesn't lessen the residuals, along
the plain gradient. It needs one distributed sum of a few numbers; a document's rate follows from its posterior
and the steps, so rates are column expressions and no document is ever collected.

Cases: null and empty texts have no tokens, a posterior as the classifier gives it, and a rate like any other; null
and unknown labels are left out; an id labelled twice takes its smallest domain; a domain without examples gets a
small posterior and what weight can be reached; without any examples posteriors are equal; repeated rows are
documents each, of one rate; an empty table gives an empty result; other columns are carried along by ``mix``.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .decontaminate import words_of
from .quality import with_vector

#: Labelled rows that training may use.
SAMPLE_ROWS = 4_000
BUCKETS = 1 << 14
#: Trials of steps at most, and the largest residual, and the least relative gain of a step, that go on.
TRIALS, TOLERANCE, GAIN = 40, 1e-6, 1e-3


class Buckets(dict):
    """A word's bucket; remembers a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        bucket = zlib.crc32(word) % BUCKETS
        if len(self) < 200_000:
            self[word] = bucket
        return bucket


def features(text: str | None, buckets: Buckets) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of words, roots of the shares of all byte values, and the distinct buckets of the words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = words_of(text)
    shares = np.sqrt(np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / max(1, len(raw)))
    return len(words), shares, np.unique(np.fromiter(map(buckets.__getitem__, set(words)), np.int64))


@dataclass
class Domains:
    """A softmax over byte shares and, for each domain, the strongest of the words' log odds."""

    names: tuple[str, ...]
    odds: np.ndarray
    weights: np.ndarray

    def posterior(self, shares: np.ndarray, lists: list[np.ndarray]) -> np.ndarray:
        rows = [evidence(self.odds, x) for x in lists]
        return softmax(with_bias(shares, np.array(rows).reshape(len(lists), -1)) @ self.weights)


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def with_bias(shares: np.ndarray, found: np.ndarray) -> np.ndarray:
    return np.concatenate([shares[:, :128], found, np.ones((len(shares), 1))], axis=1)


def evidence(odds: np.ndarray, buckets: np.ndarray, strongest: int = 3) -> np.ndarray:
    """The largest log odds for each domain among a text's words, halved and clipped."""
    held = np.concatenate([odds[buckets], np.zeros((strongest, odds.shape[1]))])
    best = np.partition(held, len(held) - strongest, axis=0)[-strongest:]
    return np.sort(np.clip(best, -3, 4), axis=0).T.ravel() / 2


def word_odds(lists: list[np.ndarray], domain: np.ndarray, k: int) -> np.ndarray:
    """Smoothed log odds that a text of a domain holds a bucket, against all other texts; 0 for rare buckets."""
    count = lambda some: np.bincount(np.concatenate([*some, np.zeros(0, np.int64)]).astype(np.int64), minlength=BUCKETS)
    held, n = count(lists), len(lists)
    odds = np.zeros((BUCKETS, k))
    for c in range(k):
        own, size = count([x for x, d in zip(lists, domain, strict=True) if d == c]), int((domain == c).sum())
        odds[:, c] = np.log((own + 0.5) / (size + 1)) - np.log((held - own + 0.5) / (n - size + 1))
    odds[held < max(4, 0.003 * n)] = 0
    return odds


def train(names: tuple[str, ...], shares: np.ndarray, lists: list[np.ndarray], domain: np.ndarray, *, steps: int = 400, rate: float = 0.1, decay: float = 1e-4) -> Domains:
    """Log odds of one half of the rows serve to train the softmax on the other half; Adam on the mean log loss."""
    k = len(names)
    odds = word_odds(lists, domain, k)
    half = [word_odds(lists[i::2], domain[i::2], k) for i in (1, 0)]
    x = with_bias(shares, np.array([evidence(half[i % 2], b) for i, b in enumerate(lists)]).reshape(len(lists), 3 * k))
    weights = np.zeros((x.shape[1], k))
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1) if len(domain) else ():
        grad = x.T @ (softmax(x @ weights) - np.eye(k)[domain]) / len(domain) + decay * weights
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        weights -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Domains(names, odds, weights)


def fit_domains(docs: DataFrame, labelled: DataFrame, names: tuple[str, ...], rows: int = SAMPLE_ROWS) -> Domains:
    """Train on at most ``rows`` rows of ``labelled`` (doc_id, domain), those of the smallest hashed ids."""
    wanted = labelled.where(F.col("domain").isin(*names) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    wanted = wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    held = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id")

    def run(texts: list) -> list[dict]:
        found = [features(t, buckets) for t in texts]
        return [{"shares": s.astype(np.float32).tobytes(), "buckets": b.astype(np.int32).tobytes()} for _, s, b in found]

    buckets = Buckets()
    kind = pa.struct([("shares", pa.binary()), ("buckets", pa.binary())])
    seen = with_vector(held, run, "x", kind="struct<shares:binary,buckets:binary>", arrow=kind)
    sample = seen.select("row.doc_id", "row.domain", "x").orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(rows).collect()
    shares = np.array([np.frombuffer(r.x.shares, np.float32) for r in sample], dtype=np.float64).reshape(-1, 256)
    lists = [np.frombuffer(r.x.buckets, np.int32).astype(np.int64) for r in sample]
    return train(names, shares, lists, np.array([names.index(r.domain) for r in sample], dtype=np.int64))


def posteriors(docs: DataFrame, model: Domains) -> DataFrame:
    """All columns of ``docs`` in a struct ``row``; ``soft.n_tokens`` and ``soft.p``."""
    buckets = Buckets()

    def run(texts: list) -> list[dict]:
        found = [features(t, buckets) for t in texts]
        p = model.posterior(np.array([s for _, s, _ in found]).reshape(-1, 256), [b for _, _, b in found])
        return [{"n_tokens": n, "p": q} for (n, _, _), q in zip(found, p, strict=True)]

    kind = pa.struct([("n_tokens", pa.int64()), ("p", pa.list_(pa.float64()))])
    return with_vector(docs, run, "soft", kind="struct<n_tokens:long,p:array<double>>", arrow=kind)


def rate_of(p: Column, steps: list[list[float]], most: float = math.inf) -> Column:
    """A document's rate after the steps: each is subtracted along the posterior, and rates beyond a bound go back to it."""
    rate = F.lit(1.0)
    for step in steps:
        move = F.lit(0.0)
        for c, x in enumerate(step):
            move = move + p[c] * F.lit(float(x))
        rate = F.greatest(F.lit(0.0), F.least(F.lit(float(most)), rate - move))
    return rate


def fit_rates(soft: DataFrame, weights: list[float], most: float = math.inf) -> list[list[float]]:
    """The steps that fit the rates of ``soft`` (n_tokens, p) to ``weights``, the domains' shares of all tokens."""
    k = len(weights)
    target = np.array(weights, dtype=np.float64) / sum(weights)
    n, p = F.col("n_tokens"), F.col("p")

    def sums(steps: list[list[float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Residuals, the overlap of all documents and that of documents off the bounds, by token share."""
        rated = soft.select("n_tokens", "p", rate_of(p, steps, most).alias("rate"))
        free = F.when((F.col("rate") > 0) & (F.col("rate") < most), n).otherwise(F.lit(0))
        pairs = [(a, b) for a in range(k) for b in range(k)]
        parts = [*[F.col("rate") * n * p[c] for c in range(k)], *[n * p[a] * p[b] for a, b in pairs], *[free * p[a] * p[b] for a, b in pairs]]
        got = rated.agg(F.sum("n_tokens").alias("all"), *[F.sum(x).alias(f"v{i}") for i, x in enumerate(parts)]).first()
        if not got["all"]:
            return None
        values = np.array(got[1:], dtype=np.float64) / got["all"]
        return values[:k] - target, values[k : k + k * k].reshape(k, k), values[k + k * k :].reshape(k, k)

    steps: list[list[float]] = []
    now = sums(steps)
    trial, scale = 0, 1.0
    while now and trial < TRIALS and np.abs(now[0]).max() > TOLERANCE:
        residual, overlap, free = now
        plain = residual / max(np.linalg.eigvalsh(overlap).max(), 1e-12)
        move = plain if scale < 0.1 else scale * np.linalg.pinv(free, rcond=1e-6) @ residual
        then = sums([*steps, move.tolist()])
        trial += 1
        before, after = (residual**2).sum(), (then[0] ** 2).sum()
        if after < before * (1 - GAIN):
            steps.append(move.tolist())
            now, scale = then, 1.0
        elif scale < 0.1:
            break
        else:
            scale /= 4
    return steps


def reached_shares(soft: DataFrame, steps: list[list[float]], names: list[str]) -> dict[str, float]:
    """Each domain's expected tokens under the fitted rates as a share of all tokens, to hold against its target."""
    parts = [(F.sum(rate_of(F.col("p"), steps) * F.col("n_tokens") * F.col("p")[i]) / F.sum("n_tokens")).alias(x) for i, x in enumerate(names)]
    return soft.agg(*parts).first().asDict()


def copies_of(rate: Column, doc_id: Column, seed: int = 42) -> Column:
    """The rate rounded to a whole number of copies, up or down by a seeded hash of the id, so that the expectation is the rate."""
    return F.floor(rate + F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))).cast("int")


def mixed_rates(docs: DataFrame, labelled: DataFrame, weights: dict[str, float]) -> tuple[Domains, list[list[float]], DataFrame]:
    """The classifier, the steps, and ``doc_id, n_tokens, p`` of each row."""
    model = fit_domains(docs, labelled, tuple(weights))
    soft = stored(posteriors(docs.select("doc_id", "text"), model).select("row.doc_id", "soft.n_tokens", "soft.p"))
    return model, fit_rates(soft, list(weights.values())), soft


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``docs`` with each row as often as its rate says; the same columns."""
    model, steps, _ = mixed_rates(docs, labelled, weights)
    rated = posteriors(docs, model).select("row", copies_of(rate_of(F.col("soft.p"), steps), F.col("row.doc_id")).alias("copies"))
    return rated.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def domains_of(labels: DataFrame) -> DataFrame:
    """``doc_id, domain`` from the marks of a labels table: toxic, poor or good."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "good")
    return labels.select("doc_id", domain.alias("domain"))
