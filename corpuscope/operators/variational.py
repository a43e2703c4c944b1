"""Topics that do not depend on how the documents lie: online variational Bayes with keyed draws.

What is drawn at random elsewhere is a hash here: the start of every topic, and the mini-batch that a
document belongs to. A document's inference knows nothing but its own terms and the topics; its
contribution to the topics is rounded to a fixed fraction and added up as whole numbers, so the sums
come out the same in any order, on any number of partitions.

Every iteration reads one mini-batch, a folder of the table of documents, infers its documents in Arrow
batches and merges their statistics as an aggregate over terms. The driver holds the topics, ``k`` numbers
for each of ``n_terms`` terms, and sends them to the tasks: 8 MB for 20 topics of 50,000 terms.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.session import materialize

#: The topics on the driver and in every task have at most so many numbers (256 MB).
MAX_WEIGHTS = 1 << 25
#: Contributions are added up in units of these fractions: 2**33 occurrences of a term in a mini-batch,
#: and 2**43 of summed likelihood, still fit.
_UNIT, _LOSS_UNIT = float(1 << 30), float(1 << 20)
_TINY = 1e-100
#: Documents inferred at once have at most so many weights (2 MB), unless one document has more; their
#: numbers of terms are multiples of the second number.
GROUP, FILL = 1 << 18, 16


def digamma(x: np.ndarray) -> np.ndarray:
    """The derivative of the logarithm of the gamma function, for positive numbers."""
    x = np.asarray(x, dtype=np.float64)
    # Ten steps up, to where the series is exact to double precision; the first with the last of them,
    # the second with the last but one and so on have denominators that differ by constants.
    ends = x * (x + 9)
    steps = (2 * x + 9) * (1 / ends + 1 / (ends + 8) + 1 / (ends + 14) + 1 / (ends + 18) + 1 / (ends + 20))
    x = x + 10
    y = 1 / (x * x)
    series = y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y * (1 / 132)))))
    return np.log(x) - 0.5 / x - series - steps


def log_gamma(x: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(v) for v in np.ravel(x)]).reshape(np.shape(x))


def start(n_terms: int, k: int, seed: int) -> np.ndarray:
    """Topics to begin with, ``(n_terms, k)``: numbers about 1 that are hashes of term, topic and seed."""
    at = np.arange(n_terms * k, dtype=np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
    total = np.zeros(n_terms * k)
    for i in range(12):  # a sum of twelve uniform numbers has a standard deviation of 1
        z = (at + np.uint64((i + 1) * 0xD1342543DE82EF95 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        total += ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)
    return (1 + 0.1 * (total - 6)).reshape(n_terms, k)


def expected_log(weights: np.ndarray) -> np.ndarray:
    """Expected logarithms of the terms' shares in topics, ``(n_terms, k)``."""
    return digamma(weights) - digamma(weights.sum(axis=0))


def _shares(gamma: np.ndarray) -> np.ndarray:
    return np.exp(digamma(gamma) - digamma(gamma.sum(axis=1, keepdims=True)))


def infer(beta: np.ndarray, counts: np.ndarray, alpha: float, steps: int = 100, close: float = 1e-3):
    """Topics of documents: their weights per topic, their exponential expected logarithms and the share
    of every term. ``beta`` is ``(documents, terms, k)`` and has each document's terms only, ``counts``
    how often it has each, none for terms that fill it up to the common number.

    Every document has products of its own and stops by itself, so its numbers are the same alone and
    among others."""
    n, terms, k = beta.shape
    out = np.empty((n, k)), np.empty((n, k)), np.empty((n, terms))
    at, going = np.arange(n), np.ones(n, dtype=bool)
    gamma = np.ones((n, k))
    theta = _shares(gamma)
    norm = np.matmul(beta, theta[:, :, None])[:, :, 0] + _TINY
    for step in range(steps):
        last = gamma
        gamma = alpha + theta * np.matmul((counts / norm)[:, None, :], beta)[:, 0, :]
        theta = _shares(gamma)
        norm = np.matmul(beta, theta[:, :, None])[:, :, 0] + _TINY
        ends = going & ((np.abs(gamma - last).mean(axis=1) < close) | (step == steps - 1))
        if not ends.any():
            continue
        for kept, found in zip(out, (gamma, theta, norm)):
            kept[at[ends]] = found[ends]
        going &= ~ends
        left = int(going.sum())
        if not left:
            break
        if 2 * left <= len(going):  # the others are done, and nothing is worked out for them any more
            at, gamma, theta, norm, beta, counts = (x[going] for x in (at, gamma, theta, norm, beta, counts))
            going = np.ones(left, dtype=bool)
    return out


def contribution(beta: np.ndarray, counts: np.ndarray, theta: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """How much of each term's count goes to each topic, in whole units, per document."""
    return np.rint(beta * ((counts / norm)[:, :, None] * theta[:, None, :]) * _UNIT).astype(np.int64)


def document_bound(counts: np.ndarray, gamma: np.ndarray, norm: np.ndarray, alpha: float) -> np.ndarray:
    """What each document adds to the bound of the likelihood."""
    k = gamma.shape[1]
    total = gamma.sum(axis=1)
    logs = digamma(gamma) - digamma(total[:, None])
    prior = ((alpha - gamma) * logs + log_gamma(gamma)).sum(axis=1) - k * math.lgamma(alpha)
    return (counts * np.log(norm)).sum(axis=1) + prior + math.lgamma(k * alpha) - log_gamma(total)


def topics_bound(weights: np.ndarray, eta: float) -> float:
    """What the topics add to it."""
    n = len(weights)
    total = weights.sum(axis=0)
    inner = ((eta - weights) * expected_log(weights) + log_gamma(weights)).sum() - weights.size * math.lgamma(eta)
    return float(inner + weights.shape[1] * math.lgamma(n * eta) - log_gamma(total).sum())


def _groups(batches: Iterator[pa.RecordBatch], beta: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Documents of one number of terms at a time: ``(ids, beta, counts)``. A document is filled up by a
    few terms without weight, the last of ``beta``, to a number that depends on its own terms only."""
    none, k = len(beta) - 1, beta.shape[1]
    for batch in batches:
        ids, counts = batch.column("ids"), batch.column("counts")
        sizes = ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        ids, counts = (np.append(c.flatten().to_numpy(zero_copy_only=False), 0) for c in (ids, counts))
        begins = np.cumsum(sizes) - sizes
        # Steps of an eighth of the power of two below.
        step = np.maximum(FILL, 1 << np.maximum(np.log2(np.maximum(sizes, 1)).astype(np.int64) - 3, 0))
        widths = np.maximum(-(-sizes // step) * step, FILL)
        for width in np.unique(widths).tolist():
            rows = np.flatnonzero(widths == width)
            many = max(1, GROUP // (width * k))
            for some in (rows[i : i + many] for i in range(0, len(rows), many)):
                place = np.arange(width)
                own = place < sizes[some, None]
                place = np.where(own, begins[some, None] + place, 0)
                group = np.where(own, ids[place], none)
                yield group, beta[group], np.where(own, counts[place], 0).astype(np.float64)


def _shared_beta(spark: SparkSession, weights: np.ndarray):
    """What tasks know of the topics, with a last term that has no weight."""
    beta = np.exp(expected_log(weights))
    return spark.sparkContext.broadcast(np.concatenate([beta, np.zeros((1, beta.shape[1]))]))


def _statistics(shared, alpha: float, k: int):
    """Per term, what the documents of a task add to each topic; under the number -1, how many there are."""
    names = ["term_id", *[f"s{i}" for i in range(k)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beta = shared.value
        sums = np.zeros(beta.shape, dtype=np.int64)
        n = 0
        for ids, own, counts in _groups(batches, beta):
            _, theta, norm = infer(own, counts, alpha)
            for mine, added in zip(ids, contribution(own, counts, theta, norm)):
                sums[mine] += added
            n += len(ids)
        used = np.flatnonzero(sums.any(axis=1))
        rows = np.concatenate([np.full((1, k), n), sums[used]])
        columns = [np.append(-1, used), *rows.T]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), pa.int64()) for c in columns], names)

    return run, ", ".join(f"{n} bigint" for n in names)


@dataclass(frozen=True)
class StableTopics:
    """``weights`` is ``(n_terms, k)``; a term's number is its row."""

    weights: np.ndarray
    alpha: float
    eta: float

    def table(self, spark: SparkSession, terms: DataFrame) -> DataFrame:
        """``(term_id, term, weights)``: the model as a table, from which ``load`` makes it again."""
        rows = [(i, w) for i, w in enumerate(self.weights.tolist())]
        made = spark.createDataFrame(rows, "term_id bigint, weights array<double>")
        return made.join(terms.select("term_id", "term"), "term_id").select("term_id", "term", "weights")

    @classmethod
    def load(cls, table: DataFrame, alpha: float | None = None, eta: float | None = None) -> StableTopics:
        rows = sorted(table.select("term_id", "weights").collect())
        weights = np.array([r.weights for r in rows])
        k = weights.shape[1]
        return cls(weights, 1 / k if alpha is None else alpha, 1 / k if eta is None else eta)

    def topics(self, terms: DataFrame, n_terms: int = 15) -> DataFrame:
        """``(topic, rank, term, weight)``, rank 1 first, ties by the terms' numbers."""
        share = self.weights / self.weights.sum(axis=0)
        rows = []
        for t in range(share.shape[1]):
            best = np.lexsort((np.arange(len(share)), -share[:, t]))[:n_terms]
            rows += [(t, r, int(i), float(share[i, t])) for r, i in enumerate(best, 1)]
        named = terms.sparkSession.createDataFrame(rows, "topic int, rank int, term_id bigint, weight double")
        return terms.select("term_id", "term").join(F.broadcast(named), "term_id").select("topic", "rank", "term", "weight")

    def fit_quality(self, vectors: DataFrame) -> tuple[float, float]:
        """``(log_perplexity, log_likelihood)`` of documents: a bound, in whole units per document."""
        spark = vectors.sparkSession
        shared, alpha = _shared_beta(spark, self.weights), self.alpha

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, n = 0, 0
            for _, own, counts in _groups(batches, shared.value):
                gamma, _, norm = infer(own, counts, alpha)
                loss += sum(round(x * _LOSS_UNIT) for x in document_bound(counts, gamma, norm, alpha).tolist())
                n += int(counts.sum())
            yield pa.RecordBatch.from_arrays([pa.array([loss], pa.int64()), pa.array([n], pa.int64())], ["loss", "n"])

        found = vectors.select("ids", "counts").mapInArrow(run, "loss bigint, n bigint").agg(F.sum("loss"), F.sum("n")).first()
        shared.unpersist()
        likelihood = (found[0] or 0) / _LOSS_UNIT + topics_bound(self.weights, self.eta)
        return -likelihood / found[1] if found[1] else 0.0, likelihood


def keyed_batches(vectors: DataFrame, key: str, batches: int, seed: int = 42) -> DataFrame:
    """``vectors`` as a table in one folder per mini-batch, drawn by a hash of the key."""
    batch = F.pmod(F.xxhash64(F.lit(seed), F.col(key).cast("string")), F.lit(batches)).cast("int")
    return materialize(vectors.select("ids", "counts", batch.alias("batch")), "topic-vectors", partition_by="batch")


def fit_stable_topics(
    vectors: DataFrame,
    key: str,
    n_terms: int,
    k: int = 20,
    iterations: int = 20,
    batches: int = 20,
    seed: int = 42,
    delay: float = 1024.0,
    decay: float = 0.51,
) -> StableTopics:
    """Topics of documents given as ``(key, ids, counts)`` with numbers below ``n_terms``.

    Priors are ``1 / k`` throughout. Iteration ``i`` learns from mini-batch ``i % batches`` at a rate of
    ``(delay + i) ** -decay``. A mini-batch without documents teaches nothing; without documents or
    terms the topics stay as they began. Keys need not be unique: they only draw the mini-batch."""
    if n_terms * k > MAX_WEIGHTS:
        raise ValueError(f"{n_terms} terms x {k} topics are more than {MAX_WEIGHTS} numbers; choose fewer terms")
    spark = vectors.sparkSession
    docs = keyed_batches(vectors, key, batches, seed)
    sizes = {r.batch: r["count"] for r in docs.groupBy("batch").count().collect()}
    weights, prior, total = start(n_terms, k, seed), 1 / k, sum(sizes.values())
    for i in range(iterations):
        if i % batches not in sizes:
            continue
        shared = _shared_beta(spark, weights)
        run, schema = _statistics(shared, prior, k)
        some = docs.where(F.col("batch") == i % batches).select("ids", "counts").mapInArrow(run, schema)
        # One row per term comes back, n_terms at most.
        merged = some.groupBy("term_id").agg(*[F.sum(f"s{t}").alias(f"s{t}") for t in range(k)]).toArrow()
        shared.unpersist()
        ids = merged.column("term_id").to_numpy()
        sums = np.stack([merged.column(f"s{t}").to_numpy() for t in range(k)], axis=1)
        n = int(sums[ids == -1][0, 0])
        found = np.zeros_like(weights)
        found[ids[ids >= 0]] = sums[ids >= 0] / _UNIT
        rate = (delay + i) ** -decay
        weights = (1 - rate) * weights + rate * (prior + total / n * found)
    return StableTopics(weights, prior, prior)
