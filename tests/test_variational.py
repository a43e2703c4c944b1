"""Topics against a restatement without Spark, on several layouts, bit for bit."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from corpuscope.operators import variational as V

N_TERMS, K = 40, 3


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    themes = [range(0, 15), range(12, 28), range(25, 40)]
    docs = []
    for i in range(90):
        words = [rng.choice(themes[i % 3]) for _ in range(rng.randrange(5, 40))]
        ids = sorted(set(words))
        docs.append((i, ids, [words.count(w) for w in ids]))
    return docs


def frame(spark, docs, parts):
    return spark.createDataFrame(docs, "key int, ids array<bigint>, counts array<bigint>").repartition(parts)


def restated(docs, batch_of, batches, iterations, seed=42):
    """One document after the other, with sums of plain numbers."""
    weights = V.start(N_TERMS, K, seed)
    for i in range(iterations):
        mine = [d for d in docs if batch_of[d[0]] == i % batches]
        if not mine:
            continue
        beta, found = np.exp(V.expected_log(weights)), np.zeros_like(weights)
        for _, ids, counts in mine:
            c, b = np.array(counts, float), beta[ids]
            gamma = np.ones(K)
            for _ in range(100):
                last = gamma
                theta = np.exp(V.digamma(gamma) - V.digamma(gamma.sum()))
                gamma = 1 / K + theta * (b * (c / (b @ theta))[:, None]).sum(axis=0)
                if np.abs(gamma - last).mean() < 1e-3:
                    break
            theta = np.exp(V.digamma(gamma) - V.digamma(gamma.sum()))
            found[ids] += b * np.outer(c / (b @ theta), theta)
        rate = (1024 + i) ** -0.51
        weights = (1 - rate) * weights + rate * (1 / K + len(docs) / len(mine) * found)
    return weights


def test_equal_on_every_layout_and_to_the_restatement(spark, corpus):
    made = [V.fit_stable_topics(frame(spark, corpus, p), "key", N_TERMS, K, iterations=6, batches=4) for p in (1, 3, 8)]
    for other in made[1:]:
        assert (other.weights == made[0].weights).all()
    table = V.keyed_batches(frame(spark, corpus, 2), "key", 4)
    batch_of = {(tuple(r.ids), tuple(r.counts)): r.batch for r in table.collect()}
    want = restated(corpus, {k: batch_of[tuple(ids), tuple(counts)] for k, ids, counts in corpus}, 4, 6)
    assert made[0].weights == pytest.approx(want, rel=1e-6)
    quality = {V.StableTopics.fit_quality(made[0], frame(spark, corpus, p)) for p in (1, 3, 8)}
    assert len(quality) == 1
    perplexity, likelihood = quality.pop()
    assert perplexity == pytest.approx(-likelihood / sum(sum(c) for _, _, c in corpus)) and 0 < perplexity < math.log(N_TERMS) + 1


def test_learns_and_comes_back_from_a_table(spark, corpus):
    docs = frame(spark, corpus, 2)
    loss = [V.fit_stable_topics(docs, "key", N_TERMS, K, n, batches=1, delay=1.0, decay=0.7).fit_quality(docs)[0] for n in (0, 3, 25)]
    assert loss[0] > loss[1] > loss[2]
    made = V.fit_stable_topics(docs, "key", N_TERMS, K, 25, batches=1, delay=1.0, decay=0.7)
    terms = spark.createDataFrame([(i, f"t{i}") for i in range(N_TERMS)], "term_id bigint, term string")
    rows = made.topics(terms, 8).collect()
    assert {(r.topic, r["rank"]) for r in rows} == {(t, n) for t in range(K) for n in range(1, 9)}
    share = made.weights / made.weights.sum(axis=0)
    assert all(r.weight == share[int(r.term[1:]), r.topic] for r in rows)
    again = V.StableTopics.load(made.table(spark, terms))
    assert (again.weights == made.weights).all() and again.alpha == made.alpha


def test_nothing_to_learn_from(spark, corpus):
    empty = V.fit_stable_topics(frame(spark, corpus, 2).where("false"), "key", N_TERMS, K, 3)
    assert (empty.weights == V.start(N_TERMS, K, 42)).all()
    assert empty.fit_quality(frame(spark, corpus, 2).where("false"))[0] == 0.0
    with pytest.raises(ValueError):
        V.fit_stable_topics(frame(spark, corpus, 2), "key", V.MAX_WEIGHTS, 2)


def test_special_functions():
    x = np.array([0.01, 0.5, 1.0, 3.3, 10.0, 1e4])
    assert V.digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649015329, rel=1e-11)
    assert V.digamma(x + 1) - V.digamma(x) == pytest.approx(1 / x, rel=1e-9)
    assert V.log_gamma(x + 1) - V.log_gamma(x) == pytest.approx(np.log(x), rel=1e-9, abs=1e-9)
    begun = V.start(2000, 5, 42)
    assert abs(begun.mean() - 1) < 0.01 and abs(begun.std() - 0.1) < 0.01 and (begun > 0).all()


def test_documents_are_inferred_together_and_each_as_if_alone(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(V, "GROUP", 1 << 11)
    sizes = [0, 1, 7, 16, 17, 39, 40, 33, 34, 35, 36, 38, 12, 0, 40]
    docs = [(np.sort(rng.choice(N_TERMS, s, replace=False)).tolist(), rng.integers(1, 9, s).tolist()) for s in sizes]

    def batch(some):
        lists = [pa.array([d[i] for d in some], pa.list_(pa.int64())) for i in (0, 1)]
        return pa.RecordBatch.from_arrays(lists, ["ids", "counts"])

    beta = np.concatenate([np.exp(V.expected_log(V.start(N_TERMS, K, 5))), np.zeros((1, K))])

    def inferred(batches):
        out, groups = {}, 0
        for ids, own, counts in V._groups(iter(batches), beta):
            groups += 1
            gamma, theta, norm = V.infer(own, counts, 0.1)
            added, bound = V.contribution(own, counts, theta, norm), V.document_bound(counts, gamma, norm, 0.1)
            for i, mine in enumerate(ids):
                known = mine < N_TERMS
                assert not added[i][~known].any()
                key = tuple(mine[known]), tuple(counts[i][known])
                out.setdefault(key, []).append((gamma[i].tolist(), added[i][known].tolist(), bound[i]))
        return out, groups

    together, groups = inferred([batch(docs)])
    alone, _ = inferred([batch([d]) for d in docs])
    assert together == alone and sum(map(len, together.values())) == len(docs)
    assert groups < len(docs) / 2
