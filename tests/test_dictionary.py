"""Numbers of terms and sparse rows, over any layout."""

import random
from collections import Counter

import pytest

from corpuscope.operators import dictionary, topics


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)] + ["é", "日本", "W1"]
    docs = [[rng.choice(words[: rng.randrange(1, 64)]) for _ in range(rng.randrange(30))] for _ in range(80)]
    return [(i, d) for i, d in enumerate(docs)] + [(100, None), (101, []), (102, ["hot"] * 5000)]


def frame(spark, corpus, parts):
    return spark.createDataFrame(corpus, "k int, tokens array<string>").repartition(parts)


def numbered(corpus, min_df):
    count, df = Counter(), Counter()
    for _, d in corpus:
        count.update(d or [])
        df.update(set(d or []))
    kept = sorted((t for t in df if df[t] >= min_df), key=lambda t: (-count[t], t.encode()))
    return {t: (i, df[t], count[t]) for i, t in enumerate(kept)}


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_numbers_and_rows(spark, monkeypatch, corpus, parts):
    docs, want = frame(spark, corpus, parts), numbered(corpus, 2)
    terms = dictionary.dictionary(topics.document_frequency(docs, 2))
    assert {r.term: (r.term_id, r.document_frequency, r.term_count) for r in terms.collect()} == want
    for limit in (10**6, 0):  # broadcast, and shuffled
        monkeypatch.setattr(dictionary, "BROADCAST_TERMS", limit)
        rows = {(r.k, r.term): (r.term_id, r.n) for r in dictionary.term_rows(docs, terms, "k").collect()}
        assert rows == {(k, t): (want[t][0], n) for k, d in corpus for t, n in Counter(d or []).items() if t in want}
    vectors = {r.k: dict(zip(r.ids, r.counts)) for r in dictionary.sparse_vectors(docs, terms, "k").collect()}
    own = {k: {want[t][0]: n for t, n in Counter(d or []).items() if t in want} for k, d in corpus}
    assert vectors == {k: v for k, v in own.items() if v}
    assert all(list(v) == sorted(v) for v in vectors.values())


def test_limits_and_nothing(spark, corpus):
    docs = frame(spark, corpus, 2)
    terms = topics.document_frequency(docs, 1)
    first = dictionary.dictionary(terms, 5)
    assert {r.term_id for r in first.collect()} == set(range(5))
    assert first.where("term = 'hot'").first().term_id == 0
    nothing = dictionary.dictionary(terms.where("false"))
    assert nothing.count() == 0 and dictionary.term_rows(docs, nothing, "k").count() == 0


def test_no_list_of_terms_in_the_plan(spark, corpus):
    docs = frame(spark, corpus, 2)
    terms = dictionary.dictionary(topics.document_frequency(docs, 1))
    plan = dictionary.term_rows(docs, terms, "k")._jdf.queryExecution().toString()
    assert "w17" not in plan and "Python" not in plan and "MapInArrow" not in plan
