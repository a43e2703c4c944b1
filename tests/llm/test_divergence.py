"""Distances between sources against sums over all terms, in any blocks, tiles and units of counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscope.llm import divergence

SCHEMA = "lang string, source string, text string"


def by_hand(rows, min_docs, top=50):
    rows = [tuple(x or "" for x in r) for r in rows]
    fold = {i: i + 32 for i in range(65, 91)}
    words = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(fold)) for _, _, t in rows]
    out = set()
    for lang in {r[0] for r in rows}:
        mine = [(s, w) for (g, s, _), w in zip(rows, words) if g == lang]
        df = Counter(t for _, w in mine for t in set(w))
        kept = sorted(t for t in df if df[t] >= min_docs)
        count = {s: Counter(t for x, w in mine if x == s for t in w if df[t] >= min_docs) for s, _ in mine}
        everything = sum(count.values(), Counter())
        prices = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p, q = {s: prices(c) for s, c in count.items()}, prices(everything)
        for s in count:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in count if o != s)
            terms = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if count[s][t] and p[s][t] > q[t])
            for part, found in (("pair", pairs), ("term", terms[:top])):
                out |= {(lang, s, part, item, -v, i) for i, (v, _, item) in enumerate(found, 1)}
    return out


def rows_of(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    words = [w + x for w in "alpha Beta GAMMA delta été Œuvre 日本 x'y a1b".split() for x in ("", "s", "é", "Q")]
    text = lambda k: rng.choice([" ", "\n", "-", "_"]).join(rng.choices(words, weights=range(1, len(words) + 1), k=k))
    rows = [(rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None, "ä", "Z"]), text(rng.randrange(40))) for _ in range(150)]
    # One source and language with no common term, one document that is null, one over and over.
    return rows + [("xx", "a", "once"), ("xx", "b", None), ("en", "d", None)] + [("en", "hot", "alpha alpha betas")] * 60


@pytest.mark.parametrize("terms,tile,held", [(512, 128, 250_000), (3, 2, 5)])
def test_by_hand(spark, corpus, terms, tile, held):
    df = spark.createDataFrame(corpus, SCHEMA).repartition(3)
    df = df.withColumns({c: F.lit(None).cast("string") for c in ("term", "n", "p", "q", "id", "a", "b", "value", "block", "docs")})
    assert rows_of(divergence.divergence(df, min_docs=5, terms=terms, tile=tile, held=held)) == by_hand(corpus, 5)


def test_joint_tables_give_the_distances(spark, corpus):
    df = spark.createDataFrame(corpus, SCHEMA)
    cells = divergence.joint_tables(df, min_docs=5, terms=7, tile=2)
    sums = cells.groupBy("lang", "source", "other").agg(F.sum(F.abs(F.col("level") - F.col("other_level")) * F.col("n_terms")).alias("v"))
    want = {r[:2] + r[3:5] for r in by_hand(corpus, 5) if r[2] == "pair" and r[0] != "xx"}
    assert {tuple(r) for r in sums.collect()} == want


def test_empty_and_rare(spark):
    df = spark.createDataFrame([("en", "a", "x"), ("en", "b", None), (None, None, None)], SCHEMA)
    assert rows_of(divergence.divergence(df)) == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}
    assert rows_of(divergence.divergence(df.where("false"))) == set()


def test_prices_of_huge_counts(spark):
    n, total, v = 9_223_372_037, 10**15, 10**6
    for k in (n - 10, n, 9 * 10**14, 0):
        row = spark.range(1).select(divergence.price(F.lit(k).cast("bigint"), F.lit(total).cast("bigint"), F.lit(v).cast("bigint")).alias("p"))
        assert row.first().p == 1 + 10**9 * (k + 5) // (total + 5 * v) and row.dtypes[0][1] == "bigint"


def test_product_is_that_of_indicator_matrices():
    rng = np.random.default_rng(1)
    left, right = rng.integers(0, 4, 50), np.stack([rng.integers(0, 3, 50), 3 + rng.integers(0, 5, 50)], axis=1)
    x, y = np.eye(4, dtype=int)[left], np.eye(8, dtype=int)[right].sum(axis=1)
    assert (divergence.product(left, 4, right, 8) == x.T @ y).all()
