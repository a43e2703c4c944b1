"""Phrases from a table: the same occurrences as with the list in the plan, and no list in the plan."""

import random

import pytest
from pyspark.sql import functions as F

from corpuscope.operators import gender, phrases
from corpuscope.operators.phrases import phrase_lexicon, phrase_occurrences


def found(frame):
    return sorted((r.id, r.start, r.n, r.phrase) for r in frame.collect())


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_same_as_with_literals(spark, threshold):
    rng = random.Random(5)
    words = ["aa", "bb", "cc", "dd"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate([*texts, None, "", "aa, bb; aa bb", "aa " * 3000])] + [(7, texts[7])]
    docs = spark.createDataFrame(rows, "id int, text string")
    entries = ["aa", "aa aa", "bb  cc", "bb cc dd aa", "cc dd", "aa", "dd aa bb", "zz", "aa zz", "", "  "]
    listed = spark.createDataFrame([(e,) for e in [*entries, None]], "entry string")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        got = found(phrase_occurrences(docs, phrase_lexicon(listed, "entry"), ["id"]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    want = gender.with_phrase_hits(docs, entries).select("id", F.inline("hits"))
    assert got == found(want) and len(got) > 1000


def test_empty(spark):
    docs = spark.createDataFrame([(1, "aa bb")], "id int, text string")
    listed = spark.createDataFrame([("aa",)], "entry string")
    assert found(phrase_occurrences(docs, phrase_lexicon(listed.limit(0), "entry"), ["id"])) == []
    assert found(phrase_occurrences(docs.limit(0), phrase_lexicon(listed, "entry"), ["id"])) == []


def test_a_hundred_thousand_phrases(spark):
    """Each document holds one phrase of the list; no phrase is in the plan."""
    n = 100_000
    listed = spark.range(n).select(F.concat_ws(" ", F.concat(F.lit("w"), F.col("id") % 300), F.concat(F.lit("p"), "id")).alias("entry"))
    docs = spark.range(500).select("id", F.concat_ws(" ", F.lit("w0"), F.concat(F.lit("w"), F.col("id") * 199 % 300), F.concat(F.lit("p"), F.col("id") * 199)).alias("text"))
    out = phrase_occurrences(docs, phrase_lexicon(listed, "entry"), ["id"])
    plan = out._jdf.queryExecution().toString()
    assert len(plan) < 60_000 and "p199" not in plan
    got = found(out)
    assert [(r[0], r[1], r[2]) for r in got] == [(i, 1, 2) for i in range(500)]


def test_only_what_may_be_listed_is_looked_up(spark):
    """All words are first words of the list, and few of their pairs are listed."""
    n = 300
    listed = spark.range(n).select(F.concat(F.lit("w"), F.col("id"), F.lit(" w"), (F.col("id") * 7 + 1) % n).alias("entry"))
    docs = spark.range(200).select("id", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(499)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64(i, "id"), F.lit(n)))), " ").alias("text"))
    lexicon = phrase_lexicon(listed, "entry")
    pairs = spark.range(n).select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.concat(F.lit("w"), F.col("id"), F.lit(" w"), i))).alias("phrase"))
    left = phrases._perhaps_listed(pairs, lexicon)
    assert left.join(lexicon.phrases, "phrase", "left_semi").count() == n
    assert left.count() < n * n / 8
    out = phrase_occurrences(docs, lexicon, ["id"])
    joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert "LeftSemi" in joins[0] and len(joins) == 3  # asked last, of what the bitmap leaves
    got = found(out)
    texts = {r.id: r.text.split() for r in docs.collect()}
    want = sorted((i, s, 2, f"{a} {b}") for i, t in texts.items() for s, (a, b) in enumerate(zip(t, t[1:])) if int(b[1:]) == (int(a[1:]) * 7 + 1) % n)
    assert got == want and want
