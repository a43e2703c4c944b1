import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpuscope.functions.profiles import BENGALI, LATIN
from corpuscope.operators import aggregates, dedup, geo, vocab
from corpuscope.operators import bengali as B
from corpuscope.functions import text as T


@pytest.fixture(scope="module")
def corpus(spark):
    """Documents with exact copies, shared openings and a hot opening, over three labels."""
    rng = random.Random(11)
    words = ["aa", "bb", "cc", "dd", "x1"]
    openings = [" ".join(rng.choice(words) for _ in range(4)) for _ in range(12)]
    rows = []
    for i in range(600):
        head = openings[0] if i % 3 == 0 else rng.choice(openings)
        tail = " ".join(rng.choice(words) for _ in range(rng.randint(0, 3)))
        rows.append((i, f"{head} {tail}".strip() if i % 7 else "aa", "pqr"[i % 3] if i % 50 else None))
    df = spark.createDataFrame(rows, "id int, text string, predicted_domain string")
    return rows, df.withColumn("sha256", T.content_hash("text"))


def survivors(rows):
    first = {}
    for i, text, label in rows:
        first.setdefault(text, (i, text, label))
    return list(first.values())


def shingles(rows, k):
    out = []
    for i, text, label in survivors(rows):
        tokens = [t for t in text.split() if len(t) >= 2]
        if len(tokens) >= k:
            out.append((i, " ".join(tokens[:k]), label))
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_near_duplicates(corpus, parts):
    rows, df = corpus
    df = df.repartition(parts)
    k = 4
    eligible = shingles(rows, k)
    sizes = Counter(s for _, s, _ in eligible)
    dup = {s: n for s, n in sizes.items() if n > 1}
    cut = dedup.with_leading_shingle(df, LATIN, k)
    for digest in (False, True):
        groups = dedup.shingle_groups(
            dedup.distinct_documents(cut, order_by="id", digest=digest)
        )
        summary = dedup.near_dup_summary(groups).first()
        assert summary.eligible_documents == len(eligible)
        assert summary.near_duplicate_clusters == len(dup)
        assert summary.near_duplicate_documents == sum(dup.values()) - len(dup)
        assert summary.near_duplicate_rate == pytest.approx(
            summary.near_duplicate_documents / len(eligible)
        )
        whole = dedup.dup_summary(groups).first()
        assert (whole.documents_before, whole.documents_after) == (len(rows), len(survivors(rows)))
        by = {r.predicted_domain: r.near_dup_doc_count for r in dedup.near_dup_by_domain(groups).collect()}
        assert by == Counter(lab for _, s, lab in eligible if s in dup)
        assert sum(by.values()) - len(dup) == summary.near_duplicate_documents
    groups = dedup.shingle_groups(dedup.distinct_documents(cut, order_by="id"))
    clusters = dedup.near_dup_clusters(groups)
    assert {r.shingle: r.cluster_size for r in clusters.collect()} == dup
    labelled = Counter(s for _, s, lab in eligible if s in dup and lab)
    assert {r.shingle: r.doc_count for r in clusters.collect() if r.doc_count} == labelled
    top = [(r.cluster_size, r.shingle) for r in dedup.top_dup_clusters(clusters, 3).collect()]
    assert top == sorted(((n, s) for s, n in dup.items()), key=lambda x: (-x[0], x[1]))[:3]
    kept = dedup.exact_dedup(cut.filter("shingle is not null").drop("text"), "id")
    members = dedup.near_dup_members(kept, clusters)
    assert {r.id for r in members.collect()} == {i for i, s, _ in eligible if s in dup}


def test_distinct_without_order(corpus):
    rows, df = corpus
    # label as a function of the text
    cut = dedup.with_leading_shingle(
        df.withColumn("predicted_domain", F.substring("text", 1, 1)), LATIN, 4
    )
    got = dedup.distinct_documents(cut)
    assert got.count() == len(survivors(rows))
    assert got.filter("shingle is not null").count() == len(shingles(rows, 4))


def test_texts_of_digests_and_members_of_many_clusters(corpus):
    rows, df = corpus
    cut = dedup.with_leading_shingle(df, LATIN, 4)
    sizes = Counter(s for _, s, _ in shingles(rows, 4))
    groups = dedup.shingle_groups(dedup.distinct_documents(cut, order_by="id", digest=True))
    top = dedup.top_dup_clusters(dedup.near_dup_clusters(groups), 100)
    got = {r.shingle: r.cluster_size for r in dedup.with_shingle_text(top, cut).collect()}
    assert got == {s: n for s, n in sizes.items() if n > 1}
    groups = dedup.shingle_groups(dedup.distinct_documents(cut, order_by="id"))
    members = dedup.near_dup_members(cut.select("id", "shingle"), dedup.near_dup_clusters(groups))
    want = [i for i, text, _ in rows for s in [" ".join(text.split()[:4])] if sizes.get(s, 0) > 1]
    assert sorted(r.id for r in members.collect()) == want


def test_members_of_one_large_cluster(spark):
    rows = [(i, "same first words " + str(i) if i % 2 else f"other {i} words {i}") for i in range(400)]
    df = dedup.with_leading_shingle(spark.createDataFrame(rows, "id int, text string"), LATIN, 3)
    df = df.withColumn("label", F.lit("x")).withColumn("sha256", F.sha2("text", 256))
    groups = dedup.shingle_groups(dedup.distinct_documents(df, "label", order_by="id"), "label")
    members = dedup.near_dup_members(df.select("id", "shingle"), dedup.near_dup_clusters(groups))
    assert sorted(r.id for r in members.collect()) == list(range(1, 400, 2))


def test_exact_duplicates(corpus):
    rows, df = corpus
    kept = survivors(rows)
    got = {(r.id, r.text, r.predicted_domain) for r in dedup.exact_dedup(df, "id").collect()}
    assert got == set(kept)
    summary = dedup.exact_dup_summary(df).first()
    assert tuple(summary)[:3] == (len(rows), len(kept), len(rows) - len(kept))
    assert summary.exact_duplicate_rate == pytest.approx(1 - len(kept) / len(rows))
    empty = dedup.exact_dup_summary(df.limit(0)).first()
    assert tuple(empty) == (0, 0, 0, 0.0)


def test_min_tokens_apart_from_k(frame):
    df = dedup.with_leading_shingle(frame("aa bb", "aa bb cc dd", "aa"), LATIN, 3, 2).orderBy("id")
    assert [r.shingle for r in df.collect()] == ["aa bb", "aa bb cc", None]


def test_vocabulary(spark):
    rows = [("p", "aa bb aa"), ("q", "aa cc"), ("p", "bb x")]
    df = spark.createDataFrame(rows, "predicted_domain string, text string")
    tokens = vocab.token_rows(df, LATIN)
    counts = vocab.token_counts(tokens)
    ttr = {r.predicted_domain: tuple(r)[1:] for r in vocab.type_token_ratio(counts).collect()}
    assert ttr == {"p": (4, 2, 0.5), "q": (2, 2, 1.0)}
    top = sorted(tuple(r) for r in vocab.top_tokens(counts, 1).collect())
    # equal counts: the smaller token
    assert top == [("p", "aa", 2, 1), ("q", "aa", 1, 1)]
    sketches = vocab.token_sketches(tokens)
    merged = vocab.type_token_ratio_sketched(sketches.unionByName(vocab.token_sketches(tokens.where("token = 'aa'"))))
    assert {r.predicted_domain: tuple(r)[1:3] for r in merged.collect()} == {"p": (6, 2), "q": (3, 2)}
    # the same as joining totals and distinct counts
    totals = tokens.groupBy("predicted_domain").count()
    unique = tokens.distinct().groupBy("predicted_domain").agg(F.count("*").alias("u"))
    joined = {r.predicted_domain: (r["count"], r.u) for r in totals.join(unique, "predicted_domain").collect()}
    assert joined == {d: v[:2] for d, v in ttr.items()}


def test_merged_sketches_keep_their_bound(spark):
    """Three runs with common tokens; a label that only one run has."""
    runs = [
        spark.range(lo, hi).select(F.lit("p").alias("d"), F.concat(F.lit("w"), "id").alias("token"))
        for lo, hi in ((0, 60_000), (40_000, 100_000), (0, 1))
    ]
    runs[2] = runs[2].withColumn("d", F.lit("q"))
    tables = [vocab.token_sketches(r, "d") for r in runs]
    merged = vocab.type_token_ratio_sketched(tables[0].unionByName(tables[1]).unionByName(tables[2]), "d")
    got = {r.d: (r.total_tokens, r.unique_tokens) for r in merged.collect()}
    assert got["q"] == (1, 1) and got["p"][0] == 120_000
    assert abs(got["p"][1] - 100_000) <= 100_000 * vocab.SKETCH_BOUND
    assert vocab.type_token_ratio_sketched(tables[0].limit(0), "d").count() == 0


def test_statistics(spark):
    rows = [("p", 1, 1, 10, 0.0), ("p", 3, 1, 20, 0.5), ("p", 8, 4, 30, 1.0), (None, 5, 2, 7, 0.0)]
    df = spark.createDataFrame(
        rows, "predicted_domain string, token_count int, sentence_count int, char_count int, mix_rate double"
    )
    got = {r.predicted_domain: r for r in aggregates.domain_stats(df).collect()}
    p = got["p"]
    assert (p.document_count, p.avg_tokens, p.median_tokens, p.total_tokens) == (3, 4.0, 3, 12)
    assert p.std_tokens == pytest.approx(13**0.5) and got[None].std_tokens is None
    assert (p.avg_sentences, p.avg_characters, p.avg_mix_rate) == (2.0, 20.0, 0.5)
    assert tuple(aggregates.corpus_totals(df).first()) == (4, 1, 17, 67)
    assert tuple(aggregates.corpus_totals(df.limit(0)).first()) == (0, 0, 0, 0)


def test_places(spark):
    rows = [("p", "ঢাকাইয়া ঢাকা"), ("q", "সিলেটি খুলনা"), ("q", "কিছু না"), (None, "ঢাকা")]
    df = spark.createDataFrame(rows, "predicted_domain string, text string")
    counted = geo.with_place_counts(df, B.PLACES)
    mentions = geo.place_mentions(counted, list(B.PLACES))
    got = {(r.place, r.domain): r.total_mentions for r in mentions.collect()}
    assert got["Dhaka", "p"] == 2 and got["Dhaka", None] == 1 and got["Dhaka", "ALL"] == 3
    assert got["Sylhet", "q"] == 1 and got["Khulna", "ALL"] == 1 and got["Rangpur", "ALL"] == 0
    assert len(got) == 8 * 4
    for place in B.PLACES:
        assert sum(n for (p, d), n in got.items() if p == place and d != "ALL") == got[place, "ALL"]
    share = [tuple(r) for r in geo.place_share(mentions).collect()]
    assert share[0] == ("Dhaka", 3, 60.0) and share[1][0] == "Khulna" and share[2][0] == "Sylhet"


def test_place_pattern_is_literal_and_ordered(frame):
    assert geo.place_pattern(["a.b", "c"]) == "a\\.b|c"
    df = frame("las la lax").select(geo.mention_count("text", ["la", "las"]).alias("n"))
    assert df.first().n == 3
    # an earlier short spelling leaves the rest of a longer one to the others
    assert frame("abc").select(geo.mention_count("text", ["ab", "abc", "c"]).alias("n")).first().n == 2
    assert frame("abc").select(geo.mention_count("text", ["abc", "ab", "c"]).alias("n")).first().n == 1


def test_bengali_shingle(frame):
    text = "এক দুই তিন চার পাঁচ ছয় সাত আট নয়"
    df = dedup.with_leading_shingle(frame(text, "এক দুই"), BENGALI).orderBy("id")
    assert [r.shingle for r in df.collect()] == [" ".join(text.split()[:8]), None]
