"""The registered queries: every operator over the whole test tables.

Arrays are joined with ``|`` and means are rounded to 6 places, so that results can be compared
value by value with another engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscope.functions import text as T
from corpuscope.operators import aggregates, dedup, dictionary, docstats, domain, gender, geo, phrases, sampling, topics, variational, vocab
from corpuscope.plans import fixture as X
from corpuscope.session import materialize, scratch_path
from corpuscope.sources import writers
from corpuscope.sources.lexicons import lexicon_entries
from corpuscope.sources.shards import parse_documents, read_documents
from corpuscope.sources.tables import read_labels, read_table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
LABEL = "lang"


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(
        spark, f"{sf_dir}/documents.parquet", ["doc_id", "lang", "text"], spread_by="doc_id"
    )


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def joined(col: Column | str) -> Column:
    return F.array_join(col, "|")


# -- per-document expressions ---------------------------------------------------------------


@query
def doc_text(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", T.document_text("text").alias("text"))


@query
def doc_hash(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.content_hash("text").alias("sha256"))


def _stats(spark, sf_dir, profile=X.ACCENTED):
    return docstats.with_doc_stats(documents(spark, sf_dir), profile)


@query
def doc_stats(spark, sf_dir):
    return rounded(_stats(spark, sf_dir).drop("text", "lang"), "mix_rate")


@query
def script_tokens(spark, sf_dir):
    tokens = T.script_tokens("text", X.ACCENTED)
    return documents(spark, sf_dir).select("doc_id", joined(tokens).alias("tokens"))


@query
def token_rows(spark, sf_dir):
    return vocab.token_rows(documents(spark, sf_dir), X.PROFILE, label_col=LABEL)


@query
def leading_shingle(spark, sf_dir):
    docs = dedup.with_leading_shingle(documents(spark, sf_dir), X.PROFILE, X.SHINGLE)
    return docs.select("doc_id", "shingle")


@query
def normalize_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.normalize_text("text").alias("text"))


@query
def norm_tokens(spark, sf_dir):
    tokens = T.normalized_tokens("text")
    return documents(spark, sf_dir).select("doc_id", joined(tokens).alias("tokens"))


@query
def match_count(spark, sf_dir):
    n = T.match_count("text", X.COUNTED_PATTERN)
    return documents(spark, sf_dir).select("doc_id", n.cast("bigint").alias("matches"))


@query
def literal_count(spark, sf_dir):
    counts = [
        T.literal_count("text", w).cast("bigint").alias(f"n_{w}") for w in X.COUNTED_WORDS
    ]
    return documents(spark, sf_dir).select("doc_id", *counts)


# -- domain inference -----------------------------------------------------------------------


@query
def lexicon_score(spark, sf_dir):
    scored = domain.with_lexicon_scores(documents(spark, sf_dir), X.MODEL)
    return scored.drop("lang", "text")


@query
def lexicon_score_wide(spark, sf_dir):
    scored = domain.with_lexicon_scores(documents(spark, sf_dir), X.WIDE_MODEL)
    return scored.drop("lang", "text")


@query
def rule_scores(spark, sf_dir):
    counted = docstats.with_token_counts(documents(spark, sf_dir), X.PROFILE)
    scored = domain.with_rule_scores(counted, X.MODEL)
    return scored.select("doc_id", *[f"rule_{d}" for d in X.MODEL.domains])


def _inferred(spark, sf_dir):
    return domain.infer_domain(_stats(spark, sf_dir), X.MODEL, X.PROFILE)


@query
def infer_domain(spark, sf_dir):
    found = _inferred(spark, sf_dir)
    return rounded(found.select("doc_id", "predicted_domain", "confidence"), "confidence")


@query
def domain_distribution(spark, sf_dir):
    return domain.domain_distribution(_inferred(spark, sf_dir))


# -- aggregates -----------------------------------------------------------------------------

_MEANS = ("avg_tokens", "std_tokens", "avg_sentences", "avg_characters", "avg_mix_rate")


@query
def domain_stats(spark, sf_dir):
    return rounded(aggregates.domain_stats(_inferred(spark, sf_dir)), *_MEANS)


@query
def corpus_totals(spark, sf_dir):
    return aggregates.corpus_totals(_inferred(spark, sf_dir))


@query
def keyed_sample_docs(spark, sf_dir):
    return _bucketed_sample(spark, sf_dir, X.SAMPLE_FRACTION).select("doc_id", "lang")


def _bucketed_sample(spark, sf_dir, fraction):
    """A sample of the documents as a table in folders by bucket: only the first of them are read."""
    docs = documents(spark, sf_dir)
    table = docs.withColumn("bucket", sampling.sample_bucket("doc_id", X.SAMPLE_SALT))
    table = materialize(table, "bucketed", partition_by="bucket")
    return sampling.keyed_sample(table, "doc_id", fraction, X.SAMPLE_SALT, "bucket")


@query
def keyed_sample_texts(spark, sf_dir):
    """A fraction that ends inside a bucket, with the texts."""
    return _bucketed_sample(spark, sf_dir, X.ODD_FRACTION).select("doc_id", "text")


# -- vocabulary -----------------------------------------------------------------------------


def _token_counts(spark, sf_dir):
    return vocab.token_counts(token_rows(spark, sf_dir), LABEL)


@query
def ttr(spark, sf_dir):
    return rounded(vocab.type_token_ratio(_token_counts(spark, sf_dir), LABEL), "ttr")


@query
def ttr_sketched(spark, sf_dir):
    """Sketches of two runs over halves of the documents, written apart and merged: totals, and whether
    the number of distinct tokens is within the bound of the exact one."""
    docs = documents(spark, sf_dir)
    runs = []
    for half in (0, 1):
        rows = vocab.token_rows(docs.where(F.pmod("doc_id", F.lit(2)) == half), X.PROFILE, label_col=LABEL)
        runs.append(materialize(vocab.token_sketches(rows, LABEL), "token-sketches"))
    merged = vocab.type_token_ratio_sketched(runs[0].unionByName(runs[1]), LABEL)
    exact = vocab.type_token_ratio(_token_counts(spark, sf_dir), LABEL)
    exact = exact.select(F.col(LABEL).alias("of"), F.col("unique_tokens").alias("exact"))
    off = F.abs(F.col("unique_tokens") - F.col("exact"))
    return merged.join(exact, F.col(LABEL).eqNullSafe(F.col("of"))).select(
        LABEL, "total_tokens", (off <= F.col("exact") * vocab.SKETCH_BOUND).alias("within_bound")
    )


@query
def token_frequency(spark, sf_dir):
    return _token_counts(spark, sf_dir)


@query
def top_tokens(spark, sf_dir):
    return vocab.top_tokens(_token_counts(spark, sf_dir), 100, LABEL)


# -- duplicates -----------------------------------------------------------------------------


def _hashed(spark, sf_dir):
    return documents(spark, sf_dir).withColumn("sha256", T.content_hash("text"))


@query
def exact_dedup(spark, sf_dir):
    narrow = _hashed(spark, sf_dir).select("doc_id", "lang", "sha256")
    return dedup.exact_dedup(narrow, "doc_id")


@query
def exact_dup_summary(spark, sf_dir):
    return rounded(dedup.exact_dup_summary(_hashed(spark, sf_dir)), "exact_duplicate_rate")


def _shingled(spark, sf_dir):
    docs = dedup.with_leading_shingle(_hashed(spark, sf_dir), X.PROFILE, X.SHINGLE)
    return docs.drop("text")


def _shingle_groups(spark, sf_dir, digest=False):
    distinct = dedup.distinct_documents(
        _shingled(spark, sf_dir), LABEL, order_by="doc_id", digest=digest
    )
    return dedup.shingle_groups(distinct, LABEL)


@query
def near_dup_clusters(spark, sf_dir):
    return dedup.near_dup_clusters(_shingle_groups(spark, sf_dir))


@query
def near_dup_summary(spark, sf_dir):
    summary = dedup.near_dup_summary(_shingle_groups(spark, sf_dir, digest=True))
    return rounded(summary, "near_duplicate_rate")


@query
def dup_report(spark, sf_dir):
    """All counts of the duplicate report out of the one table of shingles."""
    return rounded(dedup.dup_summary(_shingle_groups(spark, sf_dir, digest=True)), "near_duplicate_rate")


@query
def near_dup_by_domain(spark, sf_dir):
    return dedup.near_dup_by_domain(_shingle_groups(spark, sf_dir, digest=True), LABEL)


@query
def near_dup_members(spark, sf_dir):
    narrow = _shingled(spark, sf_dir).filter(F.col("shingle").isNotNull())
    survivors = dedup.exact_dedup(narrow, "doc_id")
    clusters = dedup.near_dup_clusters(_shingle_groups(spark, sf_dir))
    return dedup.near_dup_members(survivors, clusters).select("doc_id", "lang", "shingle")


@query
def top_dup_clusters(spark, sf_dir):
    return dedup.top_dup_clusters(near_dup_clusters(spark, sf_dir), 50)


@query
def dup_cluster_texts(spark, sf_dir):
    """Three digests and the texts they stand for."""
    clusters = dedup.near_dup_clusters(_shingle_groups(spark, sf_dir, digest=True))
    top = dedup.top_dup_clusters(clusters, 3)
    return dedup.with_shingle_text(top, _shingled(spark, sf_dir))


# -- topics ---------------------------------------------------------------------------------


@query
def stopword_filter(spark, sf_dir):
    raw = documents(spark, sf_dir).select(
        "doc_id", T.script_tokens("text", X.PROFILE).alias("raw_tokens")
    )
    return topics.remove_stopwords(raw, X.STOPWORDS).select(
        "doc_id", joined("tokens").alias("tokens")
    )


def _topic_tokens(spark, sf_dir):
    return topics.topic_tokens(documents(spark, sf_dir), X.PROFILE, X.STOPWORDS)


@query
def vocab_df(spark, sf_dir):
    return topics.document_frequency(_topic_tokens(spark, sf_dir), 2)


def _keyed_tokens(spark, sf_dir):
    raw = documents(spark, sf_dir).select("doc_id", T.script_tokens("text", X.PROFILE).alias("raw_tokens"))
    return materialize(topics.remove_stopwords(raw, X.STOPWORDS).select("doc_id", "tokens"), "tokens")


@query
def term_dictionary(spark, sf_dir):
    """All terms of two documents or more, numbered by falling count."""
    return dictionary.dictionary(topics.document_frequency(_topic_tokens(spark, sf_dir), 2))


@query
def term_vectors(spark, sf_dir):
    """How often each term of the whole dictionary occurs in a document."""
    tokens = _keyed_tokens(spark, sf_dir)
    terms = materialize(dictionary.dictionary(topics.document_frequency(tokens, 2)), "dictionary")
    return dictionary.term_rows(tokens, terms, "doc_id")


@query
def lda_topics(spark, sf_dir):
    """What must hold of any fitted topics: per topic and rank, whether the weight is a share that
    falls with the rank, and whether the term is of the vocabulary."""
    tokens = materialize(_topic_tokens(spark, sf_dir), "tokens")
    model = topics.fit_topics(tokens, k=3, max_iter=5, vocabulary_size=1000, min_df=2)
    terms = topics.document_frequency(tokens, 2).orderBy(F.desc("term_count"), "term").limit(1000)
    found = model.topics(15).join(terms.select("term", F.lit(True).alias("known")), "term", "left")
    falls = F.coalesce(F.col("weight") <= F.lag("weight").over(Window.partitionBy("topic").orderBy("rank")), F.lit(True))
    share = (F.col("weight") > 0) & (F.col("weight") <= 1)
    return found.select(
        "topic", "rank", (falls & share).alias("orderly"), F.coalesce("known", F.lit(False)).alias("in_vocabulary")
    )


def _stable_model(spark, sf_dir):
    """Topics at full size: 20 of them, 20 iterations, 50,000 terms of five documents or more."""
    tokens = _keyed_tokens(spark, sf_dir)
    terms = materialize(dictionary.dictionary(topics.document_frequency(tokens, 5), 50_000), "dictionary")
    vectors = materialize(dictionary.sparse_vectors(tokens, terms, "doc_id"), "vectors")
    return variational.fit_stable_topics(vectors, "doc_id", terms.count(), k=20, iterations=20), terms, vectors


@query
def stable_topics(spark, sf_dir):
    """What must hold of the topics that do not depend on the layout, as for ``lda_topics``."""
    model, terms, _ = _stable_model(spark, sf_dir)
    found = model.topics(terms, 15).join(terms.select("term", F.lit(True).alias("known")), "term", "left")
    falls = F.coalesce(F.col("weight") <= F.lag("weight").over(Window.partitionBy("topic").orderBy("rank")), F.lit(True))
    share = (F.col("weight") > 0) & (F.col("weight") <= 1)
    return found.select(
        "topic", "rank", (falls & share).alias("orderly"), F.coalesce("known", F.lit(False)).alias("in_vocabulary")
    )


@query
def stable_fit_quality(spark, sf_dir):
    """The bound on all documents, after a saved model was read back, on another layout."""
    model, terms, vectors = _stable_model(spark, sf_dir)
    saved = materialize(model.table(spark, terms), "stable-topics")
    again = variational.StableTopics.load(saved)
    perplexity, likelihood = model.fit_quality(vectors)
    # A layout of its own, of as many parts as the table needs.
    same = again.fit_quality(vectors.repartition(F.xxhash64("doc_id"))) == (perplexity, likelihood)
    n = vectors.select(F.explode("counts").alias("n")).agg(F.sum("n").alias("vocabulary_tokens"))
    return n.select(
        "vocabulary_tokens",
        (F.abs(F.lit(perplexity) * F.col("vocabulary_tokens") + F.lit(likelihood)) <= 1e-6 * abs(likelihood)).alias(
            "perplexity_is_loss_per_token"
        ),
        F.lit(likelihood < 0).alias("likelihood_is_negative"),
        F.lit(same).alias("same_elsewhere"),
    )


@query
def fit_quality(spark, sf_dir):
    """Perplexity is the negative likelihood per token of the vocabulary, and positive."""
    model = topics.fit_topics(
        _topic_tokens(spark, sf_dir), k=3, max_iter=5, vocabulary_size=1000, min_df=2
    )
    perplexity, likelihood = model.fit_quality()
    length = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, x: a + x)
    n = model.vectors.agg(F.sum(length).cast("bigint").alias("vocabulary_tokens"))
    per_token = F.abs(F.lit(perplexity) * F.col("vocabulary_tokens") + F.lit(likelihood))
    return n.select(
        "vocabulary_tokens",
        (per_token <= 1e-6 * abs(likelihood)).alias("perplexity_is_loss_per_token"),
        F.lit(likelihood < 0).alias("likelihood_is_negative"),
    )


@query
def topics_reloaded(spark, sf_dir):
    """A saved model describes the same topics; terms of one topic and rank, before and after."""
    tokens = materialize(_topic_tokens(spark, sf_dir), "tokens")
    model = topics.fit_topics(tokens, k=3, max_iter=2, vocabulary_size=200, min_df=2)
    path = scratch_path(spark, "topic-model")
    model.save(path)
    again = topics.TopicModel.load(path, tokens).topics(15).withColumnRenamed("term", "again")
    both = model.topics(15).join(again.drop("weight"), ["topic", "rank"])
    return both.select("topic", "rank", (F.col("term") == F.col("again")).alias("same"))


# -- audits ---------------------------------------------------------------------------------


@query
def phrase_hits(spark, sf_dir):
    docs = gender.with_phrase_hits(documents(spark, sf_dir).select("doc_id", "text"), X.PHRASES)
    return docs.select("doc_id", F.inline("hits")).select(
        "doc_id", F.col("start").cast("bigint").alias("start"), "n", "phrase"
    )


@query
def phrase_table_hits(spark, sf_dir):
    """A list that grows with the table: the first two, three and four words of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    opening = F.transform(F.array(*map(F.lit, X.OPENINGS)), lambda n: F.when(F.size("k") >= n, F.array_join(F.slice("k", 1, n), " ")))
    listed = docs.select(T.normalized_tokens("text").alias("k")).select(F.explode(opening).alias("entry"))
    found = phrases.phrase_occurrences(docs, phrases.phrase_lexicon(listed, "entry"), ["doc_id"])
    return found.withColumn("start", F.col("start").cast("bigint"))


def _gender_scores(spark, sf_dir, lexicon=X.WORD_LEXICON):
    docs = gender.with_gender_evidence(documents(spark, sf_dir), lexicon)
    return gender.gender_scores(docs, LABEL, key_cols=["doc_id"])


@query
def gender_scores(spark, sf_dir):
    return rounded(_gender_scores(spark, sf_dir), "score")


@query
def gender_scores_phrases(spark, sf_dir):
    return rounded(_gender_scores(spark, sf_dir, X.PHRASE_LEXICON), "score")


@query
def gender_bias(spark, sf_dir):
    return gender.gender_bias(_gender_scores(spark, sf_dir), X.WORD_LEXICON.occupations, LABEL)


@query
def gender_share(spark, sf_dir):
    return rounded(gender.gender_share(gender_bias(spark, sf_dir)), "male_leaning_share")


@query
def gender_extremes(spark, sf_dir):
    return gender.gender_extremes(gender_bias(spark, sf_dir), 2)


@query
def geo_mentions(spark, sf_dir):
    docs = geo.with_place_counts(documents(spark, sf_dir), X.PLACES)
    return geo.place_mentions(docs, list(X.PLACES), LABEL)


@query
def geo_share(spark, sf_dir):
    return rounded(geo.place_share(geo_mentions(spark, sf_dir)), "share_pct")


# -- sources --------------------------------------------------------------------------------


@query
def parsed_documents(spark, sf_dir):
    """The documents written as blank-line separated shards and parsed back."""
    shards = scratch_path(spark, "shards")
    documents(spark, sf_dir).select("text").write.text(shards, lineSep="\n\n")
    return parse_documents(spark, shards, X.ACCENTED)


def _uneven_shards(spark, sf_dir):
    """Documents between blank lines of several kinds, half of them with the other line end."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    odd = F.col("doc_id") % 2 == 1
    shards = scratch_path(spark, "shards")
    spaced = F.concat("text", F.lit("\n \t"), F.when(F.col("doc_id") % 3 == 0, F.lit("\n\n")).otherwise(F.lit("")))
    docs.where(~odd).select(spaced).write.text(shards + "/unix", lineSep="\n")
    docs.where(odd).select(F.replace(spaced, F.lit("\n"), F.lit("\r\n"))).write.text(shards + "/dos", lineSep="\r\n")
    return [shards + "/unix", shards + "/dos"]


@query
def parsed_documents_spaced(spark, sf_dir):
    return parse_documents(spark, _uneven_shards(spark, sf_dir), X.ACCENTED)


@query
def row_keys(spark, sf_dir):
    """Documents, their keys, and the files in which the numbers run without a gap."""
    docs = read_documents(spark, _uneven_shards(spark, sf_dir), with_key=True)
    parts = F.split("row_key", "#", 2)
    per_file = docs.groupBy(parts[0].alias("f")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("row_key").alias("k"), F.max(parts[1].cast("bigint")).alias("last")
    )
    return per_file.agg(
        F.sum("n").alias("documents"), F.sum("k").alias("keys"), F.bool_and(F.col("last") + 1 == F.col("n")).alias("gapless")
    )


@query
def largest_label_texts(spark, sf_dir):
    """Documents of the most frequent label, from a table in folders by label: which one it is shows
    when the query runs, and the others' folders are not read."""
    folder = scratch_path(spark, "by-label")
    writers.write_parquet(documents(spark, sf_dir), folder, partition_by=LABEL)
    table = spark.read.parquet(folder)
    sizes = materialize(table.groupBy(LABEL).count(), "label-sizes")
    rank = F.row_number().over(Window.orderBy(F.desc("count"), F.asc_nulls_first(LABEL)))
    wanted = materialize(sizes.withColumn("rank", rank), "label-ranks").where("rank = 1")
    return read_labels(table, wanted, LABEL).select("doc_id", LABEL, "text")


def _sunk(spark, sf_dir, write, read):
    path = scratch_path(spark, write.__name__)
    write(documents(spark, sf_dir).select("doc_id", "lang", F.nullif("lang", F.lit("fr")).alias("not_fr")), path)
    return read("doc_id bigint, lang string, not_fr string", path)


@query
def sink_parquet(spark, sf_dir):
    return _sunk(spark, sf_dir, writers.write_parquet, lambda schema, path: spark.read.schema(schema).parquet(path))


@query
def sink_csv(spark, sf_dir):
    return _sunk(spark, sf_dir, writers.write_csv, lambda schema, path: spark.read.schema(schema).csv(path, header=True))


@query
def sink_json_lines(spark, sf_dir):
    return _sunk(spark, sf_dir, writers.write_json_lines, lambda schema, path: spark.read.schema(schema).json(path))


@query
def sink_json_report(spark, sf_dir):
    """A report of one row per language, read back as text."""
    path = scratch_path(spark, "report")
    writers.write_json_report(documents(spark, sf_dir).groupBy("lang").count(), path, pretty=False)
    row = F.from_json("value", "lang string, count bigint").alias("r")
    return spark.read.text(path).select(row).select("r.lang", F.col("r.count").alias("n"))


def _hard_cells(spark, sf_dir):
    """Texts with quotes, commas and line ends; every fifth is empty, every seventh null."""
    hard = F.concat(F.lit('"a", '), "text", F.lit('\n\\"b" '))
    cell = F.when(F.col("doc_id") % 7 == 0, F.lit(None)).when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(hard)
    return documents(spark, sf_dir).select("doc_id", cell.alias("cell"))


@query
def sink_csv_texts(spark, sf_dir):
    path = scratch_path(spark, "csv-texts")
    writers.write_csv(_hard_cells(spark, sf_dir), path)
    return writers.read_csv(spark, path, "doc_id bigint, cell string")


@query
def sink_json_texts(spark, sf_dir):
    path = scratch_path(spark, "json-texts")
    writers.write_json_lines(_hard_cells(spark, sf_dir), path)
    return spark.read.schema("doc_id bigint, cell string").json(path)


@query
def rule_group(spark, sf_dir):
    """A rule that counts only the matches in which one group of its pattern holds something."""
    rule = domain.Rule("x", 1, "count_at_least", pattern=X.GROUP_PATTERN, group=1, threshold=3)
    fires = rule.fires(F.col("text"), F.lit(0), F.lit(0.0))
    return documents(spark, sf_dir).select("doc_id", fires.alias("fires"))


@query
def lexicon_rows(spark, sf_dir):
    """Each document read as a word list of its own."""
    return lexicon_entries(documents(spark, sf_dir), "doc_id", "text")
