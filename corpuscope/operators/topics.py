"""Stop words, term counts and LDA topics on Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml.clustering import LDA, LDAModel, LocalLDAModel
from pyspark.ml.feature import CountVectorizerModel, StopWordsRemover
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.functions import text as T
from corpuscope.functions.profiles import ScriptProfile
from corpuscope.functions.rows import bind
from corpuscope.session import materialize


def remove_stopwords(
    df: DataFrame, stopwords: Sequence[str], tokens_col: str = "raw_tokens", out_col: str = "tokens"
) -> DataFrame:
    """Drops whole tokens, whatever their case; a word with punctuation attached stays."""
    remover = StopWordsRemover(
        inputCol=tokens_col, outputCol=out_col, stopWords=list(stopwords), locale="en_US"
    )
    return remover.transform(df)


def topic_tokens(
    df: DataFrame, profile: ScriptProfile, stopwords: Sequence[str], text_col: str = "text"
) -> DataFrame:
    raw = df.select(T.script_tokens(text_col, profile).alias("raw_tokens"))
    return remove_stopwords(raw, stopwords).select("tokens")


def document_frequency(tokens: DataFrame, min_df: int = 1, tokens_col: str = "tokens") -> DataFrame:
    """``(term, document_frequency, term_count)``: what a vocabulary is chosen from.

    One row per token: in the sorted tokens of a document the first of each run counts for the
    frequency; documents need no key for it."""
    sorted_once = bind(tokens.select(tokens_col), _sorted=F.sort_array(tokens_col))
    runs = F.transform(
        "_sorted",
        lambda t, i: F.struct(t.alias("term"), F.when(F.get("_sorted", i - 1) == t, 0).otherwise(1).alias("first")),
    )
    terms = (
        sorted_once.select(F.inline(runs))
        .groupBy("term")
        .agg(F.sum("first").alias("document_frequency"), F.count(F.lit(1)).alias("term_count"))
    )
    return terms.filter(F.col("document_frequency") >= min_df)


def vocabulary(tokens: DataFrame, size: int, min_df: int = 1) -> list[str]:
    """The ``size`` most frequent terms of ``min_df`` documents or more, ties in the order of terms."""
    terms = document_frequency(tokens, min_df)
    return [r.term for r in terms.orderBy(F.desc("term_count"), "term").limit(size).select("term").collect()]


@dataclass(frozen=True)
class TopicModel:
    """A fitted model with the term vectors it was fitted on."""

    vectorizer: CountVectorizerModel
    lda: LDAModel
    vectors: DataFrame

    def fit_quality(self) -> tuple[float, float]:
        """``(log_perplexity, log_likelihood)`` on the training documents.

        The perplexity is the negative likelihood per token. Both are wanted, so the likelihood,
        a pass of inference over all documents, is worked out once."""
        likelihood = self.lda.logLikelihood(self.vectors)
        per_term = self.vectors.select(Summarizer.normL1(F.col("features")).alias("n")).first().n
        return -likelihood / float(per_term.toArray().sum()), likelihood

    def topics(self, n_terms: int = 15) -> DataFrame:
        """``(topic, rank, term, weight)``, rank 1 first."""
        described = self.lda.describeTopics(n_terms)
        # Only the terms that are described are named: topics x n_terms of them at most.
        used = sorted({i for r in described.select("termIndices").collect() for i in r[0]})
        terms = self.vectorizer.vocabulary
        words = described.sparkSession.createDataFrame([(i, terms[i]) for i in used], "i int, term string")
        pairs = F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("r", "x")
        long = described.select("topic", pairs).select(
            "topic",
            (F.col("r") + 1).alias("rank"),
            F.col("x.termIndices").alias("i"),
            F.col("x.termWeights").alias("weight"),
        )
        return long.join(F.broadcast(words), "i").select("topic", "rank", "term", "weight")

    def save(self, path: str) -> None:
        root = path.rstrip("/")
        self.lda.write().overwrite().save(f"{root}/lda_model")
        self.vectorizer.write().overwrite().save(f"{root}/count_vectorizer")


    @classmethod
    def load(cls, path: str, tokens: DataFrame) -> TopicModel:
        """A saved model, with the term vectors of ``tokens`` in its vocabulary."""
        root = path.rstrip("/")
        vectorizer = CountVectorizerModel.load(f"{root}/count_vectorizer")
        return cls(vectorizer, LocalLDAModel.load(f"{root}/lda_model"), vectorizer.transform(tokens).select("features"))


def fit_topics(
    tokens: DataFrame,
    k: int = 20,
    max_iter: int = 20,
    vocabulary_size: int = 50_000,
    min_df: float = 5,
    seed: int = 42,
) -> TopicModel:
    """Term counts and online LDA over a frame with a ``tokens`` array.

    Training reads its input once per iteration. The tokens are therefore written out first, so a
    lost executor costs a read and a count instead of another pass over the corpus. ``min_df`` is a
    number of documents. The driver holds the vocabulary, and every update of the topics ``k`` times
    as many numbers: that is what ``vocabulary_size`` is for."""
    kept = materialize(tokens.select("tokens"), "topic-tokens")
    vectorizer = CountVectorizerModel.from_vocabulary(
        vocabulary(kept, vocabulary_size, int(min_df)), inputCol="tokens", outputCol="features"
    )
    vectors = vectorizer.transform(kept).select("features")
    vectors.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        lda = LDA(
            k=k, maxIter=max_iter, featuresCol="features", optimizer="online", seed=seed
        ).fit(vectors)
    finally:
        vectors.unpersist()
    return TopicModel(vectorizer, lda, vectors)


def topics_wide(topics: DataFrame) -> DataFrame:
    """``(topic, top_words)`` with the terms in rank order."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "term")))
    joined = F.array_join(F.transform(ordered, lambda x: x["term"]), ", ")
    return topics.groupBy("topic").agg(joined.alias("top_words"))
