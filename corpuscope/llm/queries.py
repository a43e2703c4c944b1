"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from corpuscope.llm import byte_bpe, conversation_trie, divergence, fingerprints, language_id, lm_scoring, marks, near_duplicates, packing, pii, quality_rules, sequence_files, toxicity, warc
from corpuscope.session import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "source")
    judged = quality_rules.quality_rules(docs.select("doc_id", "source", "text"), carry_text=False)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op8_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select(
        "doc_id",
        *[pii.count_of(k, F.col("base_spans")).alias(f"n_{k}") for k in pii.BASE_KINDS],
        F.sha2(pii.spelled(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"),
        pii.spelled(F.col("spans")).alias("spans"),
        pii.count_of("secret", F.col("spans")).alias("n_secret"),
        F.size("spans").cast("bigint").alias("n_spans"),
    )


def op3_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages", "page_id", "url", "html")
    return warc.round_trip(pages, scratch_path(spark, "warc"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    good = _table(spark, sf_dir, "labels", "doc_id", "quality").where("quality = 1").select("doc_id")
    docs = marks.marked(docs, "doc_id", good, "_good")
    return lm_scoring.cross_entropy_difference(docs, "_good").drop("_good")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.fingerprints(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    coded = byte_bpe.decode(byte_bpe.encode(docs, ranks), ranks)
    listed = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(listed("ids").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
        F.sha2(listed("starts").cast("binary"), 256).alias("starts_sha256"),
        F.length("text").cast("bigint").alias("n_chars"),
    )


def op7_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def _crc(divisor: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def _held_out(divisor: int, remainder: int):
    """A null id has no remainder, so it is not held out; nothing is learned from it either."""
    return F.coalesce(_crc(divisor) == remainder, F.lit(False)).alias("held_out")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = language_id.fit(docs, _crc(4) != 2)
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", _held_out(4, 2), "lang_pred", "score")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    labels = _table(spark, sf_dir, "labels", "doc_id", "toxic")
    scored = toxicity.toxicity(docs, labels, _crc(5) != 0)
    return scored.select("doc_id", _held_out(5, 0), "score", "predicted")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents", "lang", "source", "text"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return conversation_trie.prefix_trie(conversation_trie.conversations(turns))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    index = sequence_files.write_sequences(docs, scratch_path(spark, "sequences"), vocabulary, end_id=2)
    return sequence_files.read_documents(index).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_pii": op2_pii,
    "op3_warc_captures": op3_warc_captures,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_fingerprints": op5_fingerprints,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_retrieval_packing": op7_retrieval_packing,
    "op8_minhash_near_duplicates": op8_minhash_near_duplicates,
    "op9_language_id": op9_language_id,
    "op10_toxicity": op10_toxicity,
    "op11_source_divergence": op11_source_divergence,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_token_files": op13_token_files,
}
