"""From raw documents to packed training sequences.

Every stage works on all that the one before kept, and each but the last returns the columns of
``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.llm import marks, near_duplicates, packing, pii, quality_rules
from corpuscope.llm import toxicity as toxic
from corpuscope.session import materialize


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a score of 0.5 or more. The model learns from four fifths of the labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    params = toxic.train(docs, labels, fold != 0)
    return toxic.score(docs, params, "_toxicity").where("_toxicity < 0.5").drop("_toxicity")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that break a base rule or come from a refused host."""
    # The whole row travels in one column, so that none of its names can be taken for a rule's.
    rows = docs.select(F.struct("*").alias("_row"), "text", "source")
    return quality_rules.quality_rules(rows, carry_text=False).where("kept").select("_row.*")


def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group: the one with the smallest id; of several such rows, and of rows
    without an id, where a group has no others, the first. Rows are told apart by their place in
    ``docs``, a written table, so repeated and null ids make no difference."""
    rows = docs.withColumn("_row", F.monotonically_increasing_id())
    found = near_duplicates.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"))
    ids = rows.select(F.col("_row").alias("row"), F.col("doc_id").cast("bigint").alias("id"))
    groups = found.select(F.col("doc_id").alias("row"), "component_id").join(ids, "row")
    # The smallest of a group is an aggregate: nothing is joined by group, however large one is.
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"))
    # Only places of rows are shuffled, never the texts.
    return marks.marked(rows, "_row", first.select("first.row"), "_kept").where("_kept").select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; ``n_chars`` is that of the new text."""
    out = pii.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("quality rules", quality),
    ("near duplicates", duplicates),
    ("personal data", personal_data),
    ("packing", pack),
]
#: A network's scores and a retrieval order are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
