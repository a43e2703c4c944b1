"""Exact duplicates by content hash, near duplicates by leading shingle.

Shuffles carry digests and labels, not text, and every group is folded map-side first, so neither
a hash nor a shingle that holds a large share of all documents meets in one task as raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.functions import text as T
from corpuscope.functions.profiles import ScriptProfile
from corpuscope.functions.rows import bind


def exact_dedup(df: DataFrame, order_by: str, hash_col: str = "sha256") -> DataFrame:
    """One row per hash: the one with the smallest ``order_by``, which should be unique.

    What is grouped is hashes and keys; rows are only joined to the keys that survive, with Spark
    splitting whatever hash has more copies than a task should take."""
    first = df.groupBy(F.col(hash_col).alias("_hash")).agg(F.min(order_by).alias("_first"))
    same = F.col(hash_col).eqNullSafe(F.col("_hash")) & F.col(order_by).eqNullSafe(F.col("_first"))
    return df.join(first, same, "left_semi")


def exact_dup_summary(df: DataFrame, hash_col: str = "sha256") -> DataFrame:
    counts = df.agg(
        F.count(F.lit(1)).alias("documents_before"),
        F.count_distinct(F.unhex(hash_col)).alias("documents_after"),
    )
    removed = F.col("documents_before") - F.col("documents_after")
    return counts.select(
        "*",
        removed.alias("exact_duplicates"),
        T.safe_ratio(removed, F.col("documents_before")).alias("exact_duplicate_rate"),
    )


def with_leading_shingle(
    df: DataFrame,
    profile: ScriptProfile,
    k: int = 8,
    min_tokens: int | None = None,
    text_col: str = "text",
) -> DataFrame:
    """Adds ``shingle``: the first ``k`` script tokens, null for documents with fewer than
    ``min_tokens`` (default ``k``)."""
    shortest = k if min_tokens is None else min_tokens
    keep = [F.col(c) for c in df.columns]
    cut = bind(df, _t=T.script_tokens(text_col, profile))
    shingle = F.when(F.size("_t") >= shortest, T.leading_shingle("_t", k))
    return cut.select(*keep, shingle.alias("shingle"))


def distinct_documents(
    df: DataFrame,
    label_col: str = "predicted_domain",
    hash_col: str = "sha256",
    order_by: str | None = None,
    digest: bool = False,
) -> DataFrame:
    """``(label, shingle, copies)`` of every distinct text; the shingle is null for short ones, and
    ``copies`` is the number of rows that hold the text.

    Copies of one text share the hash and the shingle. With ``order_by`` the copy that has the
    smallest value there lends its label. Without it labels must be a function of the text, as
    inferred domains are. ``digest`` replaces the shingle by its SHA-256 before anything is
    shuffled: 32 bytes, whatever the script."""
    key = F.unhex(F.sha2("shingle", 256)) if digest else F.col("shingle")
    columns = [F.unhex(hash_col).alias("_hash"), key.alias("shingle"), label_col]
    copies = F.count(F.lit(1)).alias("copies")
    if order_by is None:
        kept = df.select(*columns).groupBy("_hash", "shingle", label_col).agg(copies)
    else:
        first = F.min_by(label_col, order_by).alias(label_col)
        kept = df.select(*columns, order_by).groupBy("_hash", "shingle").agg(first, copies)
    return kept.select(label_col, "shingle", "copies")


def shingle_groups(distinct: DataFrame, label_col: str = "predicted_domain") -> DataFrame:
    """``(shingle, size, doc_count, copies, labels)``: the one table behind every duplicate report.

    A row per shingle: its distinct texts, those of them with a label, the rows that hold them, and an
    array of ``(label, n)``, as long as there are labels. Texts are folded by shingle and label before
    they are put together, so a shingle of any size arrives as a few numbers. The row without a shingle
    stands for the short texts, which are distinct documents but in no near-duplicate group."""
    per_label = distinct.groupBy("shingle", label_col).agg(
        F.count(F.lit(1)).alias("n"), F.sum("copies").alias("copies")
    )
    labelled = F.when(F.col(label_col).isNotNull(), F.col("n")).otherwise(F.lit(0))
    return per_label.groupBy("shingle").agg(
        F.sum("n").alias("size"),
        F.sum(labelled).alias("doc_count"),
        F.sum("copies").alias("copies"),
        F.collect_list(F.struct(F.col(label_col).alias("label"), "n")).alias("labels"),
    )


def _shared(groups: DataFrame) -> DataFrame:
    return groups.filter(F.col("shingle").isNotNull() & (F.col("size") > 1))


def near_dup_clusters(groups: DataFrame) -> DataFrame:
    """Shingles shared by two or more documents. ``doc_count`` leaves out null labels."""
    return _shared(groups).select("shingle", F.col("size").alias("cluster_size"), "doc_count")


def top_dup_clusters(clusters: DataFrame, n: int = 50) -> DataFrame:
    """The largest clusters, ties in the order of their key."""
    return clusters.orderBy(F.desc("cluster_size"), F.asc("shingle")).limit(n)


def with_shingle_text(top: DataFrame, docs: DataFrame) -> DataFrame:
    """Puts the text back in place of the digests of a few clusters, which are broadcast: ``top``
    has to come from ``top_dup_clusters``. One scan of the shingle column, and of a cluster's
    copies each task passes on a single row."""
    texts = docs.select("shingle").filter(F.col("shingle").isNotNull())
    texts = texts.withColumn("_digest", F.unhex(F.sha2("shingle", 256)))
    keys = F.broadcast(top.withColumnRenamed("shingle", "_digest"))
    found = texts.join(keys, "_digest").select("shingle", "cluster_size", "doc_count").distinct()
    return found.orderBy(F.desc("cluster_size"), F.asc("shingle"))


def dup_summary(groups: DataFrame) -> DataFrame:
    """One row: documents before and after exact deduplication, eligible documents, clusters,
    redundant documents (all but one per cluster) and their share in the eligible ones."""
    size, listed = F.col("size"), F.col("shingle").isNotNull()
    dup = listed & (size > 1)

    def total(x: Column, when: Column | None = None) -> Column:
        return F.coalesce(F.sum(x if when is None else F.when(when, x)), F.lit(0))

    totals = groups.agg(
        total(F.col("copies")).alias("documents_before"),
        total(size).alias("documents_after"),
        total(size, listed).alias("eligible_documents"),
        F.count_if(dup).alias("near_duplicate_clusters"),
        total(size - 1, dup).alias("near_duplicate_documents"),
    )
    rate = T.safe_ratio(F.col("near_duplicate_documents"), F.col("eligible_documents"))
    return totals.withColumn("near_duplicate_rate", rate)


def near_dup_summary(groups: DataFrame) -> DataFrame:
    return dup_summary(groups).drop("documents_before", "documents_after")


def near_dup_by_domain(groups: DataFrame, label_col: str = "predicted_domain") -> DataFrame:
    """Documents taking part in a cluster, per label."""
    members = _shared(groups).select(F.inline("labels"))
    per_label = members.groupBy(F.col("label").alias(label_col)).agg(F.sum("n").alias("near_dup_doc_count"))
    return per_label.orderBy(F.desc("near_dup_doc_count"), F.asc(label_col))


def near_dup_members(docs: DataFrame, clusters: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose shingle is shared.

    Joined by the digests of the shingles, 32 bytes each. A cluster has one row on its side, so a
    cluster of any size may be cut into as many tasks as Spark's handling of skew sees fit."""
    digest = F.unhex(F.sha2("shingle", 256))
    shared = clusters.select(digest.alias("_digest"))
    keyed = docs.withColumn("_digest", digest)
    return keyed.join(shared, "_digest", "left_semi").select(*docs.columns)
