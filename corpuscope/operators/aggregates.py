"""Corpus-level statistics over the per-document counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def domain_stats(df: DataFrame, label_col: str = "predicted_domain") -> DataFrame:
    """Size and length statistics per label. Only count columns are read, never the text.

    Everything follows from one table of labels and lengths, so the (lower) median is exact and no
    task sees more rows than there are different lengths."""
    x, n = F.col("token_count"), F.col("n")
    lengths = df.groupBy(label_col, "token_count").agg(
        F.count(F.lit(1)).alias("n"),
        *[f(c).alias(f"{name}_{c}") for c in ("sentence_count", "char_count", "mix_rate") for name, f in (("sum", F.sum), ("n", F.count))],
    )
    # A null length is in no statistic of lengths.
    weight = F.when(x.isNotNull(), n).otherwise(F.lit(0))
    up_to = F.sum(weight).over(Window.partitionBy(label_col).orderBy("token_count"))
    total = F.sum(weight).over(Window.partitionBy(label_col))
    placed = lengths.withColumns({"_w": weight, "_middle": F.when(2 * up_to >= total, x)})
    count, tokens, squares = F.sum("_w"), F.sum(x * n), F.sum((x * x * n).cast("double"))
    spread = (squares - tokens * tokens.cast("double") / count) / (count - 1)

    def mean(c: str) -> Column:
        return F.sum(f"sum_{c}") / F.sum(f"n_{c}")

    return placed.groupBy(label_col).agg(
        F.sum("n").alias("document_count"),
        (tokens / count).alias("avg_tokens"),
        F.when(count > 1, F.sqrt(F.greatest(spread, F.lit(0.0)))).alias("std_tokens"),
        F.min("_middle").alias("median_tokens"),
        mean("sentence_count").alias("avg_sentences"),
        mean("char_count").alias("avg_characters"),
        mean("mix_rate").alias("avg_mix_rate"),
        tokens.alias("total_tokens"),
    )


def corpus_totals(df: DataFrame, label_col: str = "predicted_domain") -> DataFrame:
    """One row: documents, distinct labels, tokens, characters.

    Summing per label first keeps the distinct count off the documents; a null label is not a
    label, as in any distinct count, yet its documents are in the totals."""
    per_label = df.groupBy(label_col).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("token_count").alias("t"),
        F.sum("char_count").alias("c"),
    )
    return per_label.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("documents"),
        F.count(label_col).alias("domains"),
        F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum("c"), F.lit(0)).alias("characters"),
    )
