"""Vocabulary statistics. Everything derives from one ``(label, token, n)`` aggregate.

Frequent tokens do not skew that aggregate: each task has already folded its copies of a token
into one row before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.functions import text as T
from corpuscope.functions.profiles import ScriptProfile

#: Registers of a sketch, as a power of two, and the relative error of a distinct count: about four
#: standard deviations of 1.04 / sqrt(registers), as merged sketches have it.
SKETCH_LOG_SIZE, SKETCH_BOUND = 14, 0.035


def token_rows(
    df: DataFrame,
    profile: ScriptProfile,
    text_col: str = "text",
    label_col: str = "predicted_domain",
) -> DataFrame:
    """One row per occurrence of a script token. Filtering the rows keeps the test of each token
    in generated code, which an array filter would not."""
    rows = df.select(label_col, F.explode(T.tokens(text_col)).alias("token"))
    return rows.filter(T.is_script_token("token", profile))


def token_counts(token_df: DataFrame, label_col: str = "predicted_domain") -> DataFrame:
    return token_df.groupBy(label_col, "token").agg(F.count(F.lit(1)).alias("count"))


def type_token_ratio(counts: DataFrame, label_col: str = "predicted_domain") -> DataFrame:
    """Totals and distinct tokens fall out of the same aggregate, so no join is needed."""
    per_label = counts.groupBy(label_col).agg(
        F.sum("count").alias("total_tokens"), F.count(F.lit(1)).alias("unique_tokens")
    )
    return per_label.withColumn("ttr", F.col("unique_tokens") / F.col("total_tokens"))


def token_sketches(token_df: DataFrame, label_col: str = "predicted_domain") -> DataFrame:
    """``(label, total_tokens, sketch)``: what a run leaves behind about its vocabulary, some 16 KB a
    label. Tables of several runs are put together by ``union``; no token is shuffled."""
    return token_df.groupBy(label_col).agg(
        F.count(F.lit(1)).alias("total_tokens"), F.hll_sketch_agg("token", F.lit(SKETCH_LOG_SIZE)).alias("sketch")
    )


def type_token_ratio_sketched(sketches: DataFrame, label_col: str = "predicted_domain") -> DataFrame:
    """``type_token_ratio`` of all runs together; distinct tokens are off by ``SKETCH_BOUND`` at most,
    but for one label in a thousand."""
    per_label = sketches.groupBy(label_col).agg(
        F.sum("total_tokens").alias("total_tokens"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("unique_tokens"),
    )
    return per_label.withColumn("ttr", F.col("unique_tokens") / F.col("total_tokens"))


def top_tokens(counts: DataFrame, n: int = 100, label_col: str = "predicted_domain") -> DataFrame:
    """The ``n`` most frequent tokens per label, ties in token order. The rank filter makes Spark
    cut each task's share to ``n`` rows per label before the shuffle."""
    order: list[Column] = [F.desc("count"), F.asc("token")]
    ranked = counts.withColumn(
        "rank", F.row_number().over(Window.partitionBy(label_col).orderBy(*order))
    )
    return ranked.filter(F.col("rank") <= n)
