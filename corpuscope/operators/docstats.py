"""Per-document counts, hash and code-mixing rate: one narrow projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.functions import text as T
from corpuscope.functions.profiles import ScriptProfile
from corpuscope.functions.rows import bind


def with_token_counts(df: DataFrame, profile: ScriptProfile, text_col: str = "text") -> DataFrame:
    """Adds ``token_count``, ``primary_token_count``, ``latin_token_count`` and ``mix_rate``.

    The token array is built once and dropped again; three sizes are taken from it."""
    keep = [F.col(c) for c in df.columns]
    counted = bind(df, _tokens=T.tokens(text_col)).select(
        *keep,
        F.size("_tokens").alias("token_count"),
        F.size(T.primary_tokens("_tokens", profile)).alias("primary_token_count"),
        F.size(T.secondary_tokens("_tokens", profile)).alias("latin_token_count"),
    )
    rate = T.safe_ratio(F.col("latin_token_count"), F.col("token_count"))
    return counted.withColumn("mix_rate", rate)


def line_count(text_col: str | Column) -> Column:
    return F.size(T.lines(text_col))


def with_doc_stats(
    df: DataFrame,
    profile: ScriptProfile,
    text_col: str = "text",
    line_count_col: Column | None = None,
) -> DataFrame:
    """Token counts plus ``char_count``, ``sha256`` and ``sentence_count``.

    A "sentence" is a non-empty line of the source document. Once lines are joined their number
    is lost, so a caller that still has it passes it as ``line_count_col``."""
    n_lines = line_count(text_col) if line_count_col is None else line_count_col
    base = (
        df.withColumn("sentence_count", n_lines)
        .withColumn("char_count", F.length(text_col))
        .withColumn("sha256", T.content_hash(text_col))
    )
    return with_token_counts(base, profile, text_col)
