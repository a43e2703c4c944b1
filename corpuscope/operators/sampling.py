"""Bernoulli samples that return the same rows on every layout, cluster and rerun."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.functions import text as T

#: Folders of a table that is to be sampled; a task writes one file into each.
BUCKETS = 10


def sample_bucket(key: str | Column, salt: str = "42:", buckets: int = BUCKETS) -> Column:
    """Which of ``buckets`` equal parts of [0, 1) the key's number lies in. A table partitioned by it
    keeps every sample of it in its first folders."""
    return F.floor(T.keyed_uniform(key, salt) * buckets).cast("int")


def keyed_sample(
    df: DataFrame,
    key: str | Column,
    fraction: float,
    salt: str = "42:",
    bucket_col: str | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Rows whose key's number is below ``fraction``. A null key has no number and is in no sample but
    the whole.

    ``bucket_col`` is the ``sample_bucket`` by which the table is partitioned, for the same key, salt
    and number of buckets: then folders beyond the fraction are not read, and the number is only
    worked out where the fraction ends inside a bucket."""
    if not 0.0 <= fraction <= 1.0:
        raise ValueError(f"fraction must lie in [0, 1], got {fraction}")
    if fraction == 1.0:
        return df
    below = T.keyed_uniform(key, salt) < fraction
    if bucket_col is None:
        return df.filter(below)
    whole = math.floor(fraction * buckets)
    if whole / buckets == fraction:
        return df.filter(F.col(bucket_col) < whole)
    return df.filter((F.col(bucket_col) <= whole) & below)
