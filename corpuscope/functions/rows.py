"""Row-level helpers that work on frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(df: DataFrame, **columns: Column) -> DataFrame:
    """``withColumns`` for costly expressions: each is evaluated once per row, for good.

    A plain projection is no promise. Catalyst copies its expressions into filters that it moves
    below it, also into filters that it adds itself under ``explode``, and an expression copied
    into a lambda body is then worked out once per array element. A generator that yields exactly
    one row per input row is a fence for these copies; filters on the other columns still pass."""
    keep = [F.col(c) for c in df.columns if c not in columns]
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*keep, F.inline(F.array(row)))
