"""Rows chosen by a number they have, without a shuffle of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.session import materialize

#: Numbers in one block of the bitmap, 64 to a word, and how many blocks (16 MB) are broadcast at most.
BLOCK, MAX_BLOCKS = 4096, 1 << 15


def _bitmap(numbers: DataFrame) -> DataFrame:
    """``(_block, _words)``: one bit per number ``n``."""
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("n").bitwiseAND(F.lit(63)).cast("int"))
    words = numbers.groupBy(F.shiftright("n", 6).alias("word")).agg(F.bit_or(mask).alias("mask"))
    at = F.col("word").bitwiseAND(F.lit(BLOCK // 64 - 1)).cast("int")
    entries = F.collect_list(F.struct(at.alias("at"), "mask"))
    blocks = words.groupBy(F.floor(F.col("word") / (BLOCK // 64)).alias("_block")).agg(F.map_from_entries(entries).alias("m"))
    every = F.sequence(F.lit(0), F.lit(BLOCK // 64 - 1))
    return blocks.select("_block", F.transform(every, lambda i: F.coalesce(F.col("m")[i], F.lit(0).cast("bigint"))).alias("_words"))


def marked(rows: DataFrame, number: str, chosen: DataFrame, name: str) -> DataFrame:
    """``rows`` with the boolean ``name``: whether their bigint ``number`` is among those of ``chosen``,
    a frame of one column; a null is not. An own column called ``name`` is replaced.

    Numbers that lie close, such as ids in sequence or places of rows, become a bitmap of about a bit
    each. While it is small it is broadcast, and the rows stay where they are; numbers that lie
    further apart than that are joined by a shuffle of both sides."""
    rows = rows.drop(name)
    own = [F.col(f"`{c}`") for c in rows.columns]
    numbers = chosen.toDF("n").where("n IS NOT NULL").select(F.col("n").cast("bigint").alias("n"))
    numbers = materialize(numbers.distinct(), "chosen")
    n = F.col(f"`{number}`")
    blocks = numbers.select(F.shiftright("n", BLOCK.bit_length() - 1)).distinct()
    if blocks.limit(MAX_BLOCKS + 1).count() > MAX_BLOCKS:
        found = rows.join(numbers.hint("merge").select(F.col("n").alias("_n")), n == F.col("_n"), "left")
        return found.select(*own, F.col("_n").isNotNull().alias(name))
    bitmap = materialize(_bitmap(numbers), "bitmap").withColumnRenamed("_block", "_b")
    found = rows.join(F.broadcast(bitmap), F.shiftright(n, BLOCK.bit_length() - 1) == F.col("_b"), "left")
    word = F.get("_words", F.shiftright(n, 6).bitwiseAND(F.lit(BLOCK // 64 - 1)).cast("int"))
    is_set = F.getbit(word, n.bitwiseAND(F.lit(63)).cast("int")) == 1
    return found.select(*own, F.coalesce(is_set, F.lit(False)).alias(name))
