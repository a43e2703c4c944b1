"""Terms as dense numbers, and documents as rows of them, without a list on the driver.

A dictionary is a table ``(term, term_id, document_frequency, term_count)`` in which the most frequent
term has the number 0, ties in the order of terms. Numbers come from a range sort and the sizes of its
ranges, so no task sees all terms; documents become sparse rows by a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.functions.rows import bind
from corpuscope.session import materialize

#: A dictionary of at most so many terms (some 20 MB) is broadcast to the documents.
BROADCAST_TERMS = 200_000
_LOCAL = (1 << 33) - 1


def dense_ids(df: DataFrame, *order, name: str) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, … by ``order``, which must tell all rows apart. The sizes of the
    ranges, one row per task, are summed up and broadcast."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # Spark's row number holds the range in its upper and the place in it in its lower bits.
    placed = materialize(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranged")
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    numbered = placed.join(F.broadcast(base), "_range")
    place = F.col("_at").bitwiseAND(F.lit(_LOCAL))
    return numbered.withColumn(name, F.col("_base") + place).drop("_range", "_at", "_base")


def dictionary(terms: DataFrame, size: int | None = None) -> DataFrame:
    """``terms`` (``term``, ``document_frequency``, ``term_count``) with ``term_id``; with ``size``, the
    first so many only. No terms: no rows."""
    numbered = dense_ids(terms, F.desc("term_count"), F.asc("term"), name="term_id")
    return numbered if size is None else numbered.where(F.col("term_id") < size)


def count_terms(tokens: DataFrame, *keys: str, tokens_col: str = "tokens") -> DataFrame:
    """``(keys, term, n)``: the distinct tokens of each row with their counts, worked out inside the row.
    In the sorted list a run begins where a token differs from the one before it and ends where the
    next one begins. A null or empty list gives no rows."""
    rows = bind(tokens.select(*keys, tokens_col), _sorted=F.sort_array(tokens_col))
    begins = F.transform(
        "_sorted",
        lambda t, i: F.when((i == 0) | (F.get("_sorted", i - 1) != t), F.struct(t.alias("term"), i.alias("at"))),
    )
    rows = bind(rows.drop(tokens_col), _runs=F.filter(begins, lambda r: r.isNotNull()))
    end = lambda j: F.coalesce(F.get("_runs", j + 1)["at"], F.size("_sorted"))
    runs = F.transform("_runs", lambda r, j: F.struct(r["term"].alias("term"), (end(j) - r["at"]).cast("bigint").alias("n")))
    return rows.select(*keys, F.inline(runs))


def term_rows(tokens: DataFrame, terms: DataFrame, *keys: str, tokens_col: str = "tokens") -> DataFrame:
    """``(keys, term_id, term, n)``: how often the terms of a dictionary occur in each row.

    A small dictionary is broadcast. A large one is shuffled with the counts, which hold a term once
    per row; Spark splits a term that a third of all rows have, since a dictionary has it once."""
    if terms.count() <= BROADCAST_TERMS:
        terms = F.broadcast(terms)
    counted = count_terms(tokens, *keys, tokens_col=tokens_col)
    return counted.join(terms.select("term", "term_id"), "term").select(*keys, "term_id", "term", "n")


def sparse_vectors(tokens: DataFrame, terms: DataFrame, *keys: str, tokens_col: str = "tokens") -> DataFrame:
    """``(keys, ids, counts)``: one row per input row that holds a term of the dictionary, its terms in
    the order of their numbers. The keys must tell rows apart."""
    entry = F.array_sort(F.collect_list(F.struct("term_id", "n")))
    rows = term_rows(tokens, terms, *keys, tokens_col=tokens_col).groupBy(*keys).agg(entry.alias("_e"))
    return rows.select(*keys, F.col("_e.term_id").alias("ids"), F.col("_e.n").alias("counts"))
