"""Occurrences of phrases from a list that is a table, for lists of any length.

The list never becomes part of the plan. It is kept as an inverted lexicon: one row per first word
with the lengths of the phrases that begin with it. Words of documents meet that table by equality,
and only the positions that pass are put together to phrases. A bitmap of the list's hashes, of bounded
size and broadcast, tells which of these may be in the list; they alone are looked up in it. While a
table is small Spark broadcasts it, after looking at its size; beyond that both sides are shuffled, and
as the list's side has one row per key, a frequent word may be cut into any number of tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.functions import text as T
from corpuscope.functions.rows import bind
from corpuscope.session import materialize


#: Bits of a bitmap: so many per phrase, which lets one in sixteen others pass, and at most 2^27 (16 MB).
#: They lie in blocks of 512 numbers of 64 bits.
BITS_PER_PHRASE, MAX_BITS = 16, 1 << 27
_BLOCK = 512


class PhraseLexicon(NamedTuple):
    """``phrases(phrase)``, ``firsts(first, lengths)``, the number of words of the longest phrase, and
    ``bitmap(block, words)`` of the hashes of phrases, with its number of bits."""

    phrases: DataFrame
    firsts: DataFrame
    longest: int
    bitmap: DataFrame
    bits: int


def _slot(phrase: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(phrase), F.lit(bits))


def _bit(slot: Column) -> Column:
    return slot.bitwiseAND(F.lit(63)).cast("int")


def _bitmap(phrases: DataFrame, bits: int) -> DataFrame:
    """``(block, words)``: the blocks in which a bit is set."""
    slots = phrases.select(_slot("phrase", bits).alias("slot"))
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), _bit(F.col("slot")))
    word = F.shiftright("slot", 6)
    set_words = slots.groupBy(word.alias("word")).agg(F.bit_or(mask).alias("mask"))
    entry = F.struct((F.col("word") % _BLOCK).cast("int").alias("at"), "mask")
    blocks = set_words.groupBy(F.floor(F.col("word") / _BLOCK).alias("block")).agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
    every = F.sequence(F.lit(0), F.lit(_BLOCK - 1))
    return blocks.select("block", F.transform(every, lambda i: F.coalesce(F.col("m")[i], F.lit(0).cast("bigint"))).alias("words"))


def _perhaps_listed(found: DataFrame, lexicon: PhraseLexicon) -> DataFrame:
    """Rows of ``found`` without those whose ``phrase`` is certainly not listed."""
    placed = found.withColumn("_slot", _slot("phrase", lexicon.bits))
    block = F.floor(F.col("_slot") / (64 * _BLOCK))
    word = F.get("words", (F.shiftright("_slot", 6) % _BLOCK).cast("int"))
    is_set = F.call_function("shiftright", word, _bit(F.col("_slot"))).bitwiseAND(F.lit(1)) == 1
    return placed.join(F.broadcast(lexicon.bitmap), (block == F.col("block")) & is_set).select(found.columns)


def phrase_lexicon(entries: DataFrame, column: str) -> PhraseLexicon:
    """The inverted lexicon of a column of entries, inner whitespace collapsed; nulls, blank entries
    and repeats do not matter. Both tables are written: a join with an aggregate on its own key would
    share the aggregate's shuffle, which Spark then does not cut."""
    words = bind(entries.select(column), _w=T.tokens(column)).select("_w").filter(F.size("_w") > 0)
    listed = words.select(
        F.array_join("_w", " ").alias("phrase"), F.get("_w", F.lit(0)).alias("first"), F.size("_w").alias("n")
    )
    listed = materialize(listed.distinct(), "phrases")
    lengths = F.sort_array(F.collect_set("n")).alias("lengths")
    firsts = materialize(listed.groupBy("first").agg(lengths), "first-words")
    longest, n = listed.agg(F.coalesce(F.max("n"), F.lit(1)), F.count(F.lit(1))).first()
    bits = min(MAX_BITS, 1 << max(16, (BITS_PER_PHRASE * n).bit_length()))
    phrases = listed.select("phrase")
    return PhraseLexicon(phrases, firsts, longest, materialize(_bitmap(phrases, bits), "bitmap"), bits)


def phrase_occurrences(
    docs: DataFrame, lexicon: PhraseLexicon, key_cols: Sequence[str], text_col: str = "text"
) -> DataFrame:
    """``key_cols`` and ``start, n, phrase`` of every occurrence, overlapping ones included, as in
    ``gender.with_phrase_hits``. A null or empty text has none; repeated rows give theirs each.

    A position carries the words up to the length of the longest phrase, never the text."""
    keys = [F.col(c) for c in key_cols]
    cut = bind(docs.select(*keys, text_col), _k=T.normalized_tokens(text_col))

    def position(word: Column, i: Column) -> Column:
        ahead = F.slice("_k", i + 1, lexicon.longest)
        return F.struct(i.alias("start"), word.alias("first"), ahead.alias("_ahead"))

    words = cut.select(*keys, F.inline(F.transform("_k", position)))
    starts = words.join(lexicon.firsts, "first")
    options = starts.select(*keys, "start", "_ahead", F.explode("lengths").alias("n"))
    options = options.filter(F.size("_ahead") >= F.col("n"))
    found = options.select(*keys, "start", "n", F.array_join(F.slice("_ahead", 1, F.col("n")), " ").alias("phrase"))
    # Fenced, or Spark would look up all of them before it asks the bitmap.
    found = bind(_perhaps_listed(found, lexicon), phrase=F.col("phrase"))
    return found.join(lexicon.phrases, "phrase", "left_semi").select(*keys, "start", "n", "phrase")
