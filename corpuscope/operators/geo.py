"""How often places are mentioned, per place and label."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.functions import text as T

ALL = "ALL"

_REGEX_SPECIAL = set("\\^$.|?*+()[]{}")


def _literal_pattern(word: str) -> str:
    return "".join("\\" + c if c in _REGEX_SPECIAL else c for c in word)


def place_pattern(spellings: Sequence[str]) -> str:
    """Alternation in list order: where two spellings start together the earlier one matches."""
    return "|".join(_literal_pattern(s) for s in spellings)


def mention_count(
    text: Column | str, spellings: Sequence[str], present: Column | None = None
) -> Column:
    """Non-overlapping mentions. Most texts name no place at all; a byte search settles those,
    unless the caller knows already which texts name one."""
    col = F.col(text) if isinstance(text, str) else text
    some = T.contains_any(col, spellings) if present is None else present
    counted = F.regexp_count(col, F.lit(place_pattern(spellings)))
    return F.when(some, counted).otherwise(F.lit(0))


def with_place_counts(
    df: DataFrame,
    places: Mapping[str, Sequence[str]],
    text_col: str = "text",
    present: Mapping[str, str] | None = None,
) -> DataFrame:
    """Adds ``place_counts``, an array in the order of ``places``. ``present`` names, per place, a
    boolean column that is true where one of its spellings occurs."""
    counts = [
        mention_count(text_col, s, F.col(present[p]) if present else None)
        for p, s in places.items()
    ]
    return df.withColumn("place_counts", F.array(*counts))


def place_mentions(
    df: DataFrame, places: Sequence[str], label_col: str = "predicted_domain"
) -> DataFrame:
    """``(place, domain, total_mentions)`` with a row per label and one labelled ``ALL``.

    All places are summed side by side in one aggregate per label; turning the few sums into rows
    and adding the totals then works on labels x places rows."""
    sums = [
        F.sum(F.get("place_counts", F.lit(i))).cast("bigint").alias(f"p{i}")
        for i in range(len(places))
    ]
    wide = df.groupBy(label_col).agg(*sums)
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(p).alias("place"), F.col(f"p{i}").alias("m"))
                for i, p in enumerate(places)
            ]
        )
    )
    long = wide.select(F.col(label_col).alias("_label"), pairs.alias("x")).select(
        "_label", "x.place", "x.m"
    )
    rolled = long.groupingSets(
        [["place", "_label"], ["place"]], "place", "_label"
    ).agg(F.sum("m").alias("total_mentions"), F.grouping("_label").alias("_all"))
    domain = F.when(F.col("_all") == 1, F.lit(ALL)).otherwise(F.col("_label"))
    return rolled.select("place", domain.alias("domain"), "total_mentions")


def place_share(mentions: DataFrame) -> DataFrame:
    """Places ranked by mentions over all labels, with their share in per cent."""
    overall = mentions.filter(F.col("domain") == ALL)
    # One row per place: the unpartitioned window is over configuration-sized data.
    total = F.sum("total_mentions").over(Window.partitionBy())
    shares = overall.select(
        "place",
        "total_mentions",
        (T.safe_ratio(F.col("total_mentions"), total) * 100).alias("share_pct"),
    )
    return shares.orderBy(F.desc("total_mentions"), F.asc("place"))
