"""Word lists: one entry per line, order kept."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.functions import text as T


def lexicon_entries(df: DataFrame, list_col: str, text_col: str) -> DataFrame:
    """``(list, ord, entry, n_words)`` from one text per list: stripped lines without blanks and
    repeats, in the order of their first appearance."""
    entries = F.array_distinct(T.lines(text_col))
    rows = df.select(F.col(list_col).alias("list"), F.posexplode(entries).alias("ord", "entry"))
    return rows.select("list", "ord", "entry", F.size(T.tokens("entry")).alias("n_words"))


def read_lexicons(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """The named files as one frame of entries. A path that stands for several files is one list, in
    the order of the files' paths."""
    parts = [
        spark.read.text(path, wholetext=True).select(
            F.lit(name).alias("name"), F.col("_metadata.file_path").alias("path"), "value"
        )
        for name, path in paths.items()
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    files = F.array_sort(F.collect_list(F.struct("path", "value")))
    joined = F.array_join(F.transform(files, lambda f: f["value"]), "\n")
    return lexicon_entries(whole.groupBy("name").agg(joined.alias("value")), "name", "value")


def load_lexicons(spark: SparkSession, paths: Mapping[str, str]) -> dict[str, tuple[str, ...]]:
    """The lists on the driver. Lists are configuration, written by hand; what they cost grows with
    their own length only."""
    out: dict[str, list[tuple[int, str]]] = {name: [] for name in paths}
    for r in read_lexicons(spark, paths).collect():
        out[r["list"]].append((r["ord"], r["entry"]))
    return {name: tuple(e for _, e in sorted(rows)) for name, rows in out.items()}


def load_lexicon(spark: SparkSession, path: str) -> tuple[str, ...]:
    return load_lexicons(spark, {"list": path})["list"]
