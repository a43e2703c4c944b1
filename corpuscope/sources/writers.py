"""Sinks. All of them replace what was there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


#: Quotes are doubled, as other readers expect; an empty cell is quoted and a null is not. Cells keep
#: their blanks and line ends.
_CSV = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "emptyValue": '""',
    "nullValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}

_EMPTY = "\0"


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**_CSV).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What ``write_csv`` wrote, cells of several lines included. Spark's reader takes an empty cell for
    a null where both are written alike, so empty cells get a mark first."""
    df = spark.read.schema(schema).options(**{**_CSV, "emptyValue": _EMPTY, "multiLine": "true"}).csv(path)
    texts = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    return df.withColumns({c: F.when(F.col(c) == _EMPTY, F.lit("")).otherwise(F.col(c)) for c in texts})


def write_json_lines(df: DataFrame, path: str) -> None:
    """One object per row; nulls are written out."""
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def write_json_report(df: DataFrame, path: str, pretty: bool = True) -> None:
    """Each row as one JSON document, meant for frames of a row or a few."""
    options = {"pretty": str(pretty).lower(), "ignoreNullFields": "false"}
    df.select(F.to_json(F.struct("*"), options)).write.mode("overwrite").text(path)
