"""Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(
    spark: SparkSession, path: str, columns: list[str] | None = None, spread_by: str | None = None
) -> DataFrame:
    """A Parquet table, optionally some columns of it.

    ``spread_by`` names a key by which to redistribute a table that comes in one piece, as one small
    file does. Any other table is left as it is, whatever the cluster."""
    df = spark.read.parquet(path)
    if columns:
        df = df.select(*columns)
    if spread_by and df.rdd.getNumPartitions() == 1:
        df = df.repartition(spark.sparkContext.defaultParallelism, spread_by)
    return df


def read_labels(table: DataFrame, wanted: DataFrame, label_col: str) -> DataFrame:
    """Rows of a table that lies in folders by ``label_col``, for the labels of another frame, once each.

    The labels are broadcast if Spark finds their frame small; with a filter on it, the folders to read
    are picked when it has been worked out. Rows without a label are never wanted."""
    return table.join(wanted.select(label_col), label_col, "left_semi")
