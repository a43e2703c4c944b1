"""Where intermediate tables live."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: dict = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local session, which has
    no other machine to share with, may do without; it gets one temporary folder, which goes when
    the driver ends."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if shared:
        return shared.rstrip("/")
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if _own.get("app") != sc.applicationId:
        _own.update(app=sc.applicationId, folder=tempfile.TemporaryDirectory(prefix="corpuscope-"))
    return f"file://{_own['folder'].name}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; nothing is ever overwritten there."""
    return f"{scratch_root(spark)}/corpuscope/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write once, read many times. Unlike a cached frame the result outlives lost executors, and
    it cuts the lineage; unlike a row checkpoint it can be read column by column and, with
    ``partition_by``, folder by folder."""
    path = scratch_path(df.sparkSession, name)
    writer = df.write
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
