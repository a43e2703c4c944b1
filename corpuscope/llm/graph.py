"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.session import materialize


#: So many edges at most are worked on in one partition, where Spark needs no shuffle.
FEW = 1 << 14


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the undirected ``edges`` (``a``, ``b``): the smallest node
    that can be reached from it.

    Alternates two steps, each a grouping and a join: link every neighbour that is larger than a
    node to the node's smallest neighbour, then the smaller ones. The edges end up as stars around
    the roots after a number of rounds that grows with the logarithm of the longest path. No
    neighbourhood is ever collected. Without edges: no rows. Loops and repeated edges don't matter.
    Every shuffle costs the driver a thread that stays for a minute; once there are few edges, which is
    all that a small table has, the rounds do without."""
    e = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e = materialize(e, "edges")
    mark = _mark(e)
    while mark[0]:
        e = e.coalesce(1) if mark[0] <= FEW else e
        both = e.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b")
        large = large.where("a <> b").distinct()
        small_least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(small_least, "b").select(
            F.inline(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b").alias("b"))))
        )
        e = materialize(small.where("a <> b").distinct(), "edges")
        now = _mark(e)
        if now == mark:
            break
        mark = now
    roots = e.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node"))
    return e.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(roots)
