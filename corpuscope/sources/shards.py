"""Plain-text shards in which blank lines separate documents."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscope.functions import text as T
from corpuscope.functions.profiles import ScriptProfile
from corpuscope.operators.docstats import with_doc_stats
from corpuscope.operators.domain import UNKNOWN
from corpuscope.session import materialize

Paths = str | Sequence[str]


def _listed(paths: Paths) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def check_script(spark: SparkSession, paths: Paths, profile: ScriptProfile, n: int = 200) -> int:
    """How many of the first ``n`` lines hold the primary script; none at all is an error.

    The lines come from the first splits, as many as it takes; no other split is opened."""
    found = F.col("value").rlike(profile.primary_class)
    hits = sum(bool(r[0]) for r in spark.read.text(_listed(paths)).select(found).take(n))
    if not hits:
        raise ValueError(f"no {profile.name} character in the first {n} lines: wrong encoding?")
    return hits


# What a split yields: the piece that may go on from the split before, a split that is one piece open
# at both ends, the piece that may go on in the next split, and whole documents. The first three
# numbers also are their order.
HEAD, THROUGH, TAIL, WHOLE = range(4)
_PIECES = "file string, block bigint, seq int, kind int, lines string, n int"


class _Split:
    """The pieces of one split, fed line by line array."""

    def __init__(self, file: str, block: int):
        self.file, self.block, self.seq, self.at_start = file, block, 0, True
        self.open: list[tuple[str, int]] = []
        self.rows: list[tuple] = []

    def _close(self, kind: int) -> None:
        n = sum(n for _, n in self.open)
        self.rows.append((self.file, self.block, self.seq, kind, "\n".join(t for t, _ in self.open), n))
        # Documents that begin here are numbered; a head does so at the beginning of its file only.
        self.seq += kind in (WHOLE, TAIL) or (self.block == 0 and n > 0)
        self.open = []

    def _end_piece(self) -> None:
        if self.at_start:
            self._close(HEAD)
            self.at_start = False
        elif self.open:
            self._close(WHOLE)

    def feed(self, lines: pa.Array) -> None:
        blank = pc.equal(lines, "").to_numpy(zero_copy_only=False)
        solid = np.flatnonzero(~blank)
        if not len(solid):
            self._end_piece()
            return
        first = np.flatnonzero(np.append(True, np.diff(solid) > 1))
        bounds = np.append(first, len(solid))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), lines.take(pa.array(solid))), "\n")
        if solid[0] > 0:
            self._end_piece()
        for i, (text, n) in enumerate(zip(joined.to_pylist(), np.diff(bounds).tolist())):
            if i:
                self._end_piece()
            self.open.append((text, n))
        if blank[-1]:
            self._end_piece()

    def end(self) -> list[tuple]:
        self._close(THROUGH if self.at_start else TAIL)
        return self.taken()

    def taken(self) -> list[tuple]:
        out, self.rows = self.rows, []
        return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the splits whose lines come one after the other."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32())
        columns = zip(*rows) if rows else [[]] * len(kinds)
        names = ["file", "block", "seq", "kind", "lines", "n"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    split: _Split | None = None
    for batch in batches:
        files, blocks, lines = batch.columns
        keys = list(zip(files.to_pylist(), blocks.to_pylist()))
        cuts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
        rows: list[tuple] = []
        for i, j in zip(cuts, [*cuts[1:], len(keys)]):
            if split is None or (split.file, split.block) != keys[i]:
                rows += split.end() if split else []
                split = _Split(*keys[i])
            split.feed(lines.slice(i, j - i))
            rows += split.taken()
        yield batch_of(rows)
    if split:
        yield batch_of(split.end())


def _stitched(pieces: DataFrame) -> DataFrame:
    """Documents put together from the open ends of neighbouring splits: a tail, the splits that are
    one piece, and the head that follows. Of a split two short rows come here at most, or one that is
    part of a document longer than the split."""
    ends = pieces.where("whole = 0")
    order = Window.partitionBy("file").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, 0)
    runs = ends.withColumn("run", F.sum((F.col("kind") == TAIL).cast("int")).over(order))
    part = F.struct("block", "kind", "lines", "n", "seq")
    whole = runs.groupBy("file", "run").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.sum("n").cast("int").alias("n"))
    solid = F.filter("parts", lambda p: p["n"] > 0)
    first = F.get("parts", F.lit(0))
    return whole.where("n > 0").select(
        "file",
        first["block"].alias("block"),
        first["seq"].alias("seq"),
        F.array_join(F.transform(solid, lambda p: p["lines"]), "\n").alias("lines"),
        "n",
    )


def _numbered(docs: DataFrame) -> DataFrame:
    """Adds ``row_key``: the file and the number of the document in it, whatever the splits were.

    The documents that begin in each split are counted first; three numbers per split are broadcast,
    which is some 24 bytes for every split of the input."""
    begun = docs.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = begun.select(
        F.xxhash64("file").alias("_f"), F.col("block").alias("_b"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("_base")
    )
    keyed = docs.join(F.broadcast(base), (F.xxhash64("file") == F.col("_f")) & (F.col("block") == F.col("_b")))
    return keyed.withColumn("row_key", F.concat_ws("#", "file", (F.col("_base") + F.col("seq")).cast("string")))


def read_documents(
    spark: SparkSession, paths: Paths, with_file: bool = False, with_key: bool = False
) -> DataFrame:
    """``(text, sentence_count)`` per document, with ``source_file`` and ``row_key`` on request.

    Blank lines, of whatever white space and with whatever line end, separate documents. Lines are
    read split by split and documents cut where they lie; only the open ends of splits travel, to be
    joined to their other half. So a file of any size is read by many tasks, and a document is never
    cut where a split ends.

    The files are read once: what they are cut into is written, open ends apart from whole documents,
    and documents, their stitching and their numbers all come from that table. A job runs to write it."""
    raw = spark.read.text(_listed(paths)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), T.strip("value").alias("line")
    )
    cut = raw.mapInArrow(_cut, _PIECES).withColumn("whole", (F.col("kind") == WHOLE).cast("int"))
    pieces = materialize(cut, "pieces", partition_by="whole")
    columns = ["file", "block", "seq", "lines", "n"]
    # The head of a split that begins with a blank line is empty and counts for nothing.
    docs = pieces.where("whole = 1").select(columns).unionByName(_stitched(pieces).select(columns))
    if with_key:
        docs = _numbered(docs)
    return docs.select(
        *[F.col("file").alias("source_file")] * with_file,
        *["row_key"] * with_key,
        F.replace("lines", F.lit("\n"), F.lit(" ")).alias("text"),
        F.col("n").alias("sentence_count"),
    )


def parse_documents(
    spark: SparkSession,
    paths: Paths,
    profile: ScriptProfile,
    with_id: bool = False,
    with_key: bool = False,
) -> DataFrame:
    """The parsed corpus: text, counts, hash and the label ``unknown``.

    ``doc_id`` is the content hash, so exact copies share it. ``with_id`` adds Spark's row number
    ``id``, which is unique but changes with the layout, ``with_key`` the ``row_key`` of a document,
    which does not. The mixing rate is rounded to 4 places."""
    docs = read_documents(spark, paths, with_key=with_key)
    stats = with_doc_stats(docs, profile, line_count_col=F.col("sentence_count"))
    parsed = stats.select(
        F.col("sha256").alias("doc_id"),
        "text",
        "sentence_count",
        "token_count",
        "char_count",
        "primary_token_count",
        "latin_token_count",
        F.bround("mix_rate", 4).alias("mix_rate"),
        "sha256",
        F.lit(UNKNOWN).alias("predicted_domain"),
        *["row_key"] * with_key,
    )
    return parsed.withColumn("id", F.monotonically_increasing_id()) if with_id else parsed
