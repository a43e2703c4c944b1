"""Token ids as files of equal-length sequences.

The ids of all documents, one after the other by ascending ``doc_id``, are cut into sequences of one
length and written in Arrow's file format: record batches of two fixed-size lists, ``ids`` and
``mask`` (a bit: true for an id, false for the padding after the last one of a file), uncompressed. A batch has a
fixed number of sequences, so the place of sequence ``i`` follows from ``i`` alone, and a reader that
maps a file into memory gets any sequence without a copy.

Spark sorts the documents into ranges; every task writes one file and hands back one index row per
document: file, position in it, number of ids. A file's name is new with every attempt and only
committed index rows name files, so what a lost or repeated attempt has written is never read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.bpe import batch_encoder
from corpuscope.llm.textarrays import chunks
from corpuscope.session import materialize

LENGTH = 2048
#: Sequences in a record batch.
ROWS = 64

_INDEX = "doc_id bigint, shard int, file string, position bigint, n_tokens bigint"


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path that every executor can reach, and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def id_type(largest: int) -> pa.DataType:
    return pa.uint16() if largest <= 0xFFFF else pa.uint32()


def file_schema(kind: pa.DataType, length: int) -> pa.Schema:
    item = lambda t: pa.list_(pa.field("item", t, nullable=False), length)
    return pa.schema([pa.field("ids", item(kind), nullable=False), pa.field("mask", item(pa.bool_()), nullable=False)])


class SequenceWriter:
    """Writes ids into one file; holds one record batch at most."""

    def __init__(self, place: fs.FileSystem, path: str, kind: pa.DataType, length: int = LENGTH, rows: int = ROWS):
        self.schema, self.length = file_schema(kind, length), length
        self.out = place.open_output_stream(path)
        self.file = pa.ipc.new_file(self.out, self.schema)
        self.held = np.zeros(rows * length, dtype=kind.to_pandas_dtype())
        self.filled, self.written = 0, 0

    def add(self, ids: np.ndarray) -> int:
        """Appends ids; returns their position."""
        at = self.written + self.filled
        while len(ids):
            take = min(len(ids), len(self.held) - self.filled)
            self.held[self.filled : self.filled + take] = ids[:take]
            self.filled += take
            ids = ids[take:]
            if self.filled == len(self.held):
                self._flush()
        return at

    def _flush(self) -> None:
        n = -(-self.filled // self.length)
        self.held[self.filled : n * self.length] = 0
        mask = np.arange(n * self.length) < self.filled
        columns = [self.held[: n * self.length], mask]
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(v), type=f.type) for v, f in zip(columns, self.schema)]
        self.file.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))
        self.written += self.filled
        self.filled = 0

    def close(self) -> None:
        if self.filled:
            self._flush()
        self.file.close()
        self.out.close()


class SequenceFile:
    """Random access to a file of sequences; local files are mapped into memory."""

    def __init__(self, path: str):
        place, inner = store(path)
        self.source = pa.memory_map(inner) if isinstance(place, fs.LocalFileSystem) else place.open_input_file(inner)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 0

    def __enter__(self) -> SequenceFile:
        return self

    def __exit__(self, *_) -> None:
        self.source.close()

    def __len__(self) -> int:
        last = self.file.num_record_batches - 1
        return last * self.rows + self.file.get_batch(last).num_rows if last >= 0 else 0

    def _slice(self, batch: int, at: int, n: int) -> tuple[np.ndarray, pa.BooleanArray]:
        ids, mask = (c.values.slice(at, n) for c in self.file.get_batch(batch).columns)
        return ids.to_numpy(zero_copy_only=True), mask

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of a sequence, as views of the file."""
        b, r = divmod(i, self.rows)
        return self._slice(b, r * self.length, self.length)

    def tokens(self, position: int, n: int) -> Iterator[np.ndarray]:
        """The ``n`` ids from a position on, as views, batch by batch."""
        per = self.rows * self.length
        while n:
            b, r = divmod(position, per)
            take = min(n, per - r)
            ids, mask = self._slice(b, r, take)
            if mask.true_count < take:
                raise ValueError("padding inside a document")
            yield ids
            position, n = position + take, n - take


def write_sequences(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, length: int = LENGTH, rows: int = ROWS, ids: int = 1 << 16
) -> DataFrame:
    """Writes the ids of all documents below ``path`` and returns the index: ``doc_id``, ``shard`` (files
    in order), ``file``, ``position`` of the document in its file and ``n_tokens``, with its end.

    ``docs`` needs ``doc_id`` and ``text``, other columns are ignored; ``tokenizer`` is a file of the
    tokenizers library that lower-cases and marks word ends; no special tokens are added but
    ``end_id`` after each document; ``ids`` is more than the largest id. ``path`` must be one that all
    executors share.

    A null or empty text has its end only. A null ``doc_id`` comes first; rows of one ``doc_id`` go by
    a hash of their text, equal rows in any order, and each is written. A text of any length is
    encoded in blocks. An empty table gives no rows and no files."""
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The row number only splits rows that are alike, so that no range need hold them all.
    source = source.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = ["doc_id", "tie", "row"]
    kind = id_type(ids - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = batch_encoder("words", tokenizer)
        place, folder = store(path)
        shard, writer, name = TaskContext.get().partitionId(), None, ""
        for batch in batches:
            for part in chunks(batch, "text"):
                if writer is None:
                    name = f"shard-{shard:06d}-{uuid.uuid4().hex}.arrow"
                    place.create_dir(folder, recursive=True)
                    writer = SequenceWriter(place, f"{folder}/{name}", kind, length, rows)
                values, bounds = encoder([t or "" for t in part.column("text").to_pylist()])
                at, sizes = [], np.diff(bounds) + 1
                for s, e in zip(bounds[:-1], bounds[1:]):
                    at.append(writer.add(values[s:e]))
                    writer.add(np.array([end_id]))
                n = part.num_rows
                columns = [part.column("doc_id"), pa.array([shard] * n, pa.int32()), pa.array([f"{path}/{name}"] * n)]
                columns += [pa.array(at, pa.int64()), pa.array(sizes, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "shard", "file", "position", "n_tokens"])
        if writer is not None:
            writer.close()

    ranged = source.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return materialize(ranged.mapInArrow(run, _INDEX), "sequence-index")


def read_documents(index: DataFrame) -> DataFrame:
    """``index`` with ``start``, the ids of all documents before it, and ``ids_crc32`` of the document's
    ids as little-endian 32-bit numbers, read from the files. The totals of the files, of which there
    are as many as there were tasks, pass through the driver; an empty index gives no rows."""
    spark = index.sparkSession
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()
    starts, before = [], 0
    for r in sorted(totals):
        starts.append((r.shard, before))
        before += r.n
    offsets = F.broadcast(spark.createDataFrame(starts, "shard int, offset bigint"))
    names = [*index.columns, "ids_crc32"]
    schema = ", ".join(f"`{n}` {t}" for n, t in index.dtypes) + ", ids_crc32 bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, opened = None, None
        for batch in batches:
            out = []
            for file, position, n in zip(*(batch.column(c).to_pylist() for c in ("file", "position", "n_tokens"))):
                if file != name:
                    if opened is not None:
                        opened.source.close()
                    name, opened = file, SequenceFile(file)
                crc = 0
                for ids in opened.tokens(position, n):
                    crc = zlib.crc32(ids.astype("<u4"), crc)
                out.append(crc)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names)
        if opened is not None:
            opened.source.close()

    read = index.mapInArrow(run, schema)
    return read.join(offsets, "shard").withColumn("start", F.col("offset") + F.col("position")).drop("offset")
