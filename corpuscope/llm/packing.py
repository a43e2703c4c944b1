"""Packing documents into training sequences by lexical retrieval.

Whole windows are cut from a document as they are; what is left over, less than one window per
document, is packed: a seed document is completed by the unused documents that a BM25 index ranks
highest for the seed's rarest terms, and the last of them is cut where the window is full. The index
is sharded: documents are ordered by a sketch of their content, so that similar ones lie in the same
range, and every range is worked through in shards of a fixed number of documents. What a shard
leaves unfinished moves on to the next, so one window per range is short at most.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.bpe import batch_encoder, forget
from corpuscope.llm.textarrays import chunks, giving_back, mix
from corpuscope.session import materialize

WINDOW = 1024
#: Documents in one shard of the index, and terms of a seed that are looked up.
SHARD = 4096
QUERY_TERMS = 16
K1, B = 1.2, 0.75

_PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
_SCHEMA = pa.schema(
    [("doc_id", pa.int64())]
    + [(n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sketch")]
    + [("ids", pa.binary())]
)


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


def _sketch(ids: np.ndarray) -> int:
    """The smallest hash of two neighbouring tokens: equal for two documents as often as they are alike."""
    if len(ids) < 2:
        return -1
    pairs = ids[:-1].astype(np.uint64) << np.uint64(32) | ids[1:].astype(np.uint64)
    return int(mix(pairs).min() >> np.uint64(1))


def _cutter(path: str, window: int, end_id: int, with_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = batch_encoder("file", path)
        for batch in batches:
            for part in chunks(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids, bounds = encoder(texts)
                ids = ids.astype("<u4")
                rows = []
                for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
                    own = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end_id)).astype("<u4")
                    whole = len(own) // window * window
                    for s in range(0, whole, window):
                        x = own[s : s + window]
                        rows.append((doc_id, s, window, _crc(x), len(own), None, x.tobytes() if with_ids else None))
                    if whole < len(own):
                        x = own[whole:]
                        rows.append((doc_id, whole, len(x), None, len(own), _sketch(x), _small(x)))
                columns = zip(*rows) if rows else [[] for _ in _SCHEMA]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)

    return cut


def _small(ids: np.ndarray) -> bytes:
    """Ids in two bytes each where they fit: a first byte tells the width."""
    if len(ids) and ids.max() > 0xFFFF:
        return b"\4" + ids.astype("<u4").tobytes()
    return b"\2" + ids.astype("<u2").tobytes()


def _unsmall(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype="<u4" if data[:1] == b"\4" else "<u2", offset=1)


class Shard:
    """A BM25 index over the leftover pieces of some documents."""

    def __init__(self, pieces: list[np.ndarray]):
        n = len(pieces)
        sizes = np.array([len(p) for p in pieces])
        entries = np.concatenate(pieces).astype(np.int64) if n else np.zeros(0, np.int64)
        entries <<= 20
        entries |= np.repeat(np.arange(n), sizes)
        entries, tf = np.unique(entries, return_counts=True)
        self.doc = (entries & 0xFFFFF).astype(np.int32)
        entries >>= 20
        # Equal terms stand together. In place, for two shards at a time are most of what an executor holds.
        self.first = np.flatnonzero(np.append(True, entries[1:] != entries[:-1])[: len(entries)])
        self.terms = entries[self.first]
        self.df = np.diff(np.append(self.first, len(entries)))
        self.idf = np.log(1 + (n - self.df + 0.5) / (self.df + 0.5))
        norm = K1 * (1 - B + B * sizes / max(sizes.mean(), 1)) if n else sizes.astype(float)
        self.weight = np.repeat(self.idf, self.df)
        self.weight *= tf
        self.weight *= K1 + 1
        below = norm[self.doc]
        below += tf
        self.weight /= below
        self.n = n

    def scores(self, piece: np.ndarray) -> np.ndarray:
        """BM25 of every document for the rarest terms of ``piece`` that other documents have."""
        at = np.searchsorted(self.terms, np.unique(piece))
        at = at[self.df[at] > 1]
        at = at[np.argsort(self.df[at], kind="stable")[:QUERY_TERMS]]
        if not len(at):
            return np.zeros(self.n)
        where = np.concatenate([np.arange(self.first[a], self.first[a] + self.df[a]) for a in at])
        return np.bincount(self.doc[where], weights=self.weight[where], minlength=self.n)


def pack_shard(docs: list[tuple], pieces: list[np.ndarray], window: int) -> Iterator[list[tuple]]:
    """Windows of ``(document row, begin, end)``: each begins with the first unused document and goes
    on with its neighbours by falling score, ties in the given order. The last may be short."""
    index, n = Shard(pieces), len(pieces)
    begin = np.zeros(n, dtype=np.int64)
    left = np.array([len(p) for p in pieces], dtype=np.int64)
    seed = 0
    while True:
        while seed < n and not left[seed]:
            seed += 1
        if seed == n:
            return
        room, out = window, []
        order: Iterator[int] = iter((seed,))
        if left[seed] < window:
            score = index.scores(pieces[seed])
            score[left == 0] = 0
            score[seed] = 0
            best = np.flatnonzero(score > 0)
            if len(best) > 64:  # a first try; the rest follows below when needed
                best = best[np.argpartition(-score[best], 63)[:64]]
            best = best[np.lexsort((best, -score[best]))]
            order = iter([seed, *best.tolist(), *_rest(score, best, left, seed)]) if left[best].sum() + left[seed] < window else iter([seed, *best.tolist()])
        for d in order:
            take = int(min(left[d], room))
            if take:
                out.append((d, int(begin[d]), int(begin[d]) + take))
                begin[d] += take
                left[d] -= take
                room -= take
            if not room:
                break
        yield out


def _rest(score: np.ndarray, best: np.ndarray, left: np.ndarray, seed: int) -> list[int]:
    """All other unused documents, by falling score."""
    other = left > 0
    other[best] = False
    other[seed] = False
    other = np.flatnonzero(other)
    return other[np.lexsort((other, -score[other]))].tolist()


def _packer(window: int, shard: int, with_ids: bool):
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "window", "offset")] + [("ids", pa.binary())])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [[] for _ in schema]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        docs: list[tuple] = []
        pieces: list[np.ndarray] = []
        number = 0

        def run(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal docs, pieces, number
            rows, over = [], []
            for parts in pack_shard(docs, pieces, window):
                if not last and sum(e - s for _, s, e in parts) < window:
                    over = parts
                    continue
                offset = 0
                for d, s, e in parts:
                    doc_id, start, n = docs[d]
                    x = pieces[d][s:e].astype("<u4")
                    rows.append((doc_id, start + s, e - s, _crc(x), n, number, offset, x.tobytes() if with_ids else None))
                    offset += e - s
                number += 1
            docs, pieces = [(docs[d][0], docs[d][1] + s, docs[d][2]) for d, s, _ in over], [pieces[d][s:e] for d, s, e in over]
            yield batch_of(rows)

        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("doc_id", "start", "doc_tokens", "ids")]
            for doc_id, start, n, ids in zip(*columns):
                docs.append((doc_id, start, n))
                pieces.append(_unsmall(ids))
                if len(docs) >= shard:
                    yield from run(False)
        if docs:
            yield from run(True)

    return pack


def pack(
    docs: DataFrame,
    tokenizer: str,
    window: int = WINDOW,
    end_id: int = 0,
    shard: int = SHARD,
    with_ids: bool = True,
) -> DataFrame:
    """Pieces of documents in sequences of at most ``window`` tokens.

    ``docs`` needs ``doc_id`` and ``text``; ``tokenizer`` is a file of the tokenizers library. Each
    document is its ids and ``end_id``. Per piece: ``doc_id``, ``start`` (ids of the document before
    it), ``length``, ``ids_crc32`` (of the ids as little-endian 32-bit), ``doc_tokens``,
    ``sequence_id``, ``offset`` in the sequence and, with ``with_ids``, the ids as ``ids`` (32-bit
    little-endian). A null text is empty and still has its end; repeated rows are packed each, a null
    ``doc_id`` stays null; an empty table gives no rows. Ties go by the order of the shard."""
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut = source.mapInArrow(giving_back(_cutter(tokenizer, window, end_id, with_ids)), _PIECES + ", sketch bigint, ids binary")
    cut = materialize(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    ids = ["ids"] if with_ids else []
    whole = cut.where("sketch IS NULL").withColumns({"sequence_id": F.col("row") * 2, "offset": F.lit(0).cast("bigint")})
    left = cut.where("sketch IS NOT NULL").repartitionByRange("sketch", "row").sortWithinPartitions("sketch", "row")
    packed = left.mapInArrow(giving_back(_packer(window, shard, with_ids)), _PIECES + ", window bigint, offset bigint, ids binary")
    # Windows count up within a partition, whose number makes them unique.
    packed = packed.withColumn(
        "sequence_id", (F.shiftleft(F.spark_partition_id().cast("bigint"), 33) + F.col("window")) * 2 + 1
    )
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *ids]
    return whole.select(columns).unionByName(packed.select(columns))
