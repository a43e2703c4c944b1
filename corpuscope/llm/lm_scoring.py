"""Cross-entropy difference between two n-gram models.

A target model is trained on chosen texts and a background model on all; both are bigram models over
one vocabulary, smoothed alike. A document's score is the mean over its tokens of the loss under the
target minus the loss under the background: the lower, the more it is like the target.

The vocabulary holds every word and the models every pair of words, each under a hash of its own, so
they grow with the corpus and no machine holds them whole:

1. Documents are put into chunks of a bounded number of bytes, one row each.
2. Each chunk counts its words and pairs, once, for both models. Its keys are sorted and cut into
   ranges, so that they pack; a range has a row per chunk, and its counts are added up by key.
3. Each chunk gets back what the others have counted of its keys, in the order of its keys and so
   without them, and scores its documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from corpuscope.llm.textarrays import Words, chunks, give_back, giving_back, mix, split_words, text_buffer
from corpuscope.session import materialize

#: How many pairs the unigram model counts for in the bigram model.
PRIOR = 50.0
#: Bytes of text in a chunk, unless one text has more, and what a row counts for besides. A range of keys
#: has as many as the texts of some ``RANGE`` bytes.
CHUNK, ROW_BYTES, RANGE = 1 << 22, 64, 1 << 24
_MULTIPLIER, _MARK, _PAIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x243F6A8885A308D3), np.uint64(1)
_NEW = ("n_tokens", "target_loss", "background_loss", "score")
_PACKED = pa.ipc.IpcWriteOptions(compression="zstd")


class Sizes(NamedTuple):
    """Distinct words of both models, and words of the background's and of the target's texts."""

    distinct: int
    totals: tuple[int, int]


def word_keys(words: Words) -> np.ndarray:
    """Even keys of words: 63 bits of a hash."""
    return mix(words.hashes) & ~_PAIR


def heads_of(words: Words) -> np.ndarray:
    """Positions of the first words of texts."""
    return words.bounds[:-1][np.diff(words.bounds) > 0]


def pair_keys(words: Words) -> np.ndarray:
    """Per word the odd key of the pair with the word before it; a text begins after a mark."""
    before = np.empty_like(words.hashes)
    before[1:] = words.hashes[:-1]
    before[heads_of(words)] = _MARK
    return mix(before * _MULTIPLIER + words.hashes) | _PAIR


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per chunk: its number, the bytes of its texts, and its rows as a compressed table."""
    chunk, size, held = TaskContext.get().partitionId() << 32, 0, []

    def row() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=_PACKED) as out:
            for part in held:
                out.write_batch(part)
        columns = [pa.array([chunk]), pa.array([size]), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["chunk", "bytes", "rows"])

    for batch in batches:
        for part in chunks(batch, "text", CHUNK):
            more = int(text_buffer(part.column("text"))[1][-1]) + ROW_BYTES * part.num_rows
            if held and size + more > CHUNK:
                yield row()
                chunk, size, held = chunk + 1, 0, []
            held.append(part)
            size += more
    if held:
        yield row()


def _rows(data: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(data.as_buffer()).read_all().combine_chunks()


def _coded(x: np.ndarray) -> bytes:
    """Whole numbers, byte by byte of all of them, compressed: what small numbers lack takes no room."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _decoded(data: bytes, n: int) -> np.ndarray:
    planes = pa.decompress(data, decompressed_size=8 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, n).T).view("<u8")[:, 0]


def _counted(table: pa.Table) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """The words of a chunk, its sorted keys, the place of each word's and then each pair's key among
    them, and how often the background and the target have each key here, (2, keys)."""
    words = split_words(*text_buffer(table.column("text")))
    keys, which = np.unique(np.concatenate([word_keys(words), pair_keys(words)]), return_inverse=True)
    sizes = np.diff(words.bounds)
    models = [np.repeat(table.column(c).to_numpy().astype(float), sizes) for c in ("background", "target")]
    counts = [np.bincount(which, weights=np.concatenate([x, x]), minlength=len(keys)) for x in models]
    return words, keys, which, np.array(counts).astype(np.int64)


def _cuts(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range begins and ends among sorted keys."""
    inner = np.array([(i << 64) // ranges for i in range(1, ranges)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, inner), [len(keys)]]).astype(np.int64)


_COUNTS = "range bigint, chunk bigint, size bigint, keys binary, n binary, t binary"
_SUMS = "range bigint, chunk bigint, n binary, t binary, words bigint, all_n bigint, all_t bigint"


def _counter(ranges: int):
    """Rows per chunk and range of keys."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("rows")):
                _, keys, _, counts = _counted(_rows(data))
                cuts = _cuts(keys, ranges)
                out = []
                for i in np.flatnonzero(np.diff(cuts)).tolist():
                    part = slice(cuts[i], cuts[i + 1])
                    steps = np.diff(keys[part], prepend=np.uint64(0))
                    out.append((i, chunk, len(steps), _coded(steps), _coded(counts[0, part]), _coded(counts[1, part])))
                if out:
                    kinds = [pa.int64()] * 3 + [pa.binary()] * 3
                    columns = [pa.array(c, kind) for c, kind in zip(zip(*out), kinds)]
                    yield pa.RecordBatch.from_arrays(columns, ["range", "chunk", "size", "keys", "n", "t"])

    return count


def _summed(table: pa.Table) -> pa.Table:
    """Of one range, per chunk what the other chunks have counted of its keys. The first row also has
    the range's number of words and their sums."""
    table = table.combine_chunks()
    sizes = table.column("size").to_pylist()
    read = lambda c: (_decoded(x.as_py(), n) for x, n in zip(table.column(c), sizes))
    keys, which = np.unique(np.concatenate([np.cumsum(x) for x in read("keys")]), return_inverse=True)
    is_word, ends = keys & _PAIR == 0, np.cumsum(sizes)[:-1]
    totals, rest = [int(is_word.sum())], []
    for c in ("n", "t"):
        own = np.concatenate(list(read(c))).astype(np.int64)
        total = np.bincount(which, weights=own).astype(np.int64)
        totals.append(int(total[is_word].sum()))
        rest.append([_coded(x) for x in np.split(total[which] - own, ends)])
    give_back()
    totals = [[x] + [0] * (len(sizes) - 1) for x in totals]
    columns = [table.column("range"), table.column("chunk"), *[pa.array(x, pa.binary()) for x in rest], *[pa.array(x, pa.int64()) for x in totals]]
    return pa.Table.from_arrays(columns, ["range", "chunk", "n", "t", "words", "all_n", "all_t"])


def losses(sizes: Sizes, words: Words, which: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Loss in nats per word under the background and the target, (2, words). ``words`` are those of a
    chunk, ``which`` says where each word's and then each pair's key stands in ``counts``, which are
    those of all texts."""
    n, heads = len(words.hashes), heads_of(words)
    out = np.empty((2, n))
    for k, total in enumerate(sizes.totals):
        count, pair = counts[k][which[:n]], counts[k][which[n:]]
        # One more word stands for all that were never seen.
        single = (count + 0.5) / (total + 0.5 * (sizes.distinct + 1))
        # What a text's first word follows is seen as often as any word on average.
        seen = np.empty(n)
        seen[1:] = count[:-1]
        seen[heads] = total / (sizes.distinct + 1)
        out[k] = -np.log((np.minimum(pair, seen) + PRIOR * single) / (seen + PRIOR))
    return out


def cross_entropy_difference(docs: DataFrame, target: DataFrame | str) -> DataFrame:
    """``docs`` without ``text``, with ``n_tokens``, ``target_loss``, ``background_loss`` (means in
    nats) and ``score``, their difference; the background is all of ``docs``, the target the ``text``
    of another frame, or the rows of ``docs`` in which the boolean column ``target`` is true.

    A null or wordless text has 0 tokens and 0 in all. Without target texts both models know no more
    than the vocabulary's size about the target, and scores still order documents. Repeated rows
    count each; columns with the new names are replaced; an empty table gives no rows."""
    kept = [c for c in docs.columns if c not in (*_NEW, "text")]
    # By number, so that no column can be taken for one of those made here.
    own = [f"c{i}" for i in range(len(kept))]
    text = F.col("text").cast("string").alias("text")
    chosen = F.coalesce(F.col(f"`{target}`"), F.lit(False)) if isinstance(target, str) else F.lit(False)
    source = docs.select(
        *[F.col(f"`{c}`").alias(x) for c, x in zip(kept, own)], text, F.lit(True).alias("background"), chosen.alias("target")
    )
    schema = source.schema
    if not isinstance(target, str):
        # Texts that are counted only.
        more = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema[: len(own)]]
        source = source.unionByName(target.select(*more, text, F.lit(False).alias("background"), F.lit(True).alias("target")))
    source = materialize(source.mapInArrow(giving_back(_chunked), "chunk bigint, bytes bigint, rows binary"), "chunks")
    ranges = max(1, -(-(source.agg(F.sum("bytes")).first()[0] or 0) // RANGE))
    counts = source.select("chunk", "rows").mapInArrow(giving_back(_counter(ranges)), _COUNTS)
    sums = materialize(counts.groupBy("range").applyInArrow(_summed, _SUMS), "sums")
    r = sums.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("words", "all_n", "all_t")]).first()
    sizes = Sizes(r.words, (r.all_n, r.all_t))

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        table = _rows(left.column("rows")[0])
        words, keys, which, counts = _counted(table)
        cuts = _cuts(keys, ranges)
        for i, *rest in zip(*[right.column(c).to_pylist() for c in ("range", "n", "t")]):
            part = slice(cuts[i], cuts[i + 1])
            counts[:, part] += np.array([_decoded(x, cuts[i + 1] - cuts[i]) for x in rest]).astype(np.int64)
        n = np.diff(words.bounds)
        each = losses(sizes, words, which, counts.astype(float))
        # Text by text, so that equal texts have equal sums.
        total = np.array([each[:, s:e].sum(axis=1) for s, e in zip(words.bounds[:-1], words.bounds[1:])])
        background, good = total.T / np.maximum(n, 1)
        new = [pa.array(x) for x in (n, good, background, good - background)]
        out = pa.Table.from_arrays([*[table.column(x) for x in own], *new], [*own, *_NEW])
        give_back()
        return out.filter(table.column("background"))

    made = [StructField("n_tokens", LongType()), *[StructField(c, DoubleType()) for c in _NEW[1:]]]
    chunked = source.select("chunk", "rows").groupBy("chunk")
    out = chunked.cogroup(sums.select("chunk", "range", "n", "t").groupBy("chunk"))
    out = out.applyInArrow(scored, StructType([*schema.fields[: len(own)], *made]))
    return out.select(*[F.col(x).alias(c) for x, c in zip(own, kept)], *_NEW)
