"""Byte-level BPE as a round trip: texts to ids with offsets, and ids back to bytes.

Byte-level vocabularies spell every byte as a printable character. Encoding goes through the
tokenizers library in Arrow batches; decoding reverses the table of characters. A token may hold
part of a character only: its offset is that of the character it belongs to, and bytes that form no
character come back as they are in ``bytes`` and as U+FFFD in ``text``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.bpe import batch_encoder, ragged
from corpuscope.llm.textarrays import chunks, text_buffer


def _int_lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(np.int32)))


def token_table(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes one after the other, and where each begins and how many it has."""
    sizes = np.array([len(t) for t in tokens], dtype=np.int64)
    return np.frombuffer(b"".join(tokens), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes


def char_offsets(buf: np.ndarray, text_bounds: np.ndarray, sizes: np.ndarray, id_bounds: np.ndarray) -> np.ndarray:
    """The character in its text with which, or inside which, each token begins."""
    ends = np.cumsum(sizes)
    at = ends - sizes
    begun = np.cumsum((buf & 0xC0) != 0x80)
    before = np.append(0, begun)[text_bounds[:-1]]
    owner = np.repeat(np.arange(len(id_bounds) - 1), np.diff(id_bounds))
    return begun[at] - 1 - before[owner] if len(at) else at


def encode(docs: DataFrame, ranks: str, text: str = "text", offsets: bool = True) -> DataFrame:
    """``docs`` without ``text``, with ``ids`` and, with ``offsets``, the first character of each token
    as ``starts``.

    ``ranks`` is a rank file; pieces are cut by the pattern that belongs to it and no special tokens
    exist. A null or empty text has no ids. Repeated rows are encoded each; columns with the new
    names are replaced; an empty table gives no rows."""
    kept = [c for c in docs.columns if c not in (text, "ids", "starts")]
    source = docs.select(*kept, F.col(text).cast("string").alias("_text"))
    fields = [f"`{n}` {t}" for n, t in docs.select(kept).dtypes] + ["ids array<int>"] + ["starts array<int>"] * offsets
    names = [*kept, "ids"] + ["starts"] * offsets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tokens = batch_encoder("ranks", ranks)
        sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        for batch in batches:
            for part in chunks(batch, "_text"):
                column = part.column("_text")
                ids, bounds = encoder([t or "" for t in column.to_pylist()])
                out = [*part.columns[:-1], _int_lists(ids, bounds)]
                if offsets:
                    buf, text_bounds = text_buffer(column)
                    out.append(_int_lists(char_offsets(buf, text_bounds, sizes[ids], bounds), bounds))
                yield pa.RecordBatch.from_arrays(out, names)

    return source.mapInArrow(run, ", ".join(fields))


def decode(encoded: DataFrame, ranks: str, text: bool = True) -> DataFrame:
    """``encoded`` with the ``bytes`` of its ``ids`` and, with ``text``, these as a string ``text``.

    Null ids have no bytes; an id outside the vocabulary is an error."""
    kept = [c for c in encoded.columns if c not in ("bytes", "text")]
    source = encoded.select(kept)
    fields = [f"`{n}` {t}" for n, t in source.dtypes] + ["bytes binary"] + ["text string"] * text
    names = [*kept, "bytes"] + ["text"] * text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, tokens = batch_encoder("ranks", ranks)
        flat, at, sizes = token_table(tokens)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                ids = part.column("ids")
                values = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                counts = np.array([0 if n is None else n for n in ids.value_lengths().to_pylist()], dtype=np.int64)
                data = flat[ragged(at[values], sizes[values])]
                edges = np.append(0, np.cumsum(sizes[values]))[np.append(0, np.cumsum(counts))]
                raw = [data[s:e].tobytes() for s, e in zip(edges[:-1], edges[1:])]
                out = [*part.columns, pa.array(raw, pa.binary())]
                if text:
                    out.append(pa.array([b.decode("utf-8", "replace") for b in raw], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names)

    return source.mapInArrow(run, ", ".join(fields))
