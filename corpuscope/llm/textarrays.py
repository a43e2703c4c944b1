"""Words of many texts at once, as numpy arrays.

A batch of texts is one buffer of UTF-8 bytes. Words are cut and hashed for the whole buffer in a few
vector operations, in blocks of bounded size that end between words, so neither the number of texts
nor the length of one text decides how much memory is needed beyond eight bytes or so per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_WORD = (1 << 64) - 1


def give_back() -> None:
    """Returns freed memory to the machine. A worker serves many tasks, also of later stages, and what
    it still held of the earlier ones would count against their limits."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def giving_back(task: Callable) -> Callable:
    """The task of a map over batches, with ``give_back`` at its end."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from task(batches)
        finally:
            give_back()

    return run



def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & _WORD, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_INVERSE = pow(_BASE, -1, 1 << 64)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least ``n`` of each."""
    if n > BLOCK:
        return _powers(_BASE, n), _powers(_INVERSE, n)
    if BLOCK not in _tables:
        _tables[BLOCK] = _powers(_BASE, BLOCK), _powers(_INVERSE, BLOCK)
    return _tables[BLOCK]


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
PUNCTUATION = SPACE.copy()
PUNCTUATION[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True


class Words(NamedTuple):
    """Hashes of all words, their first byte and the byte after their last, and per text the
    position of its first word, with one more entry for the end."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of string values and their offsets; a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, kind)
    off = off.astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def _block_end(buf: np.ndarray, offsets: np.ndarray, pos: int, space: np.ndarray) -> int:
    """Where the block that begins at ``pos`` ends: between two words."""
    stop = pos + BLOCK
    if stop >= len(buf):
        return len(buf)
    text_start = offsets[np.searchsorted(offsets, stop, "right") - 1]
    blank = np.flatnonzero(space[buf[pos:stop]])
    cut = max(pos + blank[-1] + 1 if len(blank) else pos, text_start)
    if cut > pos:
        return int(cut)
    text_end = int(offsets[np.searchsorted(offsets, stop, "right")])
    while stop < text_end:  # one word longer than a block
        blank = np.flatnonzero(space[buf[stop : min(stop + BLOCK, text_end)]])
        if len(blank):
            return stop + int(blank[0])
        stop = min(stop + BLOCK, text_end)
    return text_end


def split_words(buf: np.ndarray, offsets: np.ndarray, fold: np.ndarray = FOLD, space: np.ndarray = SPACE) -> Words:
    """Cuts every text into the longest runs of bytes that are no ``space``, after ``fold``."""
    hashes, starts, ends, pos = [], [], [], 0
    while pos < len(buf):
        stop = _block_end(buf, offsets, pos, space)
        b = fold[buf[pos:stop]]
        inner = ~space[b]
        cut = np.zeros(len(b) + 1, dtype=bool)
        lo, hi = np.searchsorted(offsets, [pos, stop])
        cut[offsets[lo:hi] - pos] = True
        cut[0] = cut[-1] = True
        cut[1:-1] |= ~inner[:-1]
        s = np.flatnonzero(inner & cut[:-1])
        cut[1:-1] = False
        cut[offsets[lo:hi] - pos] = True
        cut[0] = cut[-1] = True
        cut[:-1] |= ~inner
        e = np.flatnonzero(inner & cut[1:]) + 1
        up, down = powers(len(b))
        sums = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum(BYTE_CODE[b] * up[: len(b)], out=sums[1:])
        h = (sums[e] - sums[s]) * down[s] if len(s) else np.zeros(0, np.uint64)
        hashes.append(mix(h + (e - s).astype(np.uint64) * np.uint64(_BASE)))
        starts.append(s + pos)
        ends.append(e + pos)
        pos = stop
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    first = join(starts, np.int64)
    return Words(join(hashes, np.uint64), first, join(ends, np.int64), np.searchsorted(first, offsets))


def chunks(batch: pa.RecordBatch, column: str, max_bytes: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold some ``max_bytes`` together; a longer text has its own."""
    if not batch.num_rows:
        return
    _, offsets = text_buffer(batch.column(column))
    begin = 0
    while begin < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[begin] + max_bytes, "right")) - 1
        end = min(max(end, begin + 1), batch.num_rows)
        yield batch.slice(begin, end - begin)
        begin = end
    pa.default_memory_pool().release_unused()


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A list column of int64 from values one after the other and the size of each list."""
    offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values).view(np.int64)))
