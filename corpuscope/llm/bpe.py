"""Byte-level BPE for whole batches of texts.

Encoding a text means cutting it into pieces by a pattern, and then encoding each piece by itself.
Texts repeat their pieces over and over, so the tokenizers library only sees each piece when it is
new: pieces are cut and hashed for a batch in numpy, looked up in a table of bounded size, and what
isn't there goes to the library in one call. Texts with characters whose class might depend on the
library's version of Unicode go to the library as they are.
"""

from __future__ import annotations

import base64
import os
import re
import unicodedata
from collections.abc import Callable, Sequence

import numpy as np

from corpuscope.llm.textarrays import _BASE, give_back, mix, powers

_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 4
#: Scripts whose character classes have not changed for long; white space lies in the second range.
_SETTLED = ((0x0000, 0x0530), (0x2000, 0x2100))
_LIMIT = 0x2100
_WHITE = {*range(0x09, 0x0E), 0x20, 0x85, 0xA0, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F}


def _classes() -> np.ndarray:
    out = np.zeros(_LIMIT + 1, dtype=np.uint8)
    for low, high in _SETTLED:
        for i in range(low, high):
            kind = unicodedata.category(chr(i))
            if kind != "Cn":
                out[i] = _SPACE if i in _WHITE else {"L": _LETTER, "N": _NUMBER}.get(kind[0], _OTHER)
    return out


CLASSES = _classes()
_CODES = mix(np.arange(1, _LIMIT + 2, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_LONGEST = 64
#: Characters that are worked on at a time, and pieces that the library gets in one call: what it hands
#: back takes some hundred bytes per token.
_GROUP, _CALL = 1 << 18, 2048
#: Ids that a worker remembers (16 MB).
_POOL = 1 << 22


def split_long(text: str, size: int = 1 << 18) -> list[str]:
    """Parts of a text whose encodings, one after the other, are the encoding of the text: cut
    before a single blank between two characters that are none."""
    parts, gap = [], re.compile(r"(?<=\S) (?=\S)")
    while len(text) > size and (m := gap.search(text, size)):
        parts.append(text[: m.start()])
        text = text[m.start() :]
    return [*parts, text]


def piece_starts(c: np.ndarray, cls: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin: characters ``c`` of classes ``cls``, texts at ``offsets``.

    A piece is, in this order: a contraction; letters, digits or other characters with at most one
    blank before them; white space up to the last one before a non-space; other white space."""
    n = len(c)
    head = np.zeros(n + 3, dtype=bool)  # the first character of a text, or past the end
    head[offsets] = True
    head[n:] = True
    start = head[:n].copy()
    start[1:] |= cls[1:] != cls[:-1]
    space = cls == _SPACE
    attached = np.zeros(n, dtype=bool)
    attached[1:] = (c[:-1] == 0x20) & ~space[1:] & ~head[1:n]
    start &= ~attached
    last = np.zeros(n, dtype=bool)
    last[:-1] = space[:-1] & ~space[1:] & ~head[1:n]
    start |= last
    _cut_contractions(c, cls, head, start)
    return np.flatnonzero(start)


def _cut_contractions(c: np.ndarray, cls: np.ndarray, head: np.ndarray, start: np.ndarray) -> None:
    """Joins an apostrophe that begins a piece to the ending after it, which is a piece with it."""
    q = np.flatnonzero((c == 0x27) & start)
    q = q[~head[q + 1]]
    if len(q):
        wide, kind = np.append(c, [0, 0, 0]), np.append(cls, [0, 0, 0])
        a, b = wide[q + 1], np.where(head[q + 2], 0, wide[q + 2])
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = np.zeros(len(q), dtype=bool)
        for x, y in ("re", "ve", "ll"):
            two |= (a == ord(x)) & (b == ord(y))
        start[q[one | two] + 1] = False
        after = np.concatenate([q[one] + 2, q[two] + 3])
        after = after[(kind[after] == _LETTER) & ~head[after]]
        start[after] = True


class ByteLevel:
    """Pieces of byte-level vocabularies: everything, white space too, in the case it has."""

    classes = CLASSES

    @staticmethod
    def cut(c: np.ndarray, cls: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts = piece_starts(c, cls, heads)
        return c, starts, np.append(starts[1:], len(c))


def _fold() -> tuple[np.ndarray, np.ndarray]:
    """Classes and lower-case forms of the characters that normalisation and lower-casing change one by
    one, whatever stands around them; the others have class 0."""
    classes, lower = CLASSES.copy(), np.arange(_LIMIT + 1, dtype=np.uint32)
    for i in np.flatnonzero(CLASSES).tolist():
        small = chr(i).lower()
        alone = unicodedata.category(chr(i))[0] != "M" and unicodedata.normalize("NFC", chr(i)) == chr(i)
        if not alone or len(small) > 1 or ord(small) > _LIMIT or small == "\u03c3" != chr(i):
            classes[i] = 0
        else:
            lower[i] = ord(small)
    return classes, lower


class WordEnds:
    """Pieces of lower-cased vocabularies with word ends: contractions, runs of letters, single digits
    and runs of other characters; white space is dropped."""

    classes, lower = _fold()

    @classmethod
    def cut(cls_, c: np.ndarray, cls: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, c = len(c), cls_.lower[c]
        head = np.zeros(n + 3, dtype=bool)
        head[heads] = True
        head[n:] = True
        start = head[:n] | (cls == _NUMBER)
        start[1:] |= cls[1:] != cls[:-1]
        _cut_contractions(c, cls, head, start)
        starts = np.flatnonzero(start)
        inked = cls[starts] != _SPACE
        return c, starts[inked], np.append(starts[1:], n)[inked]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of the elements of slices ``starts``, ``sizes``, one slice after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class BatchEncoder:
    """Encodes lists of texts by an ``encode`` function for lists of strings, piece by piece as ``pieces``
    cuts them."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], pieces=ByteLevel, slots: int = 1 << 20, pool: int = _POOL):
        self.encode, self.pieces, self.mask = encode, pieces, np.uint64(slots - 1)
        self.keys = np.zeros(slots, dtype=np.uint64)
        self.at = np.zeros(slots, dtype=np.int32)
        self.size = np.zeros(slots, dtype=np.int32)
        self.pool, self.filled = np.zeros(pool, dtype=np.int32), 0

    def __call__(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's ids begin and end."""
        groups, begin, chars = [], 0, 0
        for i, t in enumerate(texts):
            if chars and chars + len(t) > _GROUP:
                groups.append(texts[begin:i])
                begin, chars = i, 0
            chars += len(t)
        groups.append(texts[begin:])
        ids, sizes = [], []
        for g in groups:
            if len(g) == 1 and len(g[0]) > _GROUP:
                parts = [self._group([p])[0] for p in split_long(g[0])]
                ids += parts
                sizes.append(np.array([sum(map(len, parts))]))
            elif g:
                got, n = self._group(g)
                ids.append(got)
                sizes.append(n)
        bounds = np.zeros(len(texts) + 1, dtype=np.int64)
        if sizes:
            np.cumsum(np.concatenate(sizes), out=bounds[1:])
        return (np.concatenate(ids) if ids else np.zeros(0, np.int32)), bounds

    def _group(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        c = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
        sizes = np.array([len(t) for t in texts])
        offsets = np.cumsum(sizes) - sizes
        cls = self.pieces.classes[np.minimum(c, _LIMIT)]
        unsure = np.flatnonzero(cls == 0)
        if len(unsure):
            odd = np.zeros(len(texts), dtype=bool)
            odd[np.searchsorted(offsets + sizes, unsure, "right")] = True
            got = self.encode([t for t, o in zip(texts, odd) if o])
            rest, n = self._group([t for t, o in zip(texts, odd) if not o]) if not odd.all() else (None, None)
            out: list = [None] * len(texts)
            ends = np.cumsum(n) if n is not None else None
            for j, i in enumerate(np.flatnonzero(odd)):
                out[i] = np.array(got[j], dtype=np.int32)
            for j, i in enumerate(np.flatnonzero(~odd)):
                out[i] = rest[ends[j] - n[j] : ends[j]]
            return np.concatenate(out), np.array([len(x) for x in out])
        if not len(c):
            return np.zeros(0, np.int32), sizes
        heads = offsets[sizes > 0]
        c, s, e = self.pieces.cut(c, cls, heads)
        up, down = powers(len(c))
        sums = np.zeros(len(c) + 1, dtype=np.uint64)
        np.cumsum(_CODES[c] * up[: len(c)], out=sums[1:])
        key = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(_BASE))
        slot = (key & self.mask).astype(np.int64)
        long = e - s > _LONGEST
        miss = np.flatnonzero((self.keys[slot] != key) | long)
        at, size, pool = self.at[slot].astype(np.int64), self.size[slot], self.pool
        if len(miss):
            text = "".join(texts)
            mine = np.where(long[miss], miss.astype(np.uint64), key[miss] | np.uint64(1 << 63))
            _, first, which = np.unique(mine, return_index=True, return_inverse=True)
            new = miss[first]
            made = self.encode([text[i:j] for i, j in zip(s[new].tolist(), e[new].tolist())])
            new_size = np.array([len(x) for x in made], dtype=np.int32)
            flat = np.fromiter((i for x in made for i in x), dtype=np.int32, count=int(new_size.sum()))
            new_at = self.filled + np.cumsum(new_size) - new_size
            at[miss], size[miss] = new_at[which], new_size[which]
            if self.filled + len(flat) > len(pool):  # full: these texts still use it, then it starts anew
                pool = np.concatenate([pool[: self.filled], flat])
                self.keys[:] = 0
                self.filled = 0
            else:
                pool[self.filled : self.filled + len(flat)] = flat
                self.filled += len(flat)
                keep = ~long[new]
                where = slot[new][keep]
                self.keys[where], self.at[where], self.size[where] = key[new][keep], new_at[keep], new_size[keep]
                # Two new keys may want one slot; the last one written holds it in all three tables.
        ids = pool[ragged(at, size.astype(np.int64))]
        before = np.append(0, np.cumsum(size))
        first_piece = np.searchsorted(s, np.append(offsets, len(c)))
        return ids, np.diff(before[first_piece])


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


def load_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file by their rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    out = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def ranked_tokenizer(tokens: list[bytes]):
    """A tokenizers model in which any two neighbours merge whose bytes together are a token, the
    lowest rank first; a piece that is a token stays whole."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    import public_tokenizers

    chars = byte_characters()
    names = ["".join(chars[b] for b in t) for t in tokens]
    vocab = {n: i for i, n in enumerate(names)}
    merges = []
    for n in names:
        halves = [(n[:i], n[i:]) for i in range(1, len(n)) if n[:i] in vocab and n[i:] in vocab]
        merges += sorted(halves, key=lambda h: (vocab[h[0]], vocab[h[1]]))
    made = Tokenizer(models.BPE(vocab=vocab, merges=merges, ignore_merges=True))
    cut = pre_tokenizers.Split(Regex(public_tokenizers.PATTERN), behavior="isolated")
    made.pre_tokenizer = pre_tokenizers.Sequence([cut, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return made


def file_tokenizer(path: str):
    """A tokenizer of the tokenizers library from its file; names of special tokens that occur in a
    text are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    return made


_encoders: dict = {}


def forget() -> None:
    """Lets a worker's encoder go, for tasks of a later stage that have no use for it."""
    if _encoders:
        _encoders.clear()
        give_back()


def batch_encoder(kind: str, path: str) -> tuple[BatchEncoder, list[bytes]]:
    """The encoder for a file, made once per Python worker; with ``kind`` ``ranks``, its tokens too.
    ``words`` is for tokenizer files that lower-case and mark word ends, ``file`` for byte-level ones."""
    if (kind, path) not in _encoders:
        tokens = load_ranks(path) if kind == "ranks" else []
        model = ranked_tokenizer(tokens) if kind == "ranks" else file_tokenizer(path)

        def encode(texts: list[str]) -> list[list[int]]:
            parts = (texts[i : i + _CALL] for i in range(0, len(texts), _CALL))
            return [x.ids for part in parts for x in model.encode_batch_fast(part, add_special_tokens=False)]

        _encoders.clear()  # a worker that goes on to another vocabulary lets the last one go
        _encoders[kind, path] = BatchEncoder(encode, WordEnds if kind == "words" else ByteLevel), tokens
    return _encoders[kind, path]
