"""Token files: ids against the library, one text at a time, and access to single sequences."""

import zlib

import numpy as np
import pytest

import public_tokenizers
from corpuscope.llm import sequence_files
from corpuscope.llm.bpe import BatchEncoder, WordEnds, batch_encoder, file_tokenizer
from corpuscope.llm.queries import op13_token_files
from corpuscope.session import scratch_path
from tests.llm.conftest import HARD

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    made = file_tokenizer(VOCABULARY)
    return lambda text: made.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_query_is_the_library_text_by_text(spark, tables, texts, library):
    got = {r.doc_id: r for r in op13_token_files(spark, tables).collect()}
    assert set(got) == set(texts)
    start = 0
    for doc_id in sorted(texts):
        ids = [*library(texts[doc_id]), 2]
        assert (got[doc_id].start, got[doc_id].n_tokens, got[doc_id].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)


def test_hard_rows(spark, hard, library):
    index = sequence_files.write_sequences(hard, scratch_path(spark, "hard"), VOCABULARY, 2, length=16, rows=3)
    got = sorted(tuple(r) for r in sequence_files.read_documents(index).select("start", "doc_id", "n_tokens", "ids_crc32").collect())
    assert len(got) == len(HARD) and got[0][:2] == (0, None)
    assert [r[1] for r in got[1:]] == sorted(i for i, _ in HARD if i is not None)
    want = {i: [*library(t), 2] for i, t in HARD}
    place = 0
    for start, doc_id, n, value in got:
        assert (start, n, value) == (place, len(want[doc_id]), crc(want[doc_id]))
        place += n


def test_empty(spark, nothing):
    index = sequence_files.write_sequences(nothing, scratch_path(spark, "none"), VOCABULARY, 2)
    assert sequence_files.read_documents(index).count() == 0


def test_sequences_are_views_of_equal_length(spark, hard, library):
    index = sequence_files.write_sequences(hard.coalesce(1), scratch_path(spark, "views"), VOCABULARY, 2, length=16, rows=3)
    files = {}
    for r in sorted(index.collect(), key=lambda r: (r.shard, r.position)):
        files.setdefault(r.file, []).extend([*library(dict(HARD)[r.doc_id]), 2])
    for name, want in files.items():
        with sequence_files.SequenceFile(name) as file:
            assert len(file) == -(-len(want) // 16)
            for i in (0, len(file) // 2, len(file) - 1):
                ids, mask = file.sequence(i)
                own = want[16 * i : 16 * i + 16]
                assert len(ids) == len(mask) == 16 and not ids.flags.owndata
                assert ids.tolist() == own + [0] * (16 - len(own)) and mask.to_pylist() == [True] * len(own) + [False] * (16 - len(own))


def test_pieces_are_those_of_the_library(library):
    """Every character of the settled scripts between others, contractions, and a memory that overflows."""
    lib = file_tokenizer(VOCABULARY)
    encode = lambda texts: [x.ids for x in lib.encode_batch_fast(texts, add_special_tokens=False)]
    small = BatchEncoder(encode, WordEnds, slots=1 << 10, pool=2000)
    odd = ["'s't", "a'S b'll 'RE", "''s", "12½ 3", "e\u0301 é", "İstanbul ΣΑΣ σας", "x\u00a0y\u2003z", "日本 <|endoftext|>"]
    texts = odd + [f"{chr(i)}a{chr(i)}'s{chr(i)}" for i in [*range(1, 0x530), *range(0x2000, 0x2100)]]
    for encoder in (small, batch_encoder("words", VOCABULARY)[0]):
        ids, bounds = encoder(texts)
        for i, text in enumerate(texts):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == library(text), repr(text)
