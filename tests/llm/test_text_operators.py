"""Operators inside one document, against plain restatements."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import public_tokenizers
from corpuscope.llm import bpe, fingerprints, pii, quality_rules
from corpuscope.llm.queries import QUERIES
from corpuscope.llm.textarrays import split_words, text_buffer

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def reference():
    ranks = {t: i for i, t in enumerate(bpe.load_ranks(RANKS))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@given(st.lists(st.text(st.sampled_from(list("ab's' \n\t 1²é.!reveld日😀")), max_size=40), max_size=8))
@settings(max_examples=150, deadline=None)
def test_encoder_equals_tiktoken(reference, texts):
    encoder, _ = bpe.batch_encoder("ranks", RANKS)
    ids, bounds = encoder(texts)
    assert [ids[s:e].tolist() for s, e in zip(bounds[:-1], bounds[1:])] == [reference.encode_ordinary(t) for t in texts]


def test_long_text_is_cut_without_a_trace(reference):
    text = "it's a long one, isn't it?  Yes \n" * 300
    parts = bpe.split_long(text, 1000)
    assert len(parts) > 5 and "".join(parts) == text
    assert [i for p in parts for i in reference.encode_ordinary(p)] == reference.encode_ordinary(text)


@given(st.lists(st.text(max_size=30), max_size=6))
@settings(max_examples=100, deadline=None)
def test_words(texts):
    buf, offsets = text_buffer(pa.array(texts, pa.string()))
    words = split_words(buf, offsets)
    cut = [bytes(buf[s:e]) for s, e in zip(words.starts, words.ends)]
    want = [w.encode() for t in texts for w in WORD.findall(t)]
    assert cut == want
    assert np.diff(words.bounds).tolist() == [len(WORD.findall(t)) for t in texts]
    fold = [w.lower() if w.isascii() else None for w in map(lambda b: b.decode("utf-8", "replace"), cut)]
    by_word = {}
    for f, h in zip(fold, words.hashes.tolist()):
        if f is not None:
            assert by_word.setdefault(f, h) == h


def test_words_across_blocks(monkeypatch):
    text = "alpha beta " * 50 + "x" * 300 + " end"
    buf, offsets = text_buffer(pa.array([text, "", text]))
    whole = split_words(buf, offsets)
    monkeypatch.setattr("corpuscope.llm.textarrays.BLOCK", 64)
    parts = split_words(buf, offsets)
    for a, b in zip(whole, parts):
        assert np.array_equal(a, b)


def test_bpe_query(spark, tables, texts, reference):
    for r in QUERIES["op6_byte_bpe"](spark, tables).collect():
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
        assert r.n_chars == len(texts[r.doc_id])


def test_offsets(spark):
    from corpuscope.llm import byte_bpe

    text = "Größe 日本 😀 ok"
    row = byte_bpe.encode(spark.createDataFrame([(1, text)], "doc_id int, text string"), RANKS).first()
    tokens = bpe.load_ranks(RANKS)
    at = 0
    for i, start in zip(row.ids, row.starts):
        # The character that holds the token's first byte.
        assert len(text.encode()[: at + 1].decode("utf-8", "ignore")) in (start, start + 1)
        at += len(tokens[i])
    assert at == len(text.encode())


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, digits[::-1]))]
    return sum(doubled) % 10 == 0


def is_valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def base_spans(text):
    found = [(m.start(), i, m.end()) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if is_valid(k, m.group())]
    return sorted(found)


HARD_SPANS = [
    "a@b.co_x@d.e f@g.h.i@j.k",
    "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 5",
    "+1 (555) 123-4567 +49 30 123456 ++12345678901",
    "😀 é x@y.z, call +1 (555) 123-4567 or 10.0.0.1",
    "mail me: joe (at) example (dot) com, phone 555-123-4567, visa 4111 1111 1111 1112",
    "@" * 50 + "a" * 2000 + "@" + "b." * 500,
    "12 " * 400,
    " ".join(f"u{i}@h{i}.org" for i in range(300)),
]


def test_base_spans(spark, texts):
    rows = list(enumerate([*HARD_SPANS, *texts.values()]))
    found = pii.find(spark.createDataFrame(rows, "doc_id int, text string"))
    for r in found.collect():
        assert [(s.start, s.k, s.end) for s in r.base_spans] == base_spans(rows[r.doc_id][1]), r.doc_id
        assert set(map(tuple, r.base_spans)) <= set(map(tuple, r.spans))


@given(st.text(st.sampled_from(list("a1@.+-_ ()2b")), max_size=40))
@settings(max_examples=400, deadline=None)
def test_strict_patterns_match_alike(text):
    for kind, plain in PATTERNS.items():
        strict = pii.STRICT[kind].replace(r"(?:\G|", "(?:")
        if kind == "email":
            # re has no \G: emulate it by trying at the end of the last match.
            spans, at = [], 0
            while m := re.search(plain, text[at:]):
                spans.append((at + m.start(), at + m.end()))
                at += m.end()
            assert spans == [m.span() for m in re.finditer(plain, text)]
        else:
            assert [m.span() for m in re.finditer(strict, text)] == [m.span() for m in re.finditer(plain, text)]


def test_loose_spans_are_decided(spark):
    good = [(i, f"please call my phone 555-123-{1000 + i} today or mail to u{i}@host{i}.org") for i in range(60)]
    odd = [(100 + i, f"order token key 111-111-{1000 + i}x and more") for i in range(20)]
    found = {r.doc_id: r for r in pii.find(spark.createDataFrame(good + odd, "doc_id int, text string")).collect()}
    assert all(len(found[i].spans) == 2 for i, _ in good)
    assert all(not found[i].spans for i, _ in odd)


def test_secrets_are_found(spark):
    rng = random.Random(5)
    word = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    made, rows = {}, []
    upper, hexed, any_ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789abcdef", "abcdefghijkABCDEFGH0123456789"
    forms = [
        ("the {} here", lambda: "AKIA" + word(upper, 16)),
        ("as password={} was", lambda: "a1" + word(hexed, 16)),
        ('with token = "{}" in', lambda: word(hexed, 40)),
        ("see api_key: '{}'.", lambda: "k9" + word(any_, 22)),
        ("use ghp_{} now", lambda: word(any_, 36)),
    ]
    for i in range(200):
        frame, make = forms[i % len(forms)]
        value = make()
        text = "é😀 Some words before, " + frame.format(value) + " and some behind."
        value = ("ghp_" if "ghp_" in text else "") + value
        made[i] = (text.index(value), text.index(value) + len(value))
        rows.append((i, text))
    clean = ["no token: here", "the secret of 1234 things", f"commit sha {word(hexed, 40)}", "password = unknown", f"sha256 checksum {word(hexed, 64)}"]
    rows += [(1000 + i, clean[i % len(clean)]) for i in range(100)]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    secret = pii.KINDS.index("secret")
    assert all((made[i][0], secret, made[i][1]) in [tuple(x) for x in got[i].spans] for i in made)
    assert not any(x.k == secret for i in got if i >= 1000 for x in got[i].spans)
    assert not any(r.base_spans for r in got.values())


def test_redaction(spark):
    text = "😀 write a.b@c.org, +1 (555) 123-4567 from 10.0.0.1."
    docs = spark.createDataFrame([(1, text, "x"), (2, None, "y"), (3, "none", "z")], "doc_id int, text string, spans string")
    got = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert got == {1: "😀 write <EMAIL>, <PHONE> from <IP>.", 2: None, 3: "none"}


def test_running_ends(spark):
    rows = [([i % 7 for i in range(n)],) for n in (0, 1, 63, 64, 65, 1000)]
    for r in spark.createDataFrame(rows, "x array<int>").select("x", pii.running_ends(F.col("x")).alias("y")).collect():
        assert r.y == np.cumsum(r.x).tolist()


def test_quality_counts(spark, texts):
    more = ["a b c a b c d", "x\nx\n\ny\nx ", "# $ <|>", "a a a a", "one two"]
    rows = list(enumerate([*texts.values(), *more]))
    for r in quality_rules.document_rules(spark.createDataFrame(rows, "doc_id int, text string")).collect():
        text = rows[r.doc_id][1]
        w = WORD.findall(text)
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want


def test_bad_host(spark):
    fine = " ".join(f"word{i}" for i in range(60))
    rows = [(i, fine if i % 50 else "junk", "good") for i in range(200)]
    rows += [(1000 + i, "# $ % junk" if i % 10 else fine, "bad") for i in range(200)]
    rows += [(2000, "junk", "small"), (2001, fine, None)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id int, text string, source string")).collect()}
    assert got[1].kept and not got[0].kept and not got[0].host_rejected
    assert got[1000].host_rejected and not got[1000].base_failed and not got[1000].kept
    assert got[2001].kept and not got[2001].host_rejected


def test_prior():
    alpha, beta = quality_rules.beta_prior(3, 300, 30, 3.0)
    assert abs(alpha / (alpha + beta) - 0.1) < 1e-9 and alpha + beta == quality_rules.MAX_WEIGHT
    spread = quality_rules.beta_prior(2, 200, 100, 100 * (0.9**2 + 0.1**2))
    assert spread[0] == spread[1] and 0.2 < spread[0] < 2
    assert quality_rules.beta_prior(0, 0, 0, 0.0) == (0.5, 0.5)


def paragraphs(text):
    return {x for x in re.split(r"\n+|(?<=[.!?])\x20+", text) if x}


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(spark, tables, texts):
    rows = sorted(texts.items())
    following = dict(zip([i for i, _ in rows], [t for _, t in rows[1:] + rows[:1]]))
    prints = {}
    for r in QUERIES["op5_fingerprints"](spark, tables).collect():
        text, after = texts[r.doc_id], following[r.doc_id]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - likeness(paragraphs(text), paragraphs(edited))) < 1e-12
        assert abs(r.near_next - likeness(paragraphs(text), paragraphs(after))) < 1e-12
        prints.setdefault(text, set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in prints.values())


def test_difference_is_recovered_and_retried(spark, monkeypatch):
    rng = np.random.default_rng(3)
    pool = [int(x) for x in rng.integers(-(2**62), 2**62, 900)]
    rows = [(pool[:n], pool[m : m + k]) for n, m, k in ((0, 0, 0), (5, 0, 5), (5, 2, 9), (400, 200, 500), (1, 1, 0))]
    frame = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>")
    monkeypatch.setattr(fingerprints, "FIRST_PART", 2)
    got = frame.select("a", "b", fingerprints.difference(F.col("a"), F.col("b")).alias("d")).collect()
    for r in got:
        assert r.d.whole
        assert sorted(r.d.removed) == sorted(set(r.a) - set(r.b)) and sorted(r.d.added) == sorted(set(r.b) - set(r.a))
    assert max(r.d.tries for r in got) > 1


def test_next_document(spark):
    rows = [(i, f"t{i}") for i in [*range(0, 9000, 2), 10**12, -5]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    got = {r.doc_id: r.next_text for r in fingerprints.with_next(docs, ["text"]).collect()}
    ids = sorted(i for i, _ in rows)
    assert got == {i: f"t{j}" for i, j in zip(ids, ids[1:] + ids[:1])}
    single = fingerprints.with_next(docs.where("doc_id = 2"), ["text"]).first()
    assert single.next_text == "t2"


def test_ranges_are_even_however_ids_are_spread(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE", 50)
    spread = [*range(2000), *[10**15 + i for i in range(500)], *[None] * 700, *[7] * 800]
    rows = [(d, f"t{n}") for n, d in enumerate(spread)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    sizes = sorted(r["count"] for r in fingerprints.ranged(docs).groupBy("_range").count().collect())
    assert sum(sizes) == len(rows) and sizes[-1] <= 3 * sizes[len(sizes) // 2]
    got = fingerprints.with_next(docs, ["text"]).select("text", "next_text").collect()
    # One ring through all rows, ids ascending along it.
    after, ids = {r.text: r.next_text for r in got}, {t: d for d, t in rows}
    ring = ["t2500"]
    while len(ring) <= len(rows) and after[ring[-1]] != "t2500":
        ring.append(after[ring[-1]])
    assert len(ring) == len(rows) == len(after)
    turned = [-1 if ids[t] is None else ids[t] for t in ring]
    assert sum(x > y for x, y in zip(turned, turned[1:] + turned[:1])) == 1
