"""Language identification by sparse multinomial logistic regression on character n-grams.

N-grams of one to three characters are hashed into a table of fixed size; a text is its TF-IDF vector
of unit length. Document frequencies come from all training texts, the weights from a bounded sample
of them by follow-the-regularised-leader, whose elastic-net penalty leaves most weights at zero. A
temperature fitted to texts left out of training makes the scores probabilities.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.textarrays import chunks, mix

UNKNOWN = "und"
SLOTS, ORDERS = 1 << 15, (1, 2, 3)
#: Training texts per language (in expectation; the draw is by hash), and their longest.
PER_LANGUAGE, MAX_TRAIN_CHARS = 600, 20_000
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.001, 4
_LETTERS = re.compile(r"[^\W\d_]")
_PART = 1 << 20


@cache
def letters() -> np.ndarray:
    """For every code point whether it is kept: letters and marks of all scripts, and what this
    version of Unicode does not know."""
    kinds = map(unicodedata.category, map(chr, range(sys.maxunicode + 1)))
    return np.fromiter((k[0] in "LM" or k in ("Cn", "Co") for k in kinds), dtype=bool, count=sys.maxunicode + 1)


def slots(text: str) -> Iterator[np.ndarray]:
    """Table rows of all n-grams of a text, a bounded number at a time. Letters, with their marks, are
    lower case and all else is a blank; the text stands between blanks."""
    low, overlap = text.lower(), max(ORDERS) - 1
    for begin in range(0, max(len(low), 1), _PART):
        last = begin + _PART >= len(low)
        part = low[begin : begin + _PART + (0 if last else overlap)]
        part = (" " if begin == 0 else "") + part + (" " * overlap if last else "")
        c = np.frombuffer(part.encode("utf-32-le"), dtype=np.uint32)
        c = np.where(letters()[c], c, 32).astype(np.uint64)
        size, rows, h = len(c) - overlap, [], np.uint64(0)
        for n in range(1, overlap + 2):
            h = h * np.uint64(0x100000001B3) + c[n - 1 : n - 1 + size]
            if n in ORDERS:
                rows.append((mix(h + np.uint64(n << 56)) & np.uint64(SLOTS - 1)).astype(np.int64))
        yield np.concatenate(rows)


def counts_of(text: str) -> np.ndarray:
    out = np.zeros(SLOTS, dtype=np.int64)
    for rows in slots(text):
        out += np.bincount(rows, minlength=SLOTS)
    return out


class Model(NamedTuple):
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # slots x languages
    bias: np.ndarray
    temperature: float


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of ``texts`` each slot occurs, and their number. Tasks add up their own texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(SLOTS + 1, dtype=np.int64), 0
        for batch in batches:
            for part in chunks(batch, "text"):
                for t in part.column("text").to_pylist():
                    df[:SLOTS] += counts_of(t or "") > 0
                    n += 1
        df[SLOTS] = n
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(df[used])], ["slot", "n"])

    rows = texts.select("text").mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    out = np.zeros(SLOTS + 1, dtype=np.int64)
    for r in rows.collect():  # one row per slot at most
        out[r.slot] = r.n
    return out[:SLOTS], int(out[SLOTS])


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of the unit TF-IDF vector."""
    v = counts_of(text) * idf
    at = np.flatnonzero(v)
    return at, v[at] / max(np.linalg.norm(v[at]), 1e-12)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by FTRL-proximal with per-coordinate rates; the bias is not penalised."""
    z, g2 = np.zeros((SLOTS + 1, n)), np.zeros((SLOTS + 1, n))

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zi, rate = z[at], (BETA + np.sqrt(g2[at])) / ALPHA
        return np.where(np.abs(zi) > L1, -(zi - np.sign(zi) * L1) / (rate + L2), 0)

    rng = np.random.default_rng(1)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            at, x = np.append(rows[i][0], SLOTS), np.append(rows[i][1], 1.0)
            w = weights(at)
            w[-1] = -z[SLOTS] / ((BETA + np.sqrt(g2[SLOTS])) / ALPHA)
            p = _softmax(x @ w)
            p[y[i]] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(g2[at] + g * g) - np.sqrt(g2[at])) / ALPHA
            z[at] += g - sigma * w
            g2[at] += g * g
    return weights(slice(0, SLOTS)), -z[SLOTS] / ((BETA + np.sqrt(g2[SLOTS])) / ALPHA)


def best_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least loss, by golden section over its logarithm."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.log(_softmax(logits / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean()
    low, high, ratio = -2.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(docs: DataFrame, trainable: Column) -> Model | None:
    """A model from the rows of ``docs`` (``doc_id``, ``text``, ``lang``) that are ``trainable`` and
    have a ``lang``; None without such rows."""
    known = docs.where(trainable & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    df, n = document_frequencies(known)
    per = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    if not per:
        return None
    rates = docs.sparkSession.createDataFrame(
        [(k, round(1_000_000 * min(1.0, PER_LANGUAGE / c))) for k, c in sorted(per.items())], "lang string, rate bigint"
    )
    draw = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1_000_000))
    # A row per language, which the driver holds anyway.
    drawn = known.join(F.broadcast(rates), "lang").where((draw < F.col("rate")) & (F.length("text") <= MAX_TRAIN_CHARS))
    sample = sorted((r.doc_id is None, r.doc_id or 0, r.text, r.lang) for r in drawn.collect())
    languages = sorted(per)
    idf = np.log((n + 1) / (df + 1)) + 1e-3
    y = np.array([languages.index(r[3]) for r in sample], dtype=np.int64)
    rows = [vector(r[2], idf) for r in sample]
    held = np.arange(len(y)) % 5 == 0 if len(y) > 20 else np.zeros(len(y), dtype=bool)
    w, bias = follow_the_leader([r for r, h in zip(rows, held) if not h], y[~held], len(languages))
    logits = np.array([x @ w[at] + bias for (at, x), h in zip(rows, held) if h]).reshape(-1, len(languages))
    return Model(languages, idf.astype(np.float32), w.astype(np.float32), bias.astype(np.float32), best_temperature(logits, y[held]))


def predict(model: Model | None, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    languages, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    for i, t in enumerate(texts):
        if model is None or not t or not _LETTERS.search(t):
            continue
        v = counts_of(t) * model.idf
        p = _softmax((v @ model.weights / max(np.linalg.norm(v), 1e-12) + model.bias) / model.temperature)
        best = int(np.argmax(p))
        languages[i], score[i] = model.languages[best], p[best]
    return languages, score


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, from ``text`` alone.

    A null text or one without a letter has ``und`` and 0, as has every text without a model; of
    languages with the same score the first by name wins. Repeated rows count each, columns with the
    new names are replaced, an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                names, score = predict(shared.value, part.column("text").to_pylist())
                extra = [pa.array(names, pa.string()), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *extra], [*part.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)
