"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

The network reads windows of words. A word's input is an embedding of the word next to the mean
embedding of its character n-grams, both in hashed tables of fixed size; attention pools the states
of both directions. A document's score is that of its worst window, over all overlapping windows of
the whole text. Everything is numpy: training on a bounded sample of labelled documents in one
task, scoring in Arrow batches wherever the documents are.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.llm.bpe import ragged
from corpuscope.llm.textarrays import BLOCK, FOLD, PUNCTUATION, Words, chunks, giving_back, mix, split_words, text_buffer

#: Words in a window and between the beginnings of two windows.
WINDOW, STRIDE = 32, 16
#: Hashed rows of each embedding table, and the widths of embeddings and states.
SLOTS, WIDTH, HIDDEN = 1 << 14, 8, 8
#: Training documents per class at most (in expectation; the draw is by hash), and their longest text.
PER_CLASS, MAX_TRAIN_CHARS = 1200, 20_000
EPOCHS, RATE, BATCH = 8, 0.01, 64
#: Windows by which a text that isn't toxic teaches in each round.
HARD_WINDOWS = 3
#: Words and n-grams of fewer training texts have no embedding, so that none is learnt by heart.
MIN_TEXTS = 6
#: Windows that are scored at a time.
HEIGHT = 1024
_UNIT = float(1 << 20)
_SEED = 7
#: Bytes of text that are scored at a time.
_CHUNK = 1 << 18


class Coded:
    """The words of a batch of texts by distinct word, with rows of the embedding tables."""

    def __init__(self, texts: pa.Array):
        buf, offsets = text_buffer(texts)
        words: Words = split_words(buf, offsets, FOLD, PUNCTUATION)
        distinct, first, self.word = np.unique(words.hashes, return_index=True, return_inverse=True)
        self.bounds = words.bounds
        self.row = (distinct & np.uint64(SLOTS - 1)).astype(np.int64)
        size = words.ends[first] - words.starts[first]
        self.grams, self.gram_bounds = _grams(FOLD[buf[ragged(words.starts[first], size)]], size)


def _grams(letters: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of the 3- and 4-grams of words with a mark before and after each, per word."""
    wide = size + 2
    ends = np.cumsum(wide)
    c = np.full(ends[-1] if len(ends) else 0, 3, dtype=np.uint64)
    c[ends - wide] = 2
    inner = ragged(ends - wide + 1, size)
    c[inner] = letters
    rows, owners = [], []
    for n in (3, 4):
        per = np.maximum(wide - n + 1, 1 if n == 3 else 0)  # a one-letter word has one 3-gram
        at = ragged(ends - wide, per)
        h = np.full(len(at), n, dtype=np.uint64)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + c[at + j]
        rows.append((mix(h) & np.uint64(SLOTS - 1)).astype(np.int64))
        owners.append(np.repeat(np.arange(len(size)), per))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(rows)[order], np.searchsorted(owner[order], np.arange(len(size) + 1))


def window_starts(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows, and the text each belongs to. A text without words has none."""
    n = np.diff(bounds)
    count = np.where(n > WINDOW, -(-(n - WINDOW) // STRIDE) + 1, (n > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(n)), count)
    return bounds[owner] + STRIDE * (ragged(np.zeros_like(count), count)), owner


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _mean_rows(table: np.ndarray, rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    if not len(rows):
        return np.zeros((len(bounds) - 1, table.shape[1]), np.float32)
    return np.add.reduceat(table[rows], bounds[:-1], axis=0) / np.diff(bounds)[:, None].astype(np.float32)


Params = dict[str, np.ndarray]


def new_params(rng: np.random.Generator) -> Params:
    d, h = 2 * WIDTH, HIDDEN
    draw = lambda *s, scale=0.3: (rng.standard_normal(s) * scale).astype(np.float32)
    p = {"word": draw(SLOTS, WIDTH, scale=0.05), "gram": draw(SLOTS, WIDTH, scale=0.05)}
    for side in "fb":
        p |= {f"wx_{side}": draw(d, 3 * h), f"wb_{side}": np.zeros(3 * h, np.float32), f"u_{side}": draw(h, 3 * h)}
    return p | {"att_w": draw(2 * h, h), "att_b": np.zeros(h, np.float32), "att_v": draw(h), "out_w": draw(2 * h), "out_b": np.zeros(1, np.float32)}


def inputs(p: Params, coded: Coded) -> np.ndarray:
    """One input row per distinct word and a row of zeros for places after the end of a text."""
    x = np.concatenate([p["word"][coded.row], _mean_rows(p["gram"], coded.grams, coded.gram_bounds)], axis=1)
    return np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])


def places(coded: Coded, first: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Input rows of windows, (WINDOW, n), and 1 where a place holds a word."""
    at = first[None, :] + np.arange(WINDOW)[:, None]
    there = at < coded.bounds[owner + 1][None, :]
    pad = len(coded.row)
    rows = np.where(there, np.append(coded.word, pad)[np.minimum(at, len(coded.word))], pad)
    return rows, there.astype(np.float32)


def _product(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``x @ w`` of numbers rounded to multiples of 2**-20. Sums of their products are exact in double
    precision (below 2**13), so a row's result depends neither on the shape nor on the rows around it."""
    return ((np.rint(x * _UNIT).astype(np.float64) @ np.rint(w * _UNIT).astype(np.float64)) / _UNIT**2).astype(np.float32)


def _run(p: Params, side: str, gates: np.ndarray, rows: np.ndarray, mask: np.ndarray, trace: list | None) -> np.ndarray:
    """States of one direction, (WINDOW, n, HIDDEN)."""
    h, n = HIDDEN, rows.shape[1]
    product = _product if trace is None else np.matmul
    state, out, u = np.zeros((n, h), np.float32), np.zeros((WINDOW, n, h), np.float32), p[f"u_{side}"]
    for t in range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1):
        a, b = gates[rows[t]], product(state, u)
        rz = _sigmoid(a[:, : 2 * h] + b[:, : 2 * h])
        r, z = rz[:, :h], rz[:, h:]
        new = np.tanh(a[:, 2 * h :] + r * b[:, 2 * h :])
        keep = 1 - mask[t][:, None] * (1 - z)  # 1 where there is no word
        if trace is not None:
            trace.append((t, state, r, z, new, b[:, 2 * h :], keep))
        state = keep * state + (1 - keep) * new
        out[t] = state
    return out


def forward(p: Params, x: np.ndarray, rows: np.ndarray, mask: np.ndarray, trace: dict | None = None) -> np.ndarray:
    """Logits of windows. A ``trace`` is for training, which needs no exact products."""
    product = _product if trace is None else np.matmul
    sides = {}
    for side in "fb":
        steps = None if trace is None else trace.setdefault(side, [])
        sides[side] = _run(p, side, product(x, p[f"wx_{side}"]) + p[f"wb_{side}"], rows, mask, steps)
    hs = np.concatenate([sides["f"], sides["b"]], axis=2)
    look = np.tanh(product(hs, p["att_w"]) + p["att_b"])
    e = product(look, p["att_v"]) - 1e9 * (1 - mask)
    e = np.exp(e - e.max(axis=0))
    share = e / e.sum(axis=0)
    pooled = (share[:, :, None] * hs).sum(axis=0)
    if trace is not None:
        trace |= {"hs": hs, "look": look, "share": share, "pooled": pooled}
    return product(pooled, p["out_w"]) + p["out_b"][0]


def gradients(p: Params, x: np.ndarray, rows: np.ndarray, mask: np.ndarray, d_logit: np.ndarray, trace: dict) -> tuple[Params, np.ndarray]:
    """Gradients of the weights and of ``x``, for a ``forward`` with ``trace``."""
    h, g = HIDDEN, {}
    hs, look, share = trace["hs"], trace["look"], trace["share"]
    g["out_w"], g["out_b"] = trace["pooled"].T @ d_logit, d_logit.sum(keepdims=True)
    d_pooled = d_logit[:, None] * p["out_w"]
    d_hs = share[:, :, None] * d_pooled
    d_share = (hs * d_pooled).sum(axis=2)
    d_e = share * (d_share - (share * d_share).sum(axis=0))
    g["att_v"] = np.tensordot(look, d_e, ([0, 1], [0, 1]))
    d_look = d_e[:, :, None] * p["att_v"] * (1 - look * look)
    g["att_w"], g["att_b"] = np.tensordot(hs, d_look, ([0, 1], [0, 1])), d_look.sum(axis=(0, 1))
    d_hs += d_look @ p["att_w"].T
    d_x = np.zeros_like(x)
    for side, part in (("f", d_hs[:, :, :h]), ("b", d_hs[:, :, h:])):
        u = p[f"u_{side}"]
        d_u, d_gates = np.zeros_like(u), np.zeros((len(x), 3 * h), np.float32)
        d_state = np.zeros((rows.shape[1], h), np.float32)
        for t, state, r, z, new, b_new, keep in reversed(trace[side]):
            d = d_state + part[t]
            d_new = d * (1 - keep) * (1 - new * new)
            d_z = d * (state - new) * mask[t][:, None] * z * (1 - z)
            d_r = d_new * b_new * r * (1 - r)
            d_a = np.concatenate([d_r, d_z, d_new], axis=1)
            d_b = np.concatenate([d_r, d_z, d_new * r], axis=1)
            d_u += state.T @ d_b
            d_state = d * keep + d_b @ u.T
            np.add.at(d_gates, rows[t], d_a)
        d_gates[-1] = 0
        g[f"u_{side}"], g[f"wx_{side}"], g[f"wb_{side}"] = d_u, x.T @ d_gates, d_gates.sum(axis=0)
        d_x += d_gates @ p[f"wx_{side}"].T
    return g, d_x


class Adam:
    """Adam; of the embedding tables only the known rows in use move."""

    def __init__(self, p: Params, known: dict[str, np.ndarray]):
        self.p, self.known, self.t = p, known, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, g: Params, rows: dict[str, np.ndarray]) -> None:
        self.t += 1
        rate = RATE * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, d in g.items():
            at = rows.get(k, slice(None))
            if k in rows:
                at, d = at[self.known[k][at]], d[self.known[k][at]]
            self.m[k][at] = m = 0.9 * self.m[k][at] + 0.1 * d
            self.v[k][at] = v = 0.999 * self.v[k][at] + 0.001 * d * d
            self.p[k][at] -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)


def _sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, which = np.unique(rows, return_inverse=True)
    out = np.zeros((len(distinct), values.shape[1]), np.float32)
    np.add.at(out, which, values)
    return distinct, out


def log_odds(rows: list[np.ndarray], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed log odds of the classes for each table row, by the texts it occurs in, and whether
    these are enough; if not, 0."""
    seen = np.zeros((2, SLOTS))
    for r, y in zip(rows, toxic):
        seen[int(y), np.unique(r)] += 1
    rates = (seen + 1) / (np.array([[np.sum(toxic == 0)], [np.sum(toxic == 1)]]) + 2)
    known = seen.sum(axis=0) >= MIN_TEXTS
    return (np.log(rates[1] / rates[0]) * known).astype(np.float32), known


def fit(texts: list[str], labels: list[int], clean_weight: float = 1.0) -> Params | None:
    """Weights from labelled texts; None unless both classes are there.

    A label belongs to a text, not to a window: in every round each toxic text teaches by the window
    that looks worst so far, each other text by its worst ones; some are drawn at random from these texts. What looks
    worst at first goes by the log odds of words and n-grams, which also seed the embeddings. A
    fifth of the texts is left out of training to place the threshold, where an error on a text that
    isn't toxic weighs ``clean_weight``."""
    y = np.array(labels)
    if len(set(labels)) < 2:
        return None
    rng = np.random.default_rng(_SEED)
    p = new_params(rng)
    coded = Coded(pa.array(texts, pa.large_string()))
    first, owner = window_starts(coded.bounds)
    if not len(first):
        return None
    held = np.arange(len(y)) % 5 == 4
    grams = np.split(coded.grams, coded.gram_bounds[1:-1]) if len(coded.row) else []
    own = [np.unique(coded.word[s:e]) for s, e in zip(coded.bounds[:-1], coded.bounds[1:])]
    use = np.flatnonzero(~held)
    by_word, known_words = log_odds([coded.row[own[i]] for i in use], y[use])
    by_gram, known_grams = log_odds([np.concatenate([grams[w] for w in own[i]] or [np.zeros(0, np.int64)]) for i in use], y[use])
    p["word"][:, 0], p["gram"][:, 0] = 0.3 * by_word, 0.3 * by_gram
    p["word"][~known_words], p["gram"][~known_grams] = 0, 0
    hint = by_word[coded.row] + _mean_rows(by_gram[:, None], coded.grams, coded.gram_bounds)[:, 0]
    worst = np.concatenate(
        [np.append(hint, -9.0)[places(coded, first[i : i + BLOCK], owner[i : i + BLOCK])[0]].max(axis=0) for i in range(0, len(first), BLOCK)]
    )
    opt = Adam(p, {"word": known_words, "gram": known_grams})
    train_windows = ~held[owner]
    for epoch in range(EPOCHS):
        if epoch > 1:
            worst = score_windows(p, coded, first, owner)
        order = np.lexsort((-worst, owner))
        place = ragged(np.zeros(len(y), np.int64), np.bincount(owner, minlength=len(y)))
        top = order[place < np.where(y[owner[order]] == 1, 1, HARD_WINDOWS)]
        top = top[train_windows[top]]
        spare = np.flatnonzero(train_windows & (y[owner] == 0))
        spare = rng.choice(spare, size=min(len(spare), len(top)), replace=False) if len(spare) else spare
        chosen = rng.permutation(np.concatenate([top, spare]))
        for i in range(0, len(chosen), BATCH):
            some = chosen[i : i + BATCH]
            _step(p, opt, coded, *places(coded, first[some], owner[some]), y[owner[some]])
    scores = np.full(len(y), -20.0)
    np.maximum.at(scores, owner, score_windows(p, coded, first, owner))
    p["shift"] = np.array([_threshold(scores[held], y[held], clean_weight)], np.float32)
    return p


def _step(p: Params, opt: Adam, coded: Coded, rows: np.ndarray, mask: np.ndarray, y: np.ndarray) -> None:
    words, inner = np.unique(rows, return_inverse=True)
    words, inner = words[words < len(coded.row)], inner.reshape(rows.shape)
    sizes = np.diff(coded.gram_bounds)[words]
    gram_rows = coded.grams[ragged(coded.gram_bounds[words], sizes)]
    bounds = np.append(0, np.cumsum(sizes))
    x = np.concatenate([p["word"][coded.row[words]], _mean_rows(p["gram"], gram_rows, bounds)], axis=1)
    x = np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])
    trace: dict = {}
    logit = forward(p, x, inner, mask, trace)
    d_logit = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)
    g, d_x = gradients(p, x, inner, mask, d_logit, trace)
    at = {}
    at["word"], g["word"] = _sums(coded.row[words], d_x[:-1, :WIDTH])
    at["gram"], g["gram"] = _sums(gram_rows, np.repeat(d_x[:-1, WIDTH:] / np.maximum(sizes, 1)[:, None].astype(np.float32), sizes, axis=0))
    opt.step(g, at)


def _threshold(logits: np.ndarray, y: np.ndarray, clean_weight: float) -> float:
    """The middle of the widest gap among the cuts with the least weight of errors."""
    if len(set(y.tolist())) < 2:
        return 0.0
    order = np.argsort(logits)
    s, toxic = logits[order], y[order] == 1
    missed = np.append(0, np.cumsum(toxic))
    refused = clean_weight * (np.sum(~toxic) - np.append(0, np.cumsum(~toxic)))
    edges = np.concatenate([[s[0] - 1], (s[1:] + s[:-1]) / 2, [s[-1] + 1]])
    gaps = np.concatenate([[0], s[1:] - s[:-1], [0]])
    best = np.flatnonzero(missed + refused <= (missed + refused).min() + 1e-9)
    return float(edges[best[np.argmax(gaps[best])]])


def score_windows(p: Params, coded: Coded, first: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Logits of windows, in blocks of ``HEIGHT`` whose last is filled up with copies of its first window:
    sums along an axis go in one order, and a window has one logit wherever it stands."""
    x, out = inputs(p, coded), np.zeros(len(first))
    for i in range(0, len(first), HEIGHT):
        at = np.arange(i, min(i + HEIGHT, len(first)))
        some = np.append(at, np.full(HEIGHT - len(at), i))
        rows, mask = places(coded, first[some], owner[some])
        out[at] = forward(p, x, rows, mask)[: len(at)]
    return out


def score_texts(p: Params | None, texts: pa.Array) -> np.ndarray:
    """A score from 0 to 1 per text; 0 for a text without words."""
    out = np.full(len(texts), -np.inf)
    if p is not None:
        coded = Coded(texts)
        first, owner = window_starts(coded.bounds)
        np.maximum.at(out, owner, score_windows(p, coded, first, owner) - p["shift"][0])
    return 1 / (1 + np.exp(-np.clip(out, -60, 60))) * (out > -np.inf)


def training_sample(docs: DataFrame, labels: DataFrame, trainable: Column, per_class: int = PER_CLASS) -> tuple[DataFrame, float]:
    """``(text, toxic)`` of some ``per_class`` documents of either class, drawn by a hash of the id, and
    how many times as many clean documents stand for one that is drawn as toxic ones do.

    ``trainable`` says, in terms of ``doc_id``, which labels may be used. A document with several
    labels has the largest."""
    known = labels.where(trainable & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1_000_000))
    limit = F.lit(0)
    for kind, n in counts.items():
        limit = F.when(F.col("toxic") == kind, round(1_000_000 * min(1.0, per_class / n))).otherwise(limit)
    # Bounded by the draw, so its ids may come to the driver and be broadcast.
    drawn = [tuple(r) for r in known.where(draw < limit).select("doc_id", "toxic").collect()]
    small = F.broadcast(docs.sparkSession.createDataFrame(drawn, "doc_id bigint, toxic int"))
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(small, "doc_id")
    weight = max(counts.get(0, 0) / per_class, 1.0) / max(counts.get(1, 0) / per_class, 1.0)
    return found.where(F.length("text") <= MAX_TRAIN_CHARS).select("text", "toxic"), weight


def train(docs: DataFrame, labels: DataFrame, trainable: Column) -> Params | None:
    """``fit`` on the training sample, in one task, which is all that such a sample needs."""
    sample, weight = training_sample(docs, labels, trainable)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"text": [], "toxic": []}), *frames])
        # In an order that depends on the texts alone, and mixes the classes.
        texts = sorted(zip(map(_order, rows["text"]), rows["text"], rows["toxic"].astype(int)))
        made = fit([t for _, t, _ in texts], [y for _, _, y in texts], weight)
        yield pd.DataFrame({"params": [pickle.dumps(made)]})

    rows = sample.repartition(1).mapInPandas(giving_back(run), "params binary").collect()
    return pickle.loads(bytes(rows[0].params)) if rows else None


def _order(text: str) -> bytes:
    return hashlib.blake2b(text.encode(), digest_size=8).digest()


def score(docs: DataFrame, params: Params | None, name: str = "score") -> DataFrame:
    """``docs`` with its score as ``name``, from its ``text`` alone. A null, empty or wordless text, and
    any text without a model, has 0; an own column of that name is replaced."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(params)
    docs = docs.drop(name)
    schema = docs.select("*", F.lit(0.0).alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", _CHUNK):
                values = pa.array(score_texts(shared.value, part.column("text")), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, values], [*part.schema.names, name])

    return docs.mapInArrow(giving_back(run), schema)


def toxicity(docs: DataFrame, labels: DataFrame, trainable: Column) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 from a score of 0.5), by a model that learns from
    the rows of ``labels`` (``doc_id``, ``toxic``) that are ``trainable``. Repeated rows are scored
    each; an empty table gives no rows."""
    scored = score(docs, train(docs, labels, trainable))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
