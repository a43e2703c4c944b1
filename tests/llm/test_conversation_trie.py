"""The trie against one built node by node, over all of its shards' sizes."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscope.llm import conversation_trie
from corpuscope.llm.parentheses import Parentheses, subtree_sums

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def by_hand(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            own.setdefault(conv, []).append(((turn is not None, turn or 0), role, digest, text))
    trie = {(): []}
    for conv in own:
        own[conv].sort(key=lambda t: t[:3])
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 4
        seq = [(r, t) for _, r, _, t in own.get(conv - int(math.fmod(conv, 20)), [])[:h] + turns[h:]]
        for d in range(len(seq) + 1):
            trie.setdefault(tuple(seq[:d]), []).append((conv, len(seq)))
    out = set()
    saved = {k: (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0 for k, m in trie.items()}
    children = {k: [c for c in trie if len(c) == len(k) + 1 and c[:-1] == k] for k in trie}
    for k, m in trie.items():
        under = [x for x in trie if x[: len(k)] == k]
        ends = ",".join(map(str, sorted(c for c, n in m if n == len(k))))
        up = min((c for c, _ in trie[k[:-1]]), default=None) if k else None
        out.add((
            min((c for c, _ in m), default=None), len(k), up, len(m), len(children[k]),
            sum(not children[x] for x in under), sum(saved[x] for x in under), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out if own else set()


def rows_of(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def made(spark, rows, shard=conversation_trie.SHARD, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    df = df.withColumns({c: F.lit(None).cast("string") for c in ("key", "path", "words", "base", "head", "depth", "t")})
    return rows_of(conversation_trie.prefix_trie(conversation_trie.conversations(df), shard))


@pytest.mark.parametrize("shard", [1, 7, 1 << 18])
def test_random_conversations(spark, shard):
    rng = random.Random(shard)
    rows = [
        (c, rng.choice([None, *range(6)]), rng.choice(["user", "user", None]), rng.choice(["a b", "a b", "c", "", None, "d e f"]))
        for c in [rng.randrange(-30, 70) for _ in range(250)] + [5] * 20
    ]
    assert made(spark, rows, shard) == by_hand(rows)


def test_one_conversation_over_and_over(spark):
    """Equal conversations go through many shards; their common spine and its ends are merged."""
    rows = [(20 * c, t, "user", f"turn {t}") for c in range(300) for t in range(3)] + [(7, 0, None, None), (None, 0, "user", "x")]
    got = made(spark, rows, shard=40, parts=4)
    assert got == by_hand(rows)
    assert {(r[1], r[3]) for r in got} >= {(0, 301), (3, 300)}


def test_nulls_repeats_and_nothing(spark):
    rows = [(1, 0, "user", "x y"), (1, 0, "user", "x y"), (2, None, None, None), (2, 1, "a", "b" * 100_000), (41, 0, "u", "z"), (None, None, None, None)]
    assert made(spark, rows) == by_hand(rows)
    assert made(spark, []) == set()
    assert made(spark, [(None, 0, "user", "x")]) == set()


def test_given_table(spark, tables):
    df = spark.read.parquet(f"{tables}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(conversation_trie.prefix_trie(conversation_trie.conversations(df), 100)) == by_hand(rows)


def test_brackets():
    """Closing brackets, parents and subtree sums of random trees against plain walks."""
    rng = np.random.default_rng(0)
    for n in (1, 2, 40, 3000):
        for deep in (0.2, 0.9, 1.0):
            depth = [0]
            for _ in range(n - 1):
                depth.append(depth[-1] + 1 if rng.random() < deep else int(rng.integers(1, depth[-1] + 2)))
            tree = Parentheses(np.array(depth))
            sizes, parent, stack = np.ones(n, int), [-1] * n, []
            for v, d in enumerate(depth):
                del stack[d:]
                parent[v] = stack[-1] if stack else -1
                stack.append(v)
            for v in range(n - 1, 0, -1):
                sizes[parent[v]] += sizes[v]
            assert ((tree.findclose() - tree.open + 1) // 2 == sizes).all()
            assert tree.parents().tolist() == parent
            values = rng.integers(0, 100, n)
            assert subtree_sums(values, sizes).tolist() == [values[v : v + s].sum() for v, s in enumerate(sizes)]
