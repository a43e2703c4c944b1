"""The prefix trie of conversations: what prefix sharing saves.

Conversations are rows of turn digests, 16 bytes a turn, and sorted by these rows and their ids, so
that conversations with a common beginning lie side by side, equal ones by id, and a beginning that a
third of them share is spread over as many tasks as any other rows. Every task encodes its stretch of
the trie, in shards of bounded size, as balanced parentheses (``parentheses``): ``findclose`` delimits
the subtree of a node, the rank of leaf pairs counts its leaves, cumulative arrays in preorder give
its members and its savings.

Only the prefixes of the first and the last conversation of a shard can go on in another shard. These
spines, twice the longest conversation per shard at most, are merged by key; all other nodes are
complete. The merged spine is a small trie of its own and goes through the same encoding.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.llm.parentheses import Parentheses, subtree_sums
from corpuscope.session import materialize

#: Turns or conversations in one shard, and ids in one piece of a spine node's list of ends.
SHARD = 1 << 18
ENDS = 1 << 14
#: A merged spine of at most so many nodes (some 10 MB) is broadcast.
BROADCAST_NODES = 200_000

_NONE = np.iinfo(np.int64).max
_EMPTY = hashlib.sha256(b"").hexdigest()
_DIGEST = 16
_WORD = r"[^\x20\x09-\x0D]+"

_NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
_OUT = pa.schema(
    [("kind", pa.int32()), ("key", pa.binary()), ("parent_key", pa.binary()), ("words", pa.int64())]
    + [(n, pa.int64()) for n in _NODE]
    + [("ends", pa.string())]
)
_OUT_DDL = "kind int, key binary, parent_key binary, words bigint, " + ", ".join(f"{n} bigint" for n in _NODE) + ", ends string"
_NODE_ROW, _SPINE_ROW, _ENDS_ROW = 0, 1, 2


def conversations(turns: DataFrame, group: int = 20) -> DataFrame:
    """``(conv_id, path, words)``: conversations whose first turns are those of their group's first.

    Conversation ``c`` begins with the first ``crc32(c) % 4`` turns of conversation ``c - c % group``
    and goes on with its own turns after as many. ``path`` is the turns' digests one after the
    other, ``words`` the words of each turn. Turns go by ``turn`` (null first), then ``role``, then
    the digest; a null role or text is empty. One conversation is one row."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role), F.lit(":"), role, text).cast("binary"), 256)
    conv = F.col("conv_id").cast("bigint")
    rows = turns.where(conv.isNotNull()).select(
        conv.alias("conv_id"),
        (conv - conv % group).alias("base"),
        F.struct(
            F.col("turn").cast("bigint").alias("turn"),
            role.alias("role"),
            F.unhex(F.substring(digest, 1, 2 * _DIGEST)).alias("digest"),
            F.regexp_count(text, F.lit(_WORD)).alias("words"),
        ).alias("t"),
    )
    # Both the conversations and their groups are put together by one exchange.
    own = rows.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    first = F.when(F.col("conv_id") == F.col("base"), F.slice("t", 1, 3))
    own = own.withColumn("head", F.max(first).over(Window.partitionBy("base")))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    kept = F.slice("t", h + 1, F.size("t"))
    rebuilt = own.select("conv_id", F.concat(F.slice(F.coalesce("head", F.slice("t", 1, 0)), F.lit(1), h), kept).alias("t"))
    return rebuilt.select(
        "conv_id",
        F.unhex(F.array_join(F.transform("t", lambda x: F.hex(x.digest)), "")).alias("path"),
        F.transform("t", lambda x: x.words).alias("words"),
    )


class Shard:
    """The trie of a stretch of sorted conversations."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, digests: np.ndarray, words: np.ndarray):
        """``digests``, two numbers a turn, and ``words`` lie one conversation after the other."""
        n = len(ids)
        self.ids = ids
        begin = np.cumsum(sizes) - sizes
        level = np.arange(len(digests)) - np.repeat(begin, sizes)
        # How many first turns each conversation shares with the one before it.
        owner = np.repeat(np.arange(n), sizes)
        before = np.maximum(owner - 1, 0)
        same = (owner > 0) & (level < sizes[before])
        same[same] = (digests[same] == digests[(begin[before] + level)[same]]).all(axis=1)
        shared = sizes.copy()
        np.minimum.at(shared, owner[~same], level[~same])
        if n:
            shared[0] = 0
        opened = level >= shared[owner]
        self.turn = np.append(-1, np.flatnonzero(opened))  # the turn that a node ends with
        self.tree = Parentheses(np.append(0, level[opened] + 1))
        self.parent = self.tree.parents()
        self.words = np.append(0, words[opened])
        self.digests = digests
        last = np.cumsum(sizes - shared)  # the node in which each conversation ends
        self.first_end = np.searchsorted(last, np.arange(len(self.turn)))
        self.n_ends = np.bincount(last, minlength=len(self.turn))
        close = self.tree.findclose()
        self.sizes = (close - self.tree.open + 1) // 2
        self.leaves = self.tree.leaves_before[close] - self.tree.leaves_before[self.tree.open]
        self.members = subtree_sums(self.n_ends, self.sizes)
        self.spine = self._spine(int(sizes[0]), int(last[-1]))
        own = np.where(self.spine, 0, (self.members - 1) * self.words)
        self.saved = subtree_sums(own, self.sizes)
        self.least = self._least()

    def _spine(self, first: int, last: int) -> np.ndarray:
        out = np.zeros(len(self.turn), dtype=bool)
        out[: first + 1] = True
        while last >= 0 and not out[last]:
            out[last] = True
            last = self.parent[last]
        return out

    def _least(self) -> np.ndarray:
        """The smallest member of every node, from the deepest level up."""
        out = np.full(len(self.turn), _NONE)
        ended = self.n_ends > 0
        out[ended] = self.ids[self.first_end[ended]]
        order = np.argsort(self.tree.depth, kind="stable")
        edges = np.searchsorted(self.tree.depth[order], np.arange(1, self.tree.depth.max() + 2))
        for s, e in zip(edges[-2::-1], edges[:0:-1]):
            np.minimum.at(out, self.parent[order[s:e]], out[order[s:e]])
        return out

    def keys(self) -> dict[int, bytes]:
        """Keys of the spine's nodes: a chain of hashes over the digests from the root on."""
        out: dict[int, bytes] = {}
        for v in np.flatnonzero(self.spine).tolist():  # preorder: parents come first
            chain = out[int(self.parent[v])] + self.digests[self.turn[v]].tobytes() if v else b""
            out[v] = hashlib.sha256(chain).digest()[:_DIGEST]
        return out

    def ends_of(self, v: int) -> list[str]:
        s, n = int(self.first_end[v]), int(self.n_ends[v])
        return [",".join(map(str, self.ids[i : min(i + ENDS, s + n)].tolist())) for i in range(s, s + n, ENDS)]

    def rows(self) -> Iterator[pa.RecordBatch]:
        """Complete nodes, parts of spine nodes, and the ends of these."""
        keys, spine, parent = self.keys(), self.spine, self.parent
        inner = np.flatnonzero(~spine)
        under = spine[parent[inner]]
        children = np.bincount(parent[1:], minlength=len(spine))
        hashes = [hashlib.sha256(",".join(self.ends_of(v)).encode()).hexdigest() if self.n_ends[v] else _EMPTY for v in inner.tolist()]
        yield _batch(
            len(inner),
            kind=_NODE_ROW,
            parent_key=[keys[p] if u else None for p, u in zip(parent[inner].tolist(), under)],
            conv_id=self.least[inner],
            depth=self.tree.depth[inner],
            parent_conv_id=[None if u else x for x, u in zip(self.least[parent[inner]].tolist(), under)],
            n_convs=self.members[inner],
            n_children=children[inner],
            n_leaves=self.leaves[inner],
            saved_tokens=self.saved[inner],
            ends=hashes,
        )
        top = inner[under]  # complete subtrees that hang on the spine
        hanging = np.zeros((3, len(spine)), dtype=np.int64)
        for row, values in zip(hanging, (np.ones(len(top), np.int64), self.leaves[top], self.saved[top])):
            np.add.at(row, parent[top], values)
        nodes = np.flatnonzero(spine)
        yield _batch(
            len(nodes),
            kind=_SPINE_ROW,
            key=[keys[v] for v in nodes.tolist()],
            parent_key=[keys[int(parent[v])] if v else None for v in nodes.tolist()],
            words=self.words[nodes],
            conv_id=self.least[nodes],
            depth=self.tree.depth[nodes],
            n_convs=self.members[nodes],
            n_children=hanging[0, nodes],
            n_leaves=hanging[1, nodes],
            saved_tokens=hanging[2, nodes],
        )
        for v in nodes[self.n_ends[nodes] > 0].tolist():
            pieces, s = self.ends_of(v), int(self.first_end[v])
            first = self.ids[s : s + int(self.n_ends[v]) : ENDS]
            yield _batch(len(pieces), kind=_ENDS_ROW, key=[keys[v]] * len(pieces), conv_id=first, ends=pieces)


def _batch(n: int, **columns) -> pa.RecordBatch:
    columns["kind"] = np.full(n, columns["kind"], dtype=np.int32)
    arrays = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _OUT]
    return pa.RecordBatch.from_arrays(arrays, schema=_OUT)


def _encoder(shard: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        weight = 0

        def run() -> Iterator[pa.RecordBatch]:
            ids, sizes, digests, words = (np.concatenate(x) for x in zip(*held))
            yield from Shard(ids, sizes, digests, words).rows()

        for batch in batches:
            at = 0
            sizes = batch.column("words").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            cost = np.cumsum(sizes + 1)
            while at < len(sizes):
                spent = cost[at - 1] if at else 0
                end = max(int(np.searchsorted(cost, spent + shard - weight, "right")), at + 1)
                part = batch.slice(at, end - at)
                data = np.frombuffer(b"".join(part.column("path").to_pylist()), dtype=np.uint64).reshape(-1, 2)
                words = part.column("words").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                held.append((part.column("conv_id").to_numpy(), sizes[at:end], data, words))
                weight += int(cost[end - 1] - spent)
                at = end
                if weight >= shard:
                    yield from run()
                    held.clear()
                    weight = 0
        if held:
            yield from run()

    return encode


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole figures of the spine's nodes from their merged parts."""
    rows = [r for b in batches for r in b.to_pylist()]
    if not rows:
        return
    below: dict = {}
    for r in rows:
        below.setdefault(r["parent_key"], []).append(r)
    order, stack = [], list(below[None])
    while stack:
        r = stack.pop()
        order.append(r)
        stack += below.get(r["key"], [])
    tree = Parentheses(np.array([r["depth"] for r in order]))
    sizes = (tree.findclose() - tree.open + 1) // 2
    parent = tree.parents()
    get = lambda name: np.array([r[name] for r in order], dtype=np.int64)
    least, members = get("conv_id"), get("n_convs")
    children = get("n_children") + np.bincount(parent[1:], minlength=len(order))
    out = {
        "conv_id": least,
        "depth": tree.depth,
        "parent_conv_id": [None if p < 0 else int(least[p]) for p in parent.tolist()],
        "n_convs": members,
        "n_children": children,
        "n_leaves": subtree_sums(get("n_leaves") + (children == 0), sizes),
        "saved_tokens": subtree_sums(get("saved_tokens") + (members - 1) * get("words"), sizes),
    }
    yield pa.RecordBatch.from_arrays(
        [pa.array([r["key"] for r in order], pa.binary()), *(pa.array(out[n], pa.int64()) for n in _NODE)], ["key", *_NODE]
    )


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash per key over its sorted pieces, read as a stream."""
    key, state = None, None
    made: list[tuple] = []
    for batch in batches:
        for k, piece in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
            if k != key:
                if state is not None:
                    made.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        if len(made) > 1000:
            yield _hashes(made)
            made = []
    if state is not None:
        made.append((key, state.hexdigest()))
    yield _hashes(made)


def _hashes(made: list[tuple]) -> pa.RecordBatch:
    keys, ends = zip(*made) if made else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ends, pa.string())], ["key", "ends_sha256"])


def prefix_trie(rebuilt: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row per distinct sequence of first turns of ``conversations``: ``conv_id`` (its smallest
    member), ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` and ``ends_sha256`` of the ids of the conversations that end there.

    Members of a node begin with its sequence; its savings are, over its subtree, the words of each
    node's last turn times its members but one. A conversation without turns ends at the root;
    without conversations there are no rows. Equal conversations are members each."""
    order = ["path", "conv_id"]
    ranged = rebuilt.repartitionByRange(*order).sortWithinPartitions(*order)
    made = materialize(ranged.mapInArrow(_encoder(shard), _OUT_DDL), "trie-shards")
    parts = made.where(F.col("kind") == _SPINE_ROW).groupBy("key").agg(
        *[F.min(c).alias(c) for c in ("parent_key", "words", "conv_id", "depth")],
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    numbers = ", ".join(f"{n} bigint" for n in _NODE)
    merged = parts.repartition(1).mapInArrow(_merge, f"key binary, {numbers}")
    ends = made.where(F.col("kind") == _ENDS_ROW).select("key", "conv_id", "ends")
    hashed = ends.repartition("key").sortWithinPartitions("key", "conv_id").select("key", "ends")
    hashed = hashed.mapInArrow(_hash_ends, "key binary, ends_sha256 string")
    spine = materialize(merged.join(hashed, "key", "left").fillna(_EMPTY, "ends_sha256"), "trie-spine")
    names = spine.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    if spine.count() <= BROADCAST_NODES:
        names = F.broadcast(names)
    nodes = made.where(F.col("kind") == _NODE_ROW).withColumnRenamed("ends", "ends_sha256")
    columns: list[str | Column] = [*_NODE, "ends_sha256"]
    inside = nodes.where("parent_key IS NULL").select(columns)
    hanging = nodes.where("parent_key IS NOT NULL").join(names, "parent_key")
    hanging = hanging.withColumn("parent_conv_id", F.col("above")).select(columns)
    return spine.select(columns).unionByName(inside).unionByName(hanging)
