"""Near-duplicate documents by bottom-k sketches.

The set of a document holds the hashes of its distinct word shingles. Its sketch is the ``k``
smallest of these hashes, all from one hash function. The sketches of two sets also give the sketch
of their union, and the share of that sketch which lies in both sets estimates their similarity.

1. Documents with equal word sequences are folded into one node.
2. Inverted lists of the retained values say which nodes overlap. Two nodes with similar sets share
   at least ``c`` of their retained values (``overlap``), so they meet in one of the ``k - c + 1``
   rarest values of either; the more frequent values of a node, where passages common to many
   documents end up, are not listed. Lists are also split by set size, since similar sets are of
   similar size.
3. A list names pairs without naming all of them: every member is first paired with a few hubs of
   the list, those most typical of it, and what turns out to be linked needs no further pairs among
   itself. Documents that stay outside in lists of the others, as those do that share no more than
   a long passage, are listed anew by wider sketches, which few of them survive. Those that do are
   paired, in the first list they share, with the others whose parity bitmaps differ in no more bits
   than those of linked sets do. Bitmaps are of sets thinned out by hash to a size at which the bits tell.
4. Pairs pass the union-sketch estimate and then the exact comparison of the full sets.
5. Components of the links.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.llm.graph import components
from corpuscope.llm.textarrays import chunks, giving_back, lists, mix, split_words, text_buffer
from corpuscope.session import materialize

#: Retained values of a set, and the share of them that two linked sets have in common at least: with
#: a true similarity of 0.75 fewer shared ones have a chance under 1e-9. The second pair serves the
#: documents that the first leaves undecided.
K, OVERLAP = 96, 0.4375
WIDE_K, WIDE_OVERLAP = 512, 0.6
#: Pairs with a lower estimate are dropped unseen; the chance to drop a link is under 1e-8.
MIN_ESTIMATE = 0.45
#: A little over 4/3: sets within a similarity of 0.75 lie in the same or the next size class.
SIZE_STEP = 1.34
#: Hubs per list in each round before the remaining pairs are compared one by one.
HUBS = (4, 4)
#: Numbers of 64 bits in a parity bitmap, and the size up to which sets are not thinned out for it.
PARITY, PARITY_SET = 16, 1024
#: Standard deviations by which bitmaps of linked sets may exceed the mean; the chance to lose one is under 1e-9.
PARITY_SIGMAS = 6.5
#: At most so many bits tell which documents' sets are needed (16 MB).
MAX_FILTER_BITS = 1 << 27

#: Values are stored as signed numbers; with this bit flipped they keep the order of the hashes.
_TOP_BIT = np.uint64(1 << 63)
_MULTIPLIERS = mix(np.arange(11, 111, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(words, width: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles."""
    h, bounds = words.hashes, words.bounds
    full = np.zeros(max(len(h) - width + 1, 0), dtype=np.uint64)
    for j in range(width):
        full += h[j : j + len(full)] * _MULTIPLIERS[j]
    full = mix(full)
    for s, e in zip(bounds[:-1], bounds[1:]):
        if e - s >= width:
            yield np.unique(full[s : e - width + 1])
        elif e > s:
            whole = (h[s:e] * _MULTIPLIERS[: e - s]).sum(keepdims=True)
            yield mix(whole + _MULTIPLIERS[width + e - s])
        else:
            yield np.zeros(0, np.uint64)


def _key(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _sketcher(k: int, width: int, bitmap=None, bits: int = 0):
    """Rows with sketches; with a ``bitmap``, rows of the texts it names with their full sets."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                if bitmap is not None:
                    slot = part.column("slot").to_numpy(zero_copy_only=False).astype(np.int64)
                    chosen = (bitmap.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1
                    part = part.filter(pa.array(chosen.astype(bool)))
                    if not part.num_rows:
                        continue
                words = split_words(*text_buffer(part.column("text")))
                sets = list(shingle_sets(words, width))
                keys = [_key(words.hashes[s:e]) for s, e in zip(words.bounds[:-1], words.bounds[1:])]
                kept = sets if bitmap is not None else [x[:k] for x in sets]
                values = (np.concatenate(kept) if kept else np.zeros(0, np.uint64)) ^ _TOP_BIT
                out = [pa.array(keys, pa.binary()), lists(values, np.array([len(x) for x in kept]))]
                if bitmap is not None:
                    yield pa.RecordBatch.from_arrays(out, ["key", "values"])
                else:
                    sizes = pa.array([len(x) for x in sets], pa.int64())
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), sizes, *out], ["doc_id", "n", "key", "values"])

    return sketch


def estimate(k: int) -> Column:
    """Similarity of the sketches ``x`` and ``y`` from the sketch of their union."""
    union = F.slice(F.sort_array(F.array_union("x", "y")), 1, k)
    both = F.array_intersect(F.array_intersect(union, F.col("x")), F.col("y"))
    return F.size(both) / F.size(union)


def _attach(pairs: DataFrame, values: DataFrame) -> DataFrame:
    left = values.select(F.col("node").alias("a"), F.col("values").alias("x"))
    right = values.select(F.col("node").alias("b"), F.col("values").alias("y"))
    return pairs.join(left, "a").join(right, "b")


def _positions(nodes: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of the slots in ``nodes``, put together by Spark."""
    rows = (
        nodes.select(F.bitmap_bucket_number("slot").alias("bucket"), F.bitmap_bit_position("slot").alias("bit"))
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
        .collect()
    )
    out = np.zeros((bits + 2 * 32768) // 8, dtype=np.uint8)
    for bucket, block in ((r.bucket, r.bits) for r in rows):
        at = (bucket - 1) * 4096 if bucket else 0
        out[at : at + 4096] |= np.frombuffer(bytes(block), dtype=np.uint8)
    return out


def near_duplicates(docs: DataFrame, threshold: float = 0.75, width: int = 5, k: int = K) -> DataFrame:
    """Components of documents with similar word sets.

    ``docs`` needs ``doc_id`` (bigint) and ``text``; other columns are ignored. Per row: ``doc_id``,
    ``n_shingles``, ``component_id`` (the smallest ``doc_id`` reachable through links), ``kept``
    (``doc_id`` is ``component_id``).

    A link joins two sets with an intersection of at least ``threshold`` of their union. A null or
    blank text has an empty set, which links with nothing; a text of fewer than ``width`` words is
    one shingle. Rows that repeat a ``doc_id`` are documents of their own with the same fate as
    their copies. A null ``doc_id`` is never a ``component_id`` unless all ids of its component are
    null, and such a row is kept then only. An empty table gives no rows."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = source.mapInArrow(giving_back(_sketcher(k, width)), "doc_id bigint, n bigint, key binary, values array<bigint>")
    rows = materialize(made.withColumn("row", F.monotonically_increasing_id()), "sketches")
    nodes = rows.where("n > 0").groupBy("key").agg(F.min("row").alias("node"))
    sketches = rows.join(nodes.select(F.col("node").alias("row")), "row", "left_semi")
    sketches = sketches.select(F.col("row").alias("node"), "doc_id", "n", "values")

    members = _lists(sketches, k, OVERLAP, threshold)
    wanted = members.select("node").distinct()
    candidates = materialize(sketches.join(wanted, "node", "left_semi").select("node", "doc_id", "values"), "sketches")
    sets = _full_sets(source, candidates, nodes, width)

    def verified(pairs: DataFrame) -> DataFrame:
        likely = _attach(pairs, candidates).where(estimate(k) >= MIN_ESTIMATE).select("a", "b")
        exact = _attach(likely, sets).select("a", "b", F.size(F.array_intersect("x", "y")).alias("i"), (F.size("x") + F.size("y")).alias("s"))
        exact = exact.where(F.col("i") * 100 >= F.lit(round(threshold * 100)) * (F.col("s") - F.col("i")))
        return exact.select("a", "b")

    roots, tried = None, None
    for hubs_per_list in (*HUBS, None):
        if hubs_per_list is None:
            undecided = _undecided(members, roots).select("node").distinct()
            wide = sets.join(undecided, "node", "left_semi").withColumn("n", F.size("values").cast("bigint"))
            members = _distinct_lists(_lists(wide.withColumn("values", F.slice("values", 1, WIDE_K)), WIDE_K, WIDE_OVERLAP, threshold))
            # Bitmaps are for the lists of this round only; one row per node and level, read by all its lists.
            members = _with_earlier(members).withColumn("level", _level(F.col("c")))
            members = members.join(_parity(wide, members), ["node", "level"])
        state = _undecided(members, roots)
        hubs = state if roots is None else state.where("root <> top_root")
        if hubs_per_list:
            share = F.pmod(F.xxhash64("node"), F.lit(hubs_per_list))
            hubs = hubs.groupBy("list", share.alias("share")).agg(
                F.max(F.struct("typical", "node", "n", "root", "place", "leads")).alias("p")
            )
            hubs = hubs.select("list", "p.*")
        bits = [] if hubs_per_list else [*_BITS, "earlier"]
        hubs = hubs.select("list", *[F.col(c).alias(f"hub_{c}") for c in ("node", "n", "root", "place", "leads", *bits)])
        may_link = _may_link(threshold, k) if hubs_per_list else _may_link(threshold, WIDE_K) & _once() & _few_differ(threshold) & _first_shared()
        pairs = _meetings(state, hubs, may_link).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        if roots is not None and pairs.isEmpty():
            continue
        found = materialize(verified(pairs), "links")
        if roots is None:
            roots = components(found)
        elif not found.isEmpty():
            # What was linked before is linked to its root already.
            roots = components(found.unionByName(roots.select(F.col("root").alias("a"), F.col("node").alias("b"))))
    return _verdicts(rows, nodes, roots)


def _lists(sketches: DataFrame, k: int, overlap: float, threshold: float) -> DataFrame:
    """``(list, node, n, typical, place, leads, c)``: which nodes meet in which inverted list, ``c`` being
    the size class that the list is for.

    Two linked nodes share a number of retained values that is certain where both sketches hold the
    whole sets, and all but certain otherwise; so the first value they share, by rarity, is among
    the rarest of either: all values but that number, and one. ``place`` is the value's place by
    rarity in its set. Of two sets the smaller shares more of its values, so the first they share
    comes early enough in it to have ``leads``."""
    inverted = sketches.select("node", "n", F.explode("values").alias("v"))
    shared = inverted.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    by_node = Window.partitionBy("node")
    certain = F.ceil(F.lit(round(threshold * 100)) * F.col("n") / 100)
    size = F.least("n", F.lit(k))
    likely = F.greatest(F.lit(1), F.ceil(F.lit(overlap) * size))
    whole = F.col("n") <= F.lit(threshold * k)
    needed = F.when(whole, certain).otherwise(likely)
    as_smaller = F.when(whole, F.ceil(F.lit(2 * threshold / (1 + threshold) - 1e-9) * F.col("n"))).otherwise(likely)
    listed = (
        inverted.join(shared, "v")
        .withColumn("seen", F.count(F.lit(1)).over(by_node))
        .withColumn("rank", F.row_number().over(by_node.orderBy("df", "v")))
        # The more of its values a node has in common with many others, the more typical it is.
        .withColumn("typical", F.sum("df").over(by_node) / size)
        .withColumn("place", size - F.col("seen") + F.col("rank"))
        .where(F.col("place") <= size - needed + 1)
        .withColumn("leads", F.col("place") <= size - as_smaller + 1)
    )
    size_class = F.floor(F.log("n") / math.log(SIZE_STEP))
    row = ["node", "n", "typical", "place", "leads"]
    listed = listed.select(*row, "v", F.explode(F.array(size_class, size_class + 1)).alias("c"))
    # A shuffle key of one column: the value and the size class in one hash.
    members = materialize(listed.select(F.xxhash64("v", "c").alias("list"), *row, "c"), "lists")
    several = members.groupBy("list").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return materialize(members.join(several, "list", "left_semi"), "lists")


_BITS = [f"bits_{i}" for i in range(PARITY)]


def _level(c: Column) -> Column:
    """By how many halvings the sets of a size class are thinned out for their bitmaps: to some
    ``PARITY_SET`` values at most, so that the bitmaps do not fill up, however large sets are."""
    return F.greatest(F.lit(0), F.ceil((c * math.log(SIZE_STEP) - math.log(PARITY_SET)) / math.log(2))).cast("int")


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bitmap of a set in which every value of its sample flips one bit. What two sets have in common flips
    the same bits. Bit and sample are chosen by different bits of the value."""
    for batch in batches:
        out = np.zeros((batch.num_rows, PARITY * 64), dtype=np.uint8)
        levels = batch.column("level").to_numpy(zero_copy_only=False)
        for i, (level, values) in enumerate(zip(levels, batch.column("values"))):
            x = values.values.to_numpy(zero_copy_only=False).view(np.uint64)
            x = x[(x >> np.uint64(10)) & np.uint64((1 << int(level)) - 1) == 0]
            out[i] = np.bincount((x & np.uint64(PARITY * 64 - 1)).astype(np.int64), minlength=PARITY * 64) & 1
        bits = np.packbits(out, axis=1).view(np.int64)
        columns = [pa.array(np.ascontiguousarray(bits[:, i])) for i in range(PARITY)]
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("level"), *columns], ["node", "level", *_BITS])


def _parity(sets: DataFrame, members: DataFrame) -> DataFrame:
    """``(node, level)`` and the bitmap of the set at each level that one of its lists has."""
    wanted = members.select("node", "level").distinct().join(sets.select("node", "values"), "node")
    schema = ", ".join(["node bigint", "level int", *[f"{b} bigint" for b in _BITS]])
    return materialize(wanted.select("node", "level", "values").mapInArrow(giving_back(_bitmaps), schema), "parity")


def _few_differ(threshold: float) -> Column:
    """Whether the bitmaps of a member and a hub leave room for a link. Two sets with a similarity of
    ``threshold`` differ in no more than ``(1 - threshold) / (1 + threshold)`` of their sizes' sum, and
    whole sets in no more bits than values. Of samples, and of large sets, that is exceeded by chance;
    each bit then differs as the parity of a Poisson number does."""
    differ = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"hub_{b}"))) for b in _BITS), F.lit(0))
    size = float(PARITY * 64)
    values = (F.col("n") + F.col("hub_n")) * (1 - threshold) / (1 + threshold) / F.pow(F.lit(2.0), F.col("level"))
    odd = (1 - F.exp(values * (-2 / size))) / 2
    likely = odd * size + F.sqrt(odd * (1 - odd) * size) * PARITY_SIGMAS + 1
    return differ <= F.when(F.col("level") == 0, F.least(values + 1e-6, likely)).otherwise(likely)


def _meetings(state: DataFrame, hubs: DataFrame, may_link: Column) -> DataFrame:
    """``(a, b)`` per list, member and hub that may be linked."""
    pairs = state.join(hubs, "list").where(may_link)
    return pairs.select(F.least("node", "hub_node").alias("a"), F.greatest("node", "hub_node").alias("b"))


def _with_earlier(members: DataFrame) -> DataFrame:
    """``members`` with the lists in which a node stands with a value before the list's own."""
    before = Window.partitionBy("node").orderBy("place", "list").rowsBetween(Window.unboundedPreceding, -1)
    return materialize(members.withColumn("earlier", F.collect_list("list").over(before)), "lists")


def _first_shared() -> Column:
    """Whether a member and a hub share no earlier list. Values stand in one order in all sets, so it is
    the same list for both, and it is the one in which ``_may_link`` expects linked sets to meet."""
    return ~F.arrays_overlap("earlier", "hub_earlier")


def _once() -> Column:
    """Outside the list's top component, where every member is a hub too, each pair in one order only."""
    return (F.col("root") == F.col("top_root")) | (F.col("node") < F.col("hub_node"))


def _distinct_lists(members: DataFrame) -> DataFrame:
    """``members`` without lists that hold the same nodes as another one. Of values in the same sets the
    smallest comes first in all of them, which is where two of these sets first meet."""
    of_list = members.groupBy("list").agg(
        F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("nodes"), F.sum("place").alias("places")
    )
    first = of_list.groupBy("size", "nodes").agg(F.min(F.struct("places", "list")).alias("p")).select("p.list")
    return materialize(members.join(first, "list", "left_semi"), "lists")


def _may_link(threshold: float, k: int) -> Column:
    """Whether a member and a hub of a list may be linked and meet here first, by their components,
    their sizes and the value's places in them."""
    n, m = F.col("n"), F.col("hub_n")
    smaller = (n < m) | ((n == m) & (F.col("node") < F.col("hub_node")))
    # If this is the first value that they share, the others come after it in both.
    most = 1 + F.least(n - F.col("place"), m - F.col("hub_place"))
    room = (n > k) | (m > k) | (most * (1 + threshold) >= (n + m) * threshold - 1e-6)
    sizes = (n >= threshold * m) & (m >= threshold * n)
    return (F.col("root") != F.col("hub_root")) & sizes & F.when(smaller, F.col("leads")).otherwise(F.col("hub_leads")) & room


def _undecided(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Members of lists that hold several components, with ``root`` and the root of the list's most
    typical member: what is in the same component needs no pairs among itself."""
    if roots is None:
        state = members.withColumn("root", F.col("node"))
    else:
        state = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = state.groupBy("list").agg(
        F.max(F.struct("typical", "root")).alias("top"), F.min("root").alias("low"), F.max("root").alias("high")
    )
    several = several.where("low <> high").select("list", F.col("top.root").alias("top_root"))
    return state.join(several, "list")


def _full_sets(source: DataFrame, candidates: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """Full sets of the candidate nodes, from one more pass over the texts that reads the words of
    those documents only that a bitmap of bounded size names."""
    spark = source.sparkSession
    bits = 1 << min(MAX_FILTER_BITS.bit_length() - 1, max(16, (16 * candidates.count()).bit_length()))
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    bitmap = spark.sparkContext.broadcast(_positions(candidates.select((slot + 1).alias("slot")), bits))
    named = source.select("text", slot.alias("slot"))
    made = named.mapInArrow(giving_back(_sketcher(0, width, bitmap, bits)), "key binary, values array<bigint>")
    keys = nodes.join(candidates.select("node"), "node", "left_semi")
    made = made.join(keys, "key")
    return materialize(made.dropDuplicates(["node"]).select("node", "values"), "sets")


def _verdicts(rows: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows with the smallest id of their component; no row but a group's summary meets a hot key
    unaggregated."""
    group = nodes.join(roots, "node", "left").select("key", F.coalesce("root", "node").alias("root"))
    least = rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"))
    per_key = group.join(least, "key")
    per_root = per_key.groupBy("root").agg(F.min("least").alias("component_id"))
    named = per_key.join(per_root, "root").select("key", "component_id")
    out = rows.join(named, "key", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )
