"""Fingerprints of documents as invertible Bloom lookup tables of their paragraphs.

A table has cells of a count, a key and a check; each paragraph digest is added to one cell in each of
three parts. Subtracting the tables of two versions cancels what they share, and peeling (taking out
digests that stand alone in a cell, which sets others free) recovers the digests they don't. All of
it is array expressions within a document's row.

Digests are dealt to slices with a small table each, so that long documents are as cheap per
paragraph as short ones; a slice that can't be peeled is tried again with a larger table.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.functions.rows import bind

#: Where paragraphs end: at line ends and, within a line, after the end of a sentence.
PARAGRAPH = r"\n+|(?<=[.!?])\x20+"
#: Cells per part of the table that is a document's fingerprint.
PRINT_PART = 4
#: Digests of both versions per slice on average, and the cells per part in the first try and the last.
SLICE, FIRST_PART, LAST_PART = 12, 8, 1024
#: Rounds of peeling before a table counts as failed; what can be peeled takes fewer.
_ROUNDS = 10
#: Documents per range of ids when neighbours are looked up, and ranges at most.
RANGE, MAX_RANGES = 2000, 20_000


def digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs."""
    some = F.filter(F.split(text, PARAGRAPH, -1), lambda p: p != "")
    return F.array_distinct(F.transform(some, lambda p: F.xxhash64(p)))


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, wherever and how often it stands in there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(1))


def _items(keys: Column, part: Column) -> Column:
    """Keys with their checks and their cells."""

    def item(k: Column) -> Column:
        h = F.xxhash64(k, part)
        cells = [F.pmod(F.shiftrightunsigned(h, 21 * i), part).cast("int").alias(f"c{i}") for i in range(3)]
        return F.struct(k.alias("key"), _check(k).alias("chk"), *cells)

    return F.transform(keys, item)


def _cell(cnt: Column, key: Column, chk: Column) -> Column:
    return F.struct(cnt.alias("cnt"), key.alias("key"), chk.alias("chk"))


def _in_cell(items: Column, i: int, j: Column) -> Column:
    """Items whose cell in part ``i`` is the ``j``-th of it."""
    return F.filter(items, lambda x: x[f"c{i}"] == j)


def table(items: Column, part: Column) -> Column:
    """The cells of a table with ``part`` cells in each of its three parts."""
    zero = F.lit(0).cast("bigint")

    def cells(some: Column, i: int) -> Column:
        add = lambda c, x: _cell(c["cnt"] + 1, c["key"].bitwiseXOR(x["key"]), c["chk"].bitwiseXOR(x["chk"]))
        one = lambda j: F.aggregate(_in_cell(some, i, j), _cell(zero, zero, zero), add)
        return F.transform(F.sequence(F.lit(0), part - 1), one)

    return _let(items, lambda some: F.concat(*[cells(some, i) for i in range(3)]))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(
        a, b, lambda x, y: _cell(x["cnt"] - y["cnt"], x["key"].bitwiseXOR(y["key"]), x["chk"].bitwiseXOR(y["chk"]))
    )


_LONGS = "array<bigint>"


def peel(cells: Column, part: Column) -> Column:
    """``removed`` and ``added`` digests of a difference of tables, and whether that is ``whole``."""
    none = F.array().cast(_LONGS)

    def take(s: Column) -> Column:
        def alone(sign: int) -> Column:
            single = F.filter(s["cells"], lambda c: (c["cnt"] == sign) & (c["chk"] == _check(c["key"])))
            keys = F.array_distinct(F.transform(single, lambda c: c["key"]))
            return F.transform(_items(keys, part), lambda i: F.struct(F.lit(sign).alias("cnt"), i.alias("i")))

        return F.concat(alone(1), alone(-1))

    def cleared(cells: Column, taken: Column) -> Column:
        out = lambda c, x: _cell(c["cnt"] - x["cnt"], c["key"].bitwiseXOR(x["i"]["key"]), c["chk"].bitwiseXOR(x["i"]["chk"]))
        hit = lambda i, c, j: F.aggregate(F.filter(taken, lambda x: x["i"][f"c{i}"] == j), c, out)
        third = lambda i: F.transform(F.slice(cells, part * i + 1, part), lambda c, j: hit(i, c, j))
        return F.concat(third(0), third(1), third(2))

    def side(taken: Column, sign: int) -> Column:
        return F.transform(F.filter(taken, lambda x: x["cnt"] == sign), lambda x: x["i"]["key"])

    def state(cells: Column, removed: Column, added: Column, live: Column) -> Column:
        return F.struct(cells.alias("cells"), removed.alias("removed"), added.alias("added"), live.alias("live"))

    def turn(s: Column, taken: Column) -> Column:
        return state(
            cleared(s["cells"], taken),
            F.concat(s["removed"], side(taken, 1)),
            F.concat(s["added"], side(taken, -1)),
            F.size(taken) > 0,
        )

    def step(s: Column, _: Column) -> Column:
        return F.when(s["live"], _let(take(s), lambda taken: turn(s, taken))).otherwise(s)

    start = state(cells, none, none, F.lit(True))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(_ROUNDS)), start, step)
    return _let(
        end,
        lambda s: F.struct(
            F.forall(s["cells"], lambda c: (c["cnt"] == 0) & (c["key"] == 0)).alias("whole"),
            s["removed"].alias("removed"),
            s["added"].alias("added"),
        ),
    )


def _slices(keys: Column, root: Column) -> Column:
    """Keys by slice, in two steps, which keeps the work per key to the root of the number of slices."""
    k = lambda x: F.pmod(F.shiftrightunsigned(x, 7), root * root)
    placed = F.transform(keys, lambda x: F.struct(x.alias("key"), k(x).alias("k")))
    some = lambda i: lambda all_: F.filter(all_, lambda x: F.pmod(x["k"], root) == i)
    rough = _let(placed, lambda p: F.transform(F.sequence(F.lit(0), root - 1), lambda i: some(i)(p)))

    def fine(part: Column) -> Column:
        slice_ = lambda j: F.filter(part, lambda x: F.floor(x["k"] / root) == j)
        return F.transform(F.sequence(F.lit(0), root - 1), lambda j: F.transform(slice_(j), lambda x: x["key"]))

    return F.flatten(F.transform(rough, fine))


def difference(a: Column, b: Column) -> Column:
    """Digests only in ``a`` (``removed``) and only in ``b`` (``added``), from their tables, per slice;
    ``tries`` is the largest number of tables that a slice took."""
    n = F.greatest(F.lit(1), F.ceil((F.size(a) + F.size(b)) / SLICE)).cast("int")
    root_of = F.ceil(F.sqrt(n.cast("double"))).cast("int")
    sizes = F.array(*[F.lit(FIRST_PART << i) for i in range(int(math.log2(LAST_PART // FIRST_PART)) + 1)])
    none = F.array().cast(_LONGS)
    first = F.struct(
        F.lit(False).alias("whole"), none.alias("removed"), none.alias("added"), F.lit(0).alias("tries")
    )

    def attempt(x: Column, y: Column, part: Column, tries: Column) -> Column:
        cells = subtract(table(_items(x, part), part), table(_items(y, part), part))
        names = ("whole", "removed", "added")
        return _let(peel(cells, part), lambda r: F.struct(*[r[c].alias(c) for c in names], (tries + 1).alias("tries")))

    def solve(x: Column, y: Column) -> Column:
        retry = lambda s, part: F.when(s["whole"], s).otherwise(attempt(x, y, part, s["tries"]))
        return F.aggregate(sizes, first, retry)

    def joined(parts: Column) -> Column:
        return F.struct(
            F.forall(parts, lambda p: p["whole"]).alias("whole"),
            F.flatten(F.transform(parts, lambda p: p["removed"])).alias("removed"),
            F.flatten(F.transform(parts, lambda p: p["added"])).alias("added"),
            F.array_max(F.transform(parts, lambda p: p["tries"])).alias("tries"),
        )

    parts = _let(root_of, lambda root: F.zip_with(_slices(a, root), _slices(b, root), solve))
    return _let(parts, joined)


def likeness(a: Column, diff: Column) -> Column:
    """Digests in both by digests in either, from one version's digests and the difference; 1 when
    there are none. Null where a slice was not peeled, of which the chance is under 1e-12."""
    either = F.size(a) + F.size(diff["added"])
    both = F.size(a) - F.size(diff["removed"])
    return F.when(diff["whole"], F.when(either == 0, F.lit(1.0)).otherwise(both / either))


def fingerprint(keys: Column) -> Column:
    """The table of a document as a string: count, key and check of each cell in hex."""
    part = F.lit(PRINT_PART)
    cells = F.transform(
        table(_items(keys, part), part), lambda c: F.concat_ws(".", F.hex(c["cnt"]), F.hex(c["key"]), F.hex(c["chk"]))
    )
    return F.array_join(cells, "-")


def _key(h: Column) -> Column:
    return F.struct(F.col("doc_id").alias("i"), h.alias("h"))


def ranged(docs: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``_range``, ``_first`` (whether the row has the smallest key of its range) and
    ``_before`` (the range before it, the last one for the first). Keys are ``doc_id`` and the text's
    hash, in ``_h``; null ids come first. ``keys`` may give the two columns of ``docs`` alone, where
    that is less work than ``docs``.

    Ranges hold about as many keys each, however ids are spread, and ids that many rows share are cut
    by hash. Their beginnings, ``MAX_RANGES`` pairs of numbers at most, travel with the plan."""
    keys = (docs if keys is None else keys).select("doc_id", F.xxhash64("text").alias("_h"))
    n = min(max(keys.count() // RANGE, 1), MAX_RANGES)
    cut = keys.repartitionByRange(n, "doc_id", "_h").withColumn("_p", F.spark_partition_id())
    begin = cut.groupBy("_p").agg(F.min(_key(F.col("_h"))).alias("key")).orderBy("_p").collect()
    firsts = [r["key"].asDict() for r in begin]
    # Two steps, so that a lookup costs the root of the number of ranges.
    step = math.isqrt(len(firsts)) + 1
    tables = [firsts[i : i + step] for i in range(0, len(firsts), step)]
    known = F.from_json(F.lit(json.dumps(tables)), "array<array<struct<i:bigint,h:bigint>>>")
    docs = bind(docs.withColumn("_h", F.xxhash64("text")), _k=_key(F.col("_h")))
    docs = bind(docs, _c=F.greatest(F.size(F.filter(known, lambda t: F.get(t, F.lit(0)) <= F.col("_k"))), F.lit(1)) - 1)
    docs = bind(docs, _f=F.greatest(F.size(F.filter(F.get(known, F.col("_c")), lambda x: x <= F.col("_k"))), F.lit(1)) - 1)
    place = F.col("_c") * step + F.col("_f")
    docs = docs.withColumns(
        {
            "_range": place,
            "_first": F.get(F.get(known, F.col("_c")), F.col("_f")) == F.col("_k"),
            "_before": F.when(place > 0, place - 1).otherwise(F.lit(max(len(firsts) - 1, 0))),
        }
    )
    return docs.drop("_k", "_c", "_f")


def with_next(docs: DataFrame, columns: list[str], keys: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``next_<column>`` of the document with the next larger ``doc_id``; the first's after
    the last. Null ids come before all others, equal ids in the order of their texts' hashes. ``keys``
    as for ``ranged``.

    The first document of a range is also sent to the range before it. Rows that repeat both an id and
    its text stay in one range."""
    seat = lambda r, guest: F.struct(F.col(r).alias("range"), F.lit(guest).alias("guest"))
    seats = F.when(F.col("_first"), F.array(seat("_range", 0), seat("_before", 1))).otherwise(F.array(seat("_range", 0)))
    sent = ranged(docs, keys).select(*docs.columns, "_h", F.explode(seats).alias("_seat"))
    order = Window.partitionBy("_seat.range").orderBy("_seat.guest", "doc_id", "_h")
    led = sent.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    return led.where("_seat.guest = 0").drop("_seat", "_h")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): ``doc_id``, ``n_chars``, ``edited_text`` (the last half
    replaced by as much of the beginning of the next document), ``fingerprint``,
    ``edited_fingerprint``, ``edited_diff`` and ``next_diff`` (the recovered differences to the edited
    text and to the next document), ``near_edited`` and ``near_next``.

    A null text is empty; two texts without paragraphs are alike (1). Of repeated rows one is the
    next of the other. A single document is its own next. An empty table gives no rows."""
    source = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    ready = bind(source, keys=digests(F.col("text")))
    pair = with_next(ready, ["text", "keys"], source)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left("next_text", half))
    pair = bind(pair, edited_text=edited, n_chars=n.cast("bigint")).drop("text", "next_text")
    pair = bind(pair, edited_keys=digests(F.col("edited_text")))
    keys, edited_keys = F.col("keys"), F.col("edited_keys")
    pair = bind(
        pair,
        fingerprint=fingerprint(keys),
        edited_fingerprint=fingerprint(edited_keys),
        edited_diff=difference(keys, edited_keys),
        next_diff=difference(keys, F.col("next_keys")),
    )
    near = {f"near_{x}": likeness(keys, F.col(f"{x}_diff")) for x in ("edited", "next")}
    return pair.withColumns(near).drop("keys", "edited_keys", "next_keys")
