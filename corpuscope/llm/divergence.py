"""How far the sources of a language differ in their words.

Each source of a language gives each common term of the language a price (a smoothed share in
billionths) that depends on nothing but how often the source uses it. So two sources are compared by
their joint table alone: how many terms have one level of price in the first and another in the second.
All joint tables of a language are one matrix product: indicator columns for (source, level), one row
per term, times their transpose. Terms are dealt into blocks, sources into tiles, and every block
multiplies its indicators exactly and prices the tables; only one number per pair of sources and block
is shuffled and added up.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.llm.textarrays import chunks, text_buffer
from corpuscope.session import materialize

MIN_DOCS = 30
SMOOTH = 5
SCALE = 1_000_000_000
TOP = 50
#: Terms of a block (on average) and sources of a tile; a task holds one block of two tiles.
TERMS, TILE = 512, 128
#: Counts a task gathers before it hands them on.
HELD = 250_000
#: A table of sources with at most so many rows (some 10 MB) is broadcast.
BROADCAST_SOURCES = 100_000

#: Letters of ASCII in lower case and bytes above it; blanks otherwise.
_LETTERS = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _counter(most: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}

        def hand_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                size = len(n)
                columns = [[lang] * size, [source] * size, pa.array(n.keys(), pa.binary()), list(n.values()), [docs[t] for t in n]]
                yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, _COUNTS)], schema=_COUNTS)
            held.clear()

        for batch in batches:
            for part in chunks(batch, "text"):
                buf, bounds = text_buffer(part.column("text"))
                keys = zip(part.column("lang").to_pylist(), part.column("source").to_pylist())
                for key, s, e in zip(keys, bounds[:-1], bounds[1:]):
                    terms = buf[s:e].tobytes().translate(_LETTERS).split()
                    n, docs = held.setdefault(key, (Counter(), Counter()))
                    n.update(terms)
                    docs.update(set(terms))
                if sum(len(n) for n, _ in held.values()) > most:
                    yield from hand_on()
        yield from hand_on()

    return count


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS, held: int = HELD) -> DataFrame:
    """``(lang, source, term, n, n_lang)``: occurrences of terms that at least ``min_docs`` documents of
    the language have, in a source and in the language. Counts are gathered per task before they are
    shuffled, once, by language and term."""
    made = _named(docs).mapInArrow(_counter(held), "lang string, source string, term string, n bigint, docs bigint")
    counts = made.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    counts = counts.withColumns({"docs": F.sum("docs").over(term), "n_lang": F.sum("n").over(term)})
    return counts.where(F.col("docs") >= min_docs).select("lang", "source", "term", "n", "n_lang")


def price(n: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * terms))``, exact for counts of any size."""
    below = total + SMOOTH * terms
    n = n + SMOOTH
    exact = F.call_function("div", n.cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), below.cast("decimal(20,0)"))
    return 1 + F.when(n <= (1 << 63) // SCALE - 1, F.call_function("div", n * SCALE, below)).otherwise(exact)


def source_table(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per (lang, source) that occurs: ``id`` (numbered within the language), ``total`` and
    ``total_lang`` (occurrences of kept terms), ``terms`` (kept ones), ``sources`` of the language and
    ``none``, the price of a term that the source does not have."""
    groups = _named(docs).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("docs"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = counts.groupBy("lang", "term").agg(F.max("n_lang").alias("n"))
    langs = langs.groupBy("lang").agg(F.sum("n").alias("total_lang"), F.count(F.lit(1)).alias("terms"))
    lang = Window.partitionBy("lang")
    out = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "total_lang", "terms"])
    out = out.withColumn("id", (F.row_number().over(lang.orderBy("source")) - 1).cast("bigint"))
    out = out.withColumn("sources", F.count(F.lit(1)).over(lang))
    none = F.when(F.col("terms") > 0, price(F.lit(0).cast("bigint"), F.col("total"), F.col("terms")))
    return materialize(out.withColumn("none", none).drop("docs"), "sources")


def product(left: np.ndarray, n_left: int, right: np.ndarray, n_right: int) -> np.ndarray:
    """The transpose of one indicator matrix times another, (n_left, n_right).

    Indicator matrices are stored by the columns of their ones: ``left`` has one per row, ``right`` a
    fixed number per row. Row by row, the product of the transposed row and the row has its ones
    where these columns cross; they are added up."""
    cells = left[:, None] * n_right + right
    return np.bincount(cells.ravel(), minlength=n_left * n_right).reshape(n_left, n_right)


class Block:
    """Levels of some terms in some sources. ``level[t, s]`` is the indicator column of the price of
    term ``t`` in source ``s``; the columns of a source are next to each other."""

    def __init__(self, n_terms: int, none: np.ndarray, term: np.ndarray, source: np.ndarray, prices: np.ndarray):
        value = np.repeat(none[None, :], n_terms, axis=0)
        value[term, source] = prices
        self.level = np.zeros(value.shape, dtype=np.int64)
        bounds, found = [0], []
        for s in range(value.shape[1]):
            levels, at = np.unique(value[:, s], return_inverse=True)
            self.level[:, s] = at + bounds[-1]
            bounds.append(bounds[-1] + len(levels))
            found.append(levels)
        self.bounds = np.array(bounds)
        self.prices = np.concatenate(found) if found else np.zeros(0, np.int64)

    def joint(self, s: int) -> np.ndarray:
        """Joint tables of source ``s`` with all sources, side by side."""
        begin, end = self.bounds[s : s + 2]
        return product(self.level[:, s] - begin, int(end - begin), self.level, int(self.bounds[-1]))

    def distances(self, s: int) -> np.ndarray:
        """Sum over the terms of the differences between the prices in ``s`` and in every source."""
        begin, end = self.bounds[s : s + 2]
        apart = np.abs(self.prices[begin:end, None] - self.prices[None, :])
        return np.add.reduceat((self.joint(s) * apart).sum(axis=0), self.bounds[:-1])


_PRICED = pa.schema([("lang", pa.string()), *[(n, pa.int64()) for n in ("a", "b", "value", "n_terms")]])
_JOINT = pa.schema([("lang", pa.string()), *[(n, pa.int64()) for n in ("a", "level", "b", "other_level", "n_terms")]])


def _multiply(priced: bool, tile: int):
    schema = _PRICED if priced else _JOINT

    def run(key: tuple, table: pa.Table) -> pa.Table:
        lang, lo, hi = (key[i].as_py() for i in (0, 2, 3))
        terms = table.column("term").combine_chunks().dictionary_encode()
        number = terms.indices.to_numpy(zero_copy_only=False)
        ids, prices = table.column("id").to_numpy(), table.column("p").to_numpy()
        heads = np.asarray(table.column("term").is_null())
        order = np.argsort(ids[heads])
        sources, none = ids[heads][order], prices[heads][order]
        n_terms = len(terms.dictionary)
        out: list[list] = [[] for _ in schema]
        if n_terms:
            body = ~heads
            block = Block(n_terms, none, number[body].astype(np.int64), np.searchsorted(sources, ids[body]), prices[body])
        for s, a in enumerate(sources.tolist()):
            other = (sources != a) & (sources // tile == (lo if a // tile == hi else hi))
            b = sources[other]
            if priced:
                value = block.distances(s)[other] if n_terms else np.zeros(len(b), np.int64)
                rows = [np.full(len(b), a), b, value, np.full(len(b), n_terms)]
            elif n_terms:
                table_a, begin = block.joint(s), block.bounds[s]
                mine, col = np.nonzero(table_a)
                owner = np.searchsorted(block.bounds, col, "right") - 1
                good = other[owner]
                mine, col, owner = mine[good], col[good], owner[good]
                rows = [np.full(len(mine), a), block.prices[begin + mine], sources[owner], block.prices[col], table_a[mine, col]]
            else:
                continue
            for column, values in zip(out[1:], rows):
                column.append(values)
        arrays = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out[1:]]
        return pa.Table.from_arrays([pa.array([lang] * len(arrays[0]), pa.string()), *map(pa.array, arrays)], schema=schema)

    return run


def _blocks(prices: DataFrame, sources: DataFrame, priced: bool, terms: int, tile: int) -> DataFrame:
    tiles = F.floor((F.col("sources") - 1) / tile)
    blocks = F.greatest(F.lit(1), F.ceil(F.col("terms") / terms)).cast("bigint")
    mine = F.floor(F.col("id") / tile)
    dealt = lambda df: df.select(
        "lang", "block", F.least(mine, "other").alias("lo"), F.greatest(mine, "other").alias("hi"), "id", "term", "p"
    )
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), tiles)).alias("other")
    entries = dealt(prices.select("*", F.pmod(F.xxhash64("term"), blocks).alias("block")).select("*", every))
    heads = sources.withColumn("p", F.coalesce("none", F.lit(0))).withColumn("term", F.lit(None).cast("string"))
    heads = dealt(heads.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)).alias("block")).select("*", every))
    numbers = ("a", "b", "value", "n_terms") if priced else ("a", "level", "b", "other_level", "n_terms")
    schema = ", ".join(["lang string", *[f"{n} bigint" for n in numbers]])
    return entries.unionByName(heads).groupBy("lang", "block", "lo", "hi").applyInArrow(_multiply(priced, tile), schema)


def priced_terms(counts: DataFrame, sources: DataFrame) -> DataFrame:
    """``counts`` with its source's row, the price ``p`` in the source and ``q`` in the language."""
    if sources.count() <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    own, lang = price(F.col("n"), F.col("total"), F.col("terms")), price(F.col("n_lang"), F.col("total_lang"), F.col("terms"))
    return counts.join(sources, ["lang", "source"]).withColumns({"p": own, "q": lang})


def joint_tables(docs: DataFrame, min_docs: int = MIN_DOCS, terms: int = TERMS, tile: int = TILE) -> DataFrame:
    """Every joint table: ``(lang, source, level, other, other_level, n_terms)``, how many kept terms have
    a price of ``level`` in a source and of ``other_level`` in another one of the language."""
    counts = materialize(term_counts(docs, min_docs), "term-counts")
    sources = source_table(docs, counts)
    cells = _blocks(priced_terms(counts, sources), sources, False, terms, tile)
    cell = ["lang", "a", "level", "b", "other_level"]
    cells = materialize(cells.groupBy(*cell).agg(F.sum("n_terms").alias("n_terms")), "joint-tables")
    # Terms that neither source has are in no block of their tiles.
    rest = _with_names(cells.groupBy("lang", "a", "b").agg(F.sum("n_terms").alias("seen")), sources)
    rest = rest.select("lang", "a", F.col("none").alias("level"), "b", F.col("other_none").alias("other_level"), (F.col("terms") - F.col("seen")).alias("n_terms"))
    cells = cells.unionByName(rest.where("n_terms > 0")).groupBy(*cell).agg(F.sum("n_terms").alias("n_terms"))
    return _with_names(cells, sources).select("lang", "source", "level", "other", "other_level", "n_terms")


def _with_names(pairs: DataFrame, sources: DataFrame) -> DataFrame:
    if sources.count() <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    a = sources.select("lang", F.col("id").alias("a"), "source", "none", "terms")
    b = sources.select("lang", F.col("id").alias("b"), F.col("source").alias("other"), F.col("none").alias("other_none"))
    return pairs.join(a, ["lang", "a"]).join(b, ["lang", "b"])


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, terms: int = TERMS, tile: int = TILE, held: int = HELD) -> DataFrame:
    """Per source of a language, all other sources by falling distance (``part`` is ``pair``) and the
    ``top`` terms that it overuses most against the language (``term``): ``lang``, ``source``, ``part``,
    ``item``, ``value``, ``rank``.

    ``docs`` needs ``lang``, ``source`` and ``text``, of which null is empty; other columns are ignored.
    Repeated rows are documents each. Equal values are ranked by item. A language none of whose terms
    reaches ``min_docs`` documents has distances of 0 and no terms; an empty table gives no rows."""
    counts = materialize(term_counts(docs, min_docs, held), "term-counts")
    sources = source_table(docs, counts)
    prices = priced_terms(counts, sources)
    pairs = _blocks(prices, sources, True, terms, tile).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("n_terms").alias("seen"))
    # Terms that neither source has are in no block of their tiles.
    rest = F.coalesce((F.col("terms") - F.col("seen")) * F.abs(F.col("none") - F.col("other_none")), F.lit(0))
    pairs = _with_names(pairs, sources).select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), (F.col("value") + rest).alias("value"))
    over = prices.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    falling = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(falling))
    over = over.withColumn("rank", F.row_number().over(falling)).where(F.col("rank") <= top)
    return pairs.unionByName(over)
