"""How occupations co-occur with gender markers.

Everything that belongs to one document is settled inside its own row: tokens -> occurrences of
occupations -> the few tokens around each -> greedy marker scan -> evidence per occupation. So no
position, token or text is ever shuffled; what leaves the projection is one short row per document
and occupation, and what is shuffled is one row per task, occupation and label. The work per
occurrence is bounded by the window, so a very long document costs time linear in its length.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.functions import text as T
from corpuscope.functions.rows import bind

ALL = "ALL"
MALE_LEANING = "male-leaning"
FEMALE_LEANING = "female-leaning"
INSUFFICIENT = "insufficient data"
WINDOW = 10


def phrase(entry: str) -> str:
    """A lexicon entry as its words joined by single spaces."""
    return " ".join(entry.split())


def phrases(entries: Iterable[str]) -> tuple[str, ...]:
    """Cleaned entries without blanks and repeats, in their first order."""
    return tuple(dict.fromkeys(p for p in map(phrase, entries) if p))


@dataclass(frozen=True)
class GenderLexicon:
    occupations: tuple[str, ...]
    male: tuple[str, ...]
    female: tuple[str, ...]
    male_prefixes: tuple[str, ...] = ()
    female_prefixes: tuple[str, ...] = ()

    @classmethod
    def of(
        cls,
        occupations: Iterable[str],
        male: Iterable[str],
        female: Iterable[str],
        male_prefixes: Iterable[str] = (),
        female_prefixes: Iterable[str] = (),
    ) -> GenderLexicon:
        lists = (occupations, male, female, male_prefixes, female_prefixes)
        return cls(*map(phrases, lists))


def _by_length(entries: Sequence[str]) -> dict[int, list[str]]:
    out: dict[int, list[str]] = {}
    for e in entries:
        out.setdefault(len(e.split(" ")), []).append(e)
    return out


def _first_words(entries: Sequence[str]) -> list[str]:
    return list(dict.fromkeys(e.split(" ")[0] for e in entries))


def _member(col: Column, entries: Sequence[str]) -> Column:
    return col.isin(list(entries)) if entries else F.lit(False)


def _words(tokens: Column, start: Column, n: int) -> Column:
    """``n`` tokens from the zero-based ``start`` as one phrase."""
    if n == 1:
        return F.get(tokens, start)
    return F.array_join(F.slice(tokens, start + 1, n), " ")


def _hits(tokens: Column, size: Column, entries: Sequence[str]) -> Column:
    """All occurrences of the entries, overlapping ones included, as ``(start, n, phrase)``."""
    firsts = _first_words(entries)
    starts = F.array_compact(F.transform(tokens, lambda t, i: F.when(_member(t, firsts), i)))

    def at(i: Column) -> Column:
        found = [
            F.when(
                (i + n <= size) & _member(_words(tokens, i, n), words),
                F.struct(
                    i.alias("start"), F.lit(n).alias("n"), _words(tokens, i, n).alias("phrase")
                ),
            )
            for n, words in sorted(_by_length(entries).items())
        ]
        return F.array_compact(F.array(*found))

    return F.flatten(F.transform(starts, at))


def with_phrase_hits(
    df: DataFrame, entries: Sequence[str], text_col: str = "text", out_col: str = "hits"
) -> DataFrame:
    keep = [F.col(c) for c in df.columns]
    cut = bind(df, _k=T.normalized_tokens(text_col))
    return cut.select(*keep, _hits(F.col("_k"), F.size("_k"), phrases(entries)).alias(out_col))


def _scan(window: Column, entries: Sequence[str], evidence) -> Column:
    """Greedy left-to-right scan of a window: the longest marker that starts at a position and
    ends inside the window is taken and jumped over. ``evidence(start, end)`` gives the points of
    a taken marker, positions counted from the start of the window."""
    if not entries:
        return F.lit(0)
    firsts, lengths = _first_words(entries), _by_length(entries)

    def longest(t: Column, i: Column) -> Column:
        options = [
            F.when(
                (i + n <= F.size(window)) & _member(_words(window, i, n), lengths[n]), F.lit(n)
            )
            for n in sorted(lengths, reverse=True)
        ]
        return F.when(
            _member(t, firsts),
            F.struct(i.alias("start"), F.coalesce(*options, F.lit(0)).alias("n")),
        )

    candidates = F.filter(
        F.array_compact(F.transform(window, longest)), lambda c: c["n"] > 0
    )
    zero = F.struct(F.lit(0).alias("free"), F.lit(0).alias("points"))

    def step(acc: Column, c: Column) -> Column:
        end = c["start"] + c["n"]
        taken = F.struct(
            end.alias("free"), (acc["points"] + evidence(c["start"], end)).alias("points")
        )
        return F.when(c["start"] >= acc["free"], taken).otherwise(acc)

    return F.aggregate(candidates, zero, step, lambda acc: acc["points"])


def with_gender_evidence(
    df: DataFrame,
    lexicon: GenderLexicon,
    window: int = WINDOW,
    text_col: str = "text",
    out_col: str = "gender_evidence",
) -> DataFrame:
    """Adds an array of ``(occupation, male, female)`` with one entry per occupation of the
    document that has any gender evidence near one of its occurrences.

    A several-word occupation counts only in texts that hold it verbatim, with single spaces."""
    keep = [F.col(c) for c in df.columns]
    text = F.col(text_col)

    cut = bind(df, _k=T.normalized_tokens(text_col))
    hits = _hits(F.col("_k"), F.size("_k"), lexicon.occupations)

    def context(h: Column) -> Column:
        lo = F.greatest(h["start"] - window, F.lit(0))
        hi = F.least(h["start"] + h["n"] + window, F.size("_k"))
        before = F.when(h["start"] > 0, F.get(F.col("_k"), h["start"] - 1))
        return F.struct(
            h["phrase"].alias("phrase"),
            (h["start"] - lo).alias("a"),
            (h["start"] + h["n"] - lo).alias("b"),
            before.alias("before"),
            F.slice(F.col("_k"), lo + 1, hi - lo).alias("w"),
        )

    def points(c: Column) -> Column:
        a, b = c["a"], c["b"]

        def evidence(start: Column, end: Column) -> Column:
            same = (start == a) & (end == b)
            overlaps = (start < b) & (end > a)
            return F.when(same | ~overlaps, F.lit(1)).otherwise(F.lit(0))

        # The first word of the occupation decides; the word before it only where that one is no
        # prefix. Female prefixes are looked at first.
        first = F.get(c["w"], a)
        female_first = _member(first, lexicon.female_prefixes)
        male_first = _member(first, lexicon.male_prefixes)
        female_before = _member(c["before"], lexicon.female_prefixes)
        male_before = _member(c["before"], lexicon.male_prefixes)
        prefix = (
            F.when(female_first, F.lit("f"))
            .when(male_first, F.lit("m"))
            .when(female_before, F.lit("f"))
            .when(male_before, F.lit("m"))
            .otherwise(F.lit(""))
        )
        return F.struct(
            c["phrase"].alias("phrase"),
            _scan(c["w"], lexicon.male, evidence).alias("m"),
            _scan(c["w"], lexicon.female, evidence).alias("f"),
            prefix.alias("g"),
        )

    # One occurrence at a time: cut its context, weigh it, drop the context again.
    weighed = bind(cut, _e=F.transform(F.transform(hits, context), points))

    def total(name: str, prefix: str, occupation: Column) -> Column:
        def step(acc: Column, e: Column) -> Column:
            more = e[name] + (e["g"] == prefix).cast("int")
            return F.when(e["phrase"] == occupation, acc + more).otherwise(acc)

        return F.aggregate(F.col("_e"), F.lit(0), step)

    # As many entries as there are different occupations in the text, never more than listed.
    names = F.array_distinct(F.transform("_e", lambda e: e["phrase"]))
    per_occupation = F.transform(
        names,
        lambda o: F.struct(
            o.alias("occupation"), total("m", "m", o).alias("male"), total("f", "f", o).alias("female")
        ),
    )
    usable = F.filter(
        per_occupation,
        lambda r: (r["male"] + r["female"] > 0)
        & (~F.contains(r["occupation"], F.lit(" ")) | F.contains(text, r["occupation"])),
    )
    return weighed.select(*keep, usable.alias(out_col))


def gender_scores(
    df: DataFrame,
    label_col: str = "predicted_domain",
    evidence_col: str = "gender_evidence",
    key_cols: Sequence[str] = (),
) -> DataFrame:
    """One row per document and occupation: smoothed log-odds of male over female evidence."""
    rows = df.select(*key_cols, label_col, F.explode(evidence_col).alias("_r"))
    score = F.log((F.col("_r.male") + 0.5) / (F.col("_r.female") + 0.5))
    return rows.select(
        *key_cols,
        label_col,
        F.col("_r.occupation").alias("occupation"),
        F.col("_r.male").alias("male"),
        F.col("_r.female").alias("female"),
        score.alias("score"),
    )


def _direction(avg: Column) -> Column:
    return (
        F.when(avg.isNull(), F.lit(INSUFFICIENT))
        .when(avg > 0, F.lit(MALE_LEANING))
        .otherwise(F.lit(FEMALE_LEANING))
    )


def gender_bias(
    scores: DataFrame, occupations: Sequence[str], label_col: str = "predicted_domain"
) -> DataFrame:
    """``(occupation, domain, avg_bias_score, doc_count, direction)`` with a row per label and one
    labelled ``ALL``; an occupation without evidence keeps its ``ALL`` row.

    Scores are summed as decimals: the mean and its sign are then the same on every layout, and
    opposite scores cancel to exactly zero, which reads as female-leaning."""
    exact = F.col("score").cast("decimal(18,12)")
    per_label = scores.groupBy("occupation", F.col(label_col).alias("_label")).agg(
        F.sum(exact).alias("_s"), F.count(F.lit(1)).alias("_n")
    )
    # A row without documents for every listed occupation, so that each gets its ALL row.
    listed = scores.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(o) for o in phrases(occupations)])).alias("occupation"),
        F.lit(None).cast("string").alias("_label"),
        F.lit(None).cast("decimal(28,12)").alias("_s"),
        F.lit(0).cast("bigint").alias("_n"),
    )
    rolled = (
        per_label.unionByName(listed)
        .groupingSets([["occupation", "_label"], ["occupation"]], "occupation", "_label")
        .agg(
            F.sum("_s").alias("_s"),
            F.sum("_n").alias("doc_count"),
            F.grouping("_label").alias("_all"),
        )
        .filter((F.col("doc_count") > 0) | (F.col("_all") == 1))
    )
    avg = F.when(F.col("doc_count") > 0, F.col("_s").cast("double") / F.col("doc_count"))
    return rolled.select(
        "occupation",
        F.when(F.col("_all") == 1, F.lit(ALL)).otherwise(F.col("_label")).alias("domain"),
        F.bround(avg, 4).alias("avg_bias_score"),
        "doc_count",
        _direction(avg).alias("direction"),
    )


def gender_share(bias: DataFrame) -> DataFrame:
    """One row: occupations with evidence, and how many of them lean to the male side."""
    overall = bias.filter((F.col("domain") == ALL) & F.col("avg_bias_score").isNotNull())
    counts = overall.agg(
        F.count(F.lit(1)).alias("evaluated"),
        F.count_if(F.col("direction") == MALE_LEANING).alias("male_leaning"),
    )
    share = T.safe_ratio(F.col("male_leaning"), F.col("evaluated"))
    return counts.withColumn("male_leaning_share", share)


def gender_extremes(bias: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` most male-leaning and the ``n`` most female-leaning occupations over all labels."""
    overall = bias.filter((F.col("domain") == ALL) & F.col("avg_bias_score").isNotNull())

    # At most one row per listed occupation gets here, so the window may be unpartitioned.
    male = Window.orderBy(F.desc("avg_bias_score"), F.asc("occupation"))
    female = Window.orderBy(F.asc("avg_bias_score"), F.asc("occupation"))
    ranked = overall.select(
        "*", F.row_number().over(male).alias("_m"), F.row_number().over(female).alias("_f")
    )
    sides = F.array(
        F.struct(F.lit("male").alias("side"), F.col("_m").alias("rank")),
        F.struct(F.lit("female").alias("side"), F.col("_f").alias("rank")),
    )
    ranked = ranked.withColumn("_s", F.explode(sides))
    return ranked.filter(F.col("_s.rank") <= n).select(
        "_s.side", "_s.rank", "occupation", "avg_bias_score", "doc_count"
    )
