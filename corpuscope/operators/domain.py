"""Lexicon-and-rule domain classifier as one narrow projection.

Score of a domain = occurrences of its seeds as substrings + points of the rules that fire. The
best score wins, ties go to the earlier domain, and a winner that holds too small a share of all
points is rejected.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.functions import scan
from corpuscope.functions import text as T
from corpuscope.functions.profiles import ScriptProfile
from corpuscope.functions.rows import bind
from corpuscope.operators.docstats import with_token_counts

UNKNOWN = "unknown"
MIN_CONFIDENCE = 0.35


@dataclass(frozen=True)
class Rule:
    """Adds ``points`` to ``domain`` when its condition holds.

    kind ``any_of``: one of ``phrases`` occurs; ``matches``: ``pattern`` is found; ``count_at_least``:
    ``pattern`` is found ``threshold`` times or more; ``mix_rate_above`` and ``tokens_below`` compare
    the document's counts with ``threshold``. With ``group``, only matches in which that group of
    the pattern holds something are counted. ``guard`` lists literals of which every match of
    ``pattern`` contains at least one; a text with none of them skips the regex."""

    domain: str
    points: int
    kind: str
    pattern: str | None = None
    group: int = 0
    phrases: tuple[str, ...] = ()
    threshold: float | None = None
    guard: tuple[str, ...] = ()

    def count(self, text: Column) -> Column:
        if not self.group:
            return F.regexp_count(text, F.lit(self.pattern))
        found = F.regexp_extract_all(text, F.lit(self.pattern), self.group)
        return F.size(F.array_remove(found, ""))

    def fires(self, text: Column, token_count: Column, mix_rate: Column) -> Column:
        if self.kind == "any_of":
            return T.contains_any(text, self.phrases)
        if self.kind == "matches":
            cond = text.rlike(self.pattern)
        elif self.kind == "count_at_least":
            cond = self.count(text) >= int(self.threshold)
        elif self.kind == "mix_rate_above":
            return (token_count > 0) & (mix_rate > self.threshold)
        elif self.kind == "tokens_below":
            return token_count < int(self.threshold)
        else:
            raise ValueError(f"unknown rule kind {self.kind!r}")
        return T.contains_any(text, self.guard) & cond if self.guard else cond


@dataclass(frozen=True)
class DomainModel:
    """Domains in tie-break order, their seeds and their rules."""

    domains: tuple[str, ...]
    seeds: Mapping[str, Sequence[str]] = field(default_factory=dict)
    rules: tuple[Rule, ...] = ()
    min_confidence: float = MIN_CONFIDENCE

    def __post_init__(self) -> None:
        known = set(self.domains)
        stray = {r.domain for r in self.rules} | set(self.seeds)
        if stray - known:
            raise ValueError(f"seeds or rules for unlisted domains: {sorted(stray - known)}")
        if any(not w for v in self.seeds.values() for w in v):
            raise ValueError("empty seed")


def with_literal_columns(
    df: DataFrame,
    model: DomainModel,
    text_col: str = "text",
    flags: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Adds ``lex_<domain>`` integer columns, and a boolean column per entry of ``flags`` that
    tells whether any of its phrases occurs: one pass over the text, whatever the lists' length.
    A null text has zeros and false."""
    keep = [F.col(c) for c in df.columns]
    text = F.col(text_col)
    names = [f"lex_{d}" for d in model.domains]
    flags = flags or {}
    lists = [model.seeds.get(d, ()) for d in model.domains]
    scanned = df.select(*keep, scan.literal_scan(text, lists, list(flags.values())).alias("_lit"))
    scores = [F.get("_lit", F.lit(i)).alias(n) for i, n in enumerate(names)]
    found = [
        (F.get("_lit", F.lit(len(names) + i)) == 1).alias(n) for i, n in enumerate(flags)
    ]
    return scanned.select(*keep, *scores, *found)


def with_lexicon_scores(df: DataFrame, model: DomainModel, text_col: str = "text") -> DataFrame:
    """Adds ``lex_<domain>`` integer columns."""
    return with_literal_columns(df, model, text_col)


def with_rule_scores(
    df: DataFrame,
    model: DomainModel,
    text_col: str = "text",
    token_count_col: str = "token_count",
    latin_count_col: str = "latin_token_count",
    known: Mapping[Rule, str] | None = None,
) -> DataFrame:
    """Adds ``rule_<domain>`` integer columns; the two count columns must be there. The mixing rate
    is taken from them, since a stored rate may have been rounded. ``known`` names boolean columns
    for rules that have been settled already."""
    known = known or {}
    text, n = F.col(text_col), F.col(token_count_col)
    rate = T.safe_ratio(F.col(latin_count_col), n)
    cols = []
    for d in model.domains:
        points = [
            F.when(
                F.col(known[r]) if r in known else r.fires(text, n, rate), F.lit(r.points)
            ).otherwise(F.lit(0))
            for r in model.rules
            if r.domain == d
        ]
        cols.append(reduce(lambda a, b: a + b, points, F.lit(0)).alias(f"rule_{d}"))
    return df.select("*", *cols)


def infer_domain(
    df: DataFrame,
    model: DomainModel,
    profile: ScriptProfile,
    text_col: str = "text",
    label_col: str = "predicted_domain",
    keep_scores: bool = False,
    flags: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Adds the label and its ``confidence`` (share of the winner in all points; null without any).

    Token counts already on the frame are reused, otherwise they are made and dropped again.
    ``flags`` asks for further boolean columns, true where one of the listed phrases occurs; they
    ride on the pass that looks for the seeds."""
    flags = dict(flags or {})
    out_cols = [c for c in df.columns if c != label_col]
    carried = [*out_cols, *flags]
    have = {"token_count", "latin_token_count"} <= set(df.columns)
    counted = df if have else with_token_counts(df, profile, text_col)
    known = {r: f"_rule_{i}" for i, r in enumerate(model.rules) if r.kind == "any_of"}
    wanted = {n: r.phrases for r, n in known.items()} | flags
    found = with_literal_columns(counted, model, text_col, wanted)
    scored = with_rule_scores(found, model, text_col, known=known)

    score_names = [f"score_{d}" for d in model.domains]
    scored = bind(
        scored, **{f"score_{d}": F.col(f"lex_{d}") + F.col(f"rule_{d}") for d in model.domains}
    )
    # greatest() needs two arguments at least
    best = F.greatest(F.lit(0), *[F.col(n) for n in score_names])
    total = reduce(lambda a, b: a + b, [F.col(n) for n in score_names])
    scored = scored.select("*", best.alias("_best"), total.alias("_total"))
    winner = F.coalesce(
        *[F.when(F.col(n) == F.col("_best"), F.lit(d)) for n, d in zip(score_names, model.domains)]
    )
    confidence = F.when(F.col("_total") > 0, F.col("_best") / F.col("_total"))
    empty = F.col(text_col).isNull() | (F.col(text_col) == "")
    label = (
        F.when(empty | (F.col("_best") == 0), F.lit(UNKNOWN))
        .when(confidence < model.min_confidence, F.lit(UNKNOWN))
        .otherwise(winner)
    )
    extra = score_names if keep_scores else []
    return scored.select(
        *carried,
        *extra,
        label.alias(label_col),
        F.when(~empty, confidence).alias("confidence"),
    )


def domain_distribution(df: DataFrame, label_col: str = "predicted_domain") -> DataFrame:
    counted = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("document_count"))
    return counted.orderBy(F.desc("document_count"), label_col)
