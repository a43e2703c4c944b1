"""Personal data in texts, by labelers whose reliability is estimated without labels.

Patterns find spans that are certain by form (``strict``) and looser candidates. Labelers vote on
every span: its form, lists of known values (gazetteers), the words before it and the characters
around it. Besides personal data they find secrets: passwords, tokens and keys. Expectation-maximisation estimates from how the votes agree how reliable each labeler is
(one confusion table per labeler and kind), and its posteriors train a logistic regression that
decides on the loose spans. Spans and votes are column expressions; what reaches the driver is the
number of spans per combination of votes and features, a table whose size has a fixed bound.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.rows import bind

BASE_KINDS = ("email", "ip", "card", "phone")
#: Passwords, tokens and keys have no form that is certain; all their spans are loose.
KINDS = (*BASE_KINDS, "secret")
#: The patterns of the spans that are always reported. They match what the plain forms match, from the
#: left and without overlap, but take runs of characters whole, so that no text makes them slow.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Gazetteers of secrets: how issued keys begin, and names that secrets are assigned to.
KEY_BEGINS = "AKIA|ASIA|gh[oprsu]_|github_pat_|glpat-|sk-|[rs]k_live_|xox[abprs]-|AIza|eyJ"
SECRET_NAMES = "password|passwd|passwort|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential"
ASSIGNED = rf"(?i:{SECRET_NAMES})[\"']{{0,1}}\x20{{0,2}}[=:]\x20{{0,2}}[\"']{{0,1}}"
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|[(\[]at[)\]])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:\[\.\][0-9]{1,3}+){3}",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20-][0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9])",
    # Keys by their beginnings; what is assigned to a telling name, with a digit in it; bare runs of hex digits.
    "secret": (
        rf"(?<![A-Za-z0-9_-])(?:{KEY_BEGINS})[A-Za-z0-9_-]{{16,}}+(?:\.[A-Za-z0-9_-]++)*+"
        rf"|(?<=[=:\"'\x20])(?<={ASSIGNED})(?=[^\s\"',;]{{0,80}}[0-9])[^\s\"',;<>=:]{{8,}}+"
        r"|(?<![A-Za-z0-9])[0-9a-f]{32,64}+(?![A-Za-z0-9])"
    ),
}
#: Cheap signs without which a text has no such span.
SIGNS = {
    "email": r"@|[(\[]at[)\]]",
    "ip": r"[0-9]\[?\.",
    "card": r"[0-9][\x20-]?[0-9]",
    "phone": r"\+[0-9]|[0-9][.-][0-9]{4}",
    "secret": rf"(?<![A-Za-z0-9_-])(?:{KEY_BEGINS})|(?i:{SECRET_NAMES})[\"']?\x20{{0,2}}[=:]|[0-9a-f]{{32}}",
}
#: Gazetteers: endings of names of hosts, and beginnings of card numbers by issuer.
TOP_LEVEL = "com|org|net|edu|gov|mil|int|info|biz|name|io|eu|uk|us|ca|au|de|fr|es|it|nl|be|ch|at|pl|pt|se|no|dk|fi|ie|br|mx|ar|jp|cn|in|ru|za"
ISSUERS = r"4|5[1-5]|2[2-7]|3[47]|6011|65|35|62"
NOT_PUBLIC_IP = r"0|10|127|169\.254|192\.168|172\.(1[6-9]|2[0-9]|3[01])|22[4-9]|2[3-5][0-9]"
CONTEXT = {
    "email": r"e-?mail|mail|correo|courriel|contact|kontakt|write|address|adresse",
    "ip": r"\bip\b|host|server|login|address|adresse|client",
    "card": r"card|visa|master|amex|credit|karte|tarjeta|carte|pay",
    "phone": r"phone|tel|call|mobile|cell|fax|ruf|handy|llam|appel|contact|kontakt",
    "secret": rf"{SECRET_NAMES}|auth|login|bearer|signature",
}
AGAINST_SECRET = r"\bsha|md5|hash|commit|checksum|digest|revision|uuid"
AGAINST = r"version|\bv\.?$|isbn|order|invoice|serial|section|chapter|page|figure|token|key|hash"
LABELERS = ("form", "gazetteer", "context", "edge")
FEATURES = ("strict", "separated", "plus", "long", "few_digits", "context", "clean_edge", "listed")
_ABSTAIN = 2
_NEAR = 40


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]+", "")


def luhn(digits: Column) -> Column:
    """Whether digits pass the check of card numbers."""
    order = F.transform(F.split(F.reverse(digits), "", 0), lambda c, i: F.struct(c.cast("int").alias("d"), (i % 2).alias("odd")))
    double = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(order, F.lit(0), lambda s, x: s + F.coalesce(F.when(x["odd"] == 1, double(x["d"])).otherwise(x["d"]), F.lit(0)))
    return total % 10 == 0


_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def is_valid(kind: str, text: Column) -> Column:
    """Whether a match of the strict pattern is a span of this kind."""
    n = F.length(_digits(text))
    if kind == "ip":
        return text.rlike(rf"\A{_OCTET}(?:\.{_OCTET}){{3}}\z")
    if kind == "card":
        return F.when(n.between(14, 19), luhn(_digits(text))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def running_ends(sizes: Column, block: int = 64) -> Column:
    """Sums of the first 1, 2, ... elements of an int array. Blocks keep the copying that each append
    costs to a small multiple of the length."""
    add = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    n = F.size(sizes)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int"))).otherwise(F.array().cast("array<int>"))
    blocks = F.transform(starts, lambda b: F.slice(sizes, b * block + 1, block))
    sums = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v))
    before = F.aggregate(sums, F.array(F.lit(0)), add)
    inner = lambda x, s: F.slice(F.aggregate(x, F.array(s), add), 2, block)
    return F.flatten(F.zip_with(blocks, F.slice(before, 1, F.size(blocks)), inner))


def _found(df: DataFrame, name: str, text: Column, pattern: str, sign: str) -> DataFrame:
    """Adds ``name``: per match its begin and end in characters, itself, and what stands around it."""
    some = text.rlike(sign)
    empty = F.array().cast("array<string>")
    df = bind(df, _m=F.when(some, F.regexp_extract_all(text, F.lit(pattern), 0)).otherwise(empty))
    matched = F.size("_m") > 0
    df = bind(df, _g=F.when(matched, F.split(text, pattern, -1)).otherwise(empty))
    both = F.zip_with(F.slice("_g", 1, F.size("_m")), "_m", lambda g, m: F.length(g) + F.length(m))
    df = bind(df, _e=running_ends(F.when(matched, both).otherwise(F.array().cast("array<int>"))))
    row = F.transform(
        "_m",
        lambda m, i: F.struct(
            (F.get("_e", i) - F.length(m)).alias("start"),
            F.get("_e", i).alias("end"),
            m.alias("m"),
            F.right(F.get("_g", i), F.lit(_NEAR)).alias("before"),
            F.left(F.get("_g", i + 1), F.lit(1)).alias("after"),
        ),
    )
    return bind(df, **{name: row}).drop("_m", "_g", "_e")


def _voted(kind: str, strict: bool, x: Column) -> Column:
    m, digits = x["m"], _digits(x["m"])
    near = F.lower(x["before"])
    form = F.lit(1) if strict else F.lit(_ABSTAIN)
    if kind == "card" and not strict:
        form = F.when(luhn(digits), 1).otherwise(0)
    if kind == "ip" and not strict:
        form = F.when(is_valid("ip", F.regexp_replace(m, r"[\[\]]", "")), 1).otherwise(0)
    if kind == "secret":
        form = F.when(m.rlike("[0-9]") & m.rlike("[A-Za-z]"), 1).otherwise(0)
    known = {
        "email": m.rlike(rf"(?i)[.)\]]\x20?(?:{TOP_LEVEL})\z"),
        "ip": ~F.regexp_replace(m, r"[\[\]]", "").rlike(rf"\A(?:{NOT_PUBLIC_IP})(?:\.|\z)"),
        "card": digits.rlike(rf"\A(?:{ISSUERS})"),
        "phone": digits.rlike(r"\A(?:1?[2-9][0-9]{9}|[2-9][0-9]{10,14})\z"),
        "secret": m.rlike(rf"\A(?:{KEY_BEGINS})") | x["before"].rlike(rf"{ASSIGNED}\z"),
    }[kind]
    listed = F.when(known, 1).otherwise(0)
    context = F.when(near.rlike(CONTEXT[kind]), 1).when(near.rlike(AGAINST_SECRET if kind == "secret" else AGAINST), 0).otherwise(_ABSTAIN)
    touching = F.right(x["before"], F.lit(1)).rlike(r"[\p{L}\p{N}_]") | x["after"].rlike(r"[\p{L}\p{N}_]")
    edge = F.when(touching, 0).otherwise(1)
    # A digit per labeler, and a bit per feature.
    votes = form * 27 + listed * 9 + context * 3 + edge
    bits = [
        F.lit(strict),
        m.rlike(r"[\x20().-]"),
        F.startswith(m, F.lit("+")),
        F.length(digits) > 11,
        F.size(F.array_distinct(F.split(digits, "", 0))) <= 3,
        context == 1,
        edge == 1,
        listed == 1,
    ]
    packed = sum((b.cast("int") * (1 << i) for i, b in enumerate(bits)), F.lit(0))
    return F.struct(
        x["start"].alias("start"),
        F.lit(KINDS.index(kind)).alias("k"),
        x["end"].alias("end"),
        F.lit(strict).alias("strict"),
        votes.cast("int").alias("votes"),
        packed.cast("int").alias("features"),
    )


def candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_base`` and ``_loose``: spans with begin, kind, end, votes and features. Loose
    spans share no character with a base span."""
    df = bind(docs, _t=F.coalesce(F.col("text").cast("string"), F.lit("")))
    t = F.col("_t")
    for kind in KINDS:
        if kind in STRICT:
            df = _found(df, f"_s_{kind}", t, STRICT[kind], SIGNS[kind])
        df = _found(df, f"_l_{kind}", t, LOOSE[kind], SIGNS[kind])

    def valid(kind: str) -> Column:
        return F.filter(f"_s_{kind}", lambda x: is_valid(kind, x["m"]))

    def voted(kind: str, strict: bool, spans: Column) -> Column:
        return F.transform(spans, lambda x: _voted(kind, strict, x))

    base = [voted(k, True, valid(k)) for k in BASE_KINDS]
    df = bind(df, _base=F.sort_array(F.concat(*base)))
    clear = lambda x: ~F.exists("_base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    loose = [voted(k, False, F.filter(f"_l_{k}", clear)) for k in KINDS]
    df = bind(df, _loose=F.sort_array(F.concat(*loose)))
    return df.drop("_t", *[f"_{p}_{k}" for p in "sl" for k in KINDS if p == "l" or k in STRICT])


class Model(NamedTuple):
    """Per kind the weights of the features and, last, the constant; per kind and labeler the
    probability of each vote for spans that are no personal data and spans that are."""

    weights: list[list[float]]
    reliability: dict


def _vote_digits(votes: int) -> tuple[int, ...]:
    return votes // 27, votes // 9 % 3, votes // 3 % 3, votes % 3


def expectation_maximisation(rows: Sequence[tuple[int, int]], rounds: int = 50) -> tuple[dict[int, float], list]:
    """From ``(votes, count)``: the posterior of each combination of votes, and the confusion tables.

    The start is the share of votes in favour; counts are smoothed, so a labeler that never votes or
    always votes alike keeps probabilities between 0 and 1."""
    post = {}
    for votes, _ in rows:
        cast = [v for v in _vote_digits(votes) if v != _ABSTAIN]
        post[votes] = (sum(cast) + 0.5) / (len(cast) + 1)
    table: list = []
    for _ in range(rounds):
        total = sum(n for _, n in rows)
        prior = (sum(post[v] * n for v, n in rows) + 1) / (total + 2)
        table = [[[1.0] * 3, [1.0] * 3] for _ in LABELERS]
        for votes, n in rows:
            for labeler, v in enumerate(_vote_digits(votes)):
                table[labeler][1][v] += post[votes] * n
                table[labeler][0][v] += (1 - post[votes]) * n
        table = [[[x / sum(side) for x in side] for side in one] for one in table]
        for votes, _ in rows:
            yes, no = math.log(prior), math.log(1 - prior)
            for labeler, v in enumerate(_vote_digits(votes)):
                yes += math.log(table[labeler][1][v])
                no += math.log(table[labeler][0][v])
            post[votes] = 1 / (1 + math.exp(max(min(no - yes, 500), -500)))
    return post, table


def logistic_regression(rows: Sequence[tuple[int, float, float]], rounds: int = 400, penalty: float = 1.0) -> list[float]:
    """Weights for feature bits and a constant from ``(features, posterior, weight)``, by gradient
    steps with momentum on the mean loss."""
    size = len(FEATURES) + 1
    total = sum(n for _, _, n in rows) or 1.0
    x = [([1.0 if f >> i & 1 else 0.0 for i in range(size - 1)] + [1.0], q, n / total) for f, q, n in rows]
    w, speed = [0.0] * size, [0.0] * size
    for _ in range(rounds):
        g = [penalty * v / (total + 1) for v in w]
        for f, q, n in x:
            z = sum(a * b for a, b in zip(w, f))
            d = (1 / (1 + math.exp(-max(min(z, 50), -50))) - q) * n
            for i, v in enumerate(f):
                g[i] += d * v
        speed = [0.9 * s - 0.5 * d for s, d in zip(speed, g)]
        w = [a + s for a, s in zip(w, speed)]
    return w


def fit(spans: DataFrame) -> Model:
    """Estimates reliabilities and trains the classifier of each kind on all spans of a
    ``candidates`` frame. A kind without spans has a classifier that refuses."""
    each = spans.select(F.explode(F.concat("_base", "_loose")).alias("s"))
    # At most 5 kinds x 81 votes x 256 features.
    counted = each.groupBy("s.k", "s.votes", "s.features").count().collect()
    weights, reliability = [], {}
    for k, kind in enumerate(KINDS):
        rows = sorted((r.votes, r.features, r["count"]) for r in counted if r.k == k)
        by_votes: dict[int, int] = {}
        for votes, _, n in rows:
            by_votes[votes] = by_votes.get(votes, 0) + n
        if not rows:
            weights.append([0.0] * len(FEATURES) + [-1.0])
            continue
        post, table = expectation_maximisation(sorted(by_votes.items()))
        reliability[kind] = dict(zip(LABELERS, table))
        weights.append(logistic_regression([(f, post[v], n) for v, f, n in rows]))
    return Model(weights, reliability)


def probability(model: Model, x: Column) -> Column:
    """The classifier's probability for a span."""
    out = F.lit(0.0)
    for k, w in enumerate(model.weights):
        z = sum((F.getbit(x["features"], F.lit(i)).cast("double") * v for i, v in enumerate(w[:-1])), F.lit(w[-1]))
        out = F.when(x["k"] == k, 1 / (1 + F.exp(-z))).otherwise(out)
    return out


def decide(spans: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """Replaces ``_base`` and ``_loose`` by ``base_spans`` and ``spans``, arrays of ``start``, ``k``
    (number of the kind) and ``end``; ``spans`` also holds the loose ones that the classifier takes."""
    plain = lambda x: F.struct(x["start"].alias("start"), x["k"].alias("k"), x["end"].alias("end"))
    base = F.transform("_base", plain)
    taken = F.transform(F.filter("_loose", lambda x: probability(model, x) >= least), plain)
    return bind(spans, base_spans=base, spans=F.sort_array(F.concat(base, taken))).drop("_base", "_loose")


def spelled(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["start"], x["end"])), ",")


def count_of(kind: str, spans: Column) -> Column:
    return F.size(F.filter(spans, lambda x: x["k"] == KINDS.index(kind))).cast("bigint")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in angle brackets; of spans that overlap, what
    the later one adds goes with the first."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        piece = F.array(F.substr(text, s["at"] + 1, x["start"] - s["at"]), F.get(names, x["k"]))
        more = F.when(x["start"] >= s["at"], F.concat(s["out"], piece)).otherwise(s["out"])
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), more.alias("out"))

    finish = lambda s: F.concat(F.array_join(s["out"], ""), F.substr(text, s["at"] + 1))
    return F.when(F.size(spans) > 0, F.aggregate(spans, state, step, finish)).otherwise(text)


def find(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans``.

    Two passes over the texts: one counts votes for the model, one decides; nothing is shuffled but
    counts. A null or empty text has no spans; repeated rows count each; columns of ``docs`` with
    one of the new names are replaced; an empty table gives no rows."""
    docs = docs.drop("base_spans", "spans", "_base", "_loose")
    spans = candidates(docs)
    return decide(spans, fit(spans))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with all spans in ``text`` replaced, and its other columns as they are."""
    others = [F.col(c) for c in docs.columns if c != "text"]
    found = find(docs.select("text", F.struct(*others).alias("_others") if others else F.lit(1).alias("_others")))
    text = redacted(F.col("text"), F.col("spans")).alias("text")
    return found.select(*[text if c == "text" else F.col("_others")[c].alias(c) for c in docs.columns])
