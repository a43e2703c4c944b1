"""Quality rules per document, and verdicts on the hosts that documents come from.

All counts are worked out inside a document's row. Hosts are judged by how many of their documents
break a rule: rates of small hosts are shrunk towards the rate of all by a beta prior whose two
parameters are fitted to the hosts themselves (method of moments).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.rows import bind
from corpuscope.session import materialize

SYMBOLS = "#*$%&|<>"
#: A host is refused when its shrunk rate of failing documents is above this.
MAX_HOST_RATE = 0.5
_BLANKS = "\t\n\x0b\f\r "


def _is_repeated(j: Column, x: Column, runs: Column) -> Column:
    before, after = F.get(runs, j - 1)["h"], F.get(runs, j + 1)["h"]
    return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))


def document_rules(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words`` (bigint), ``base_failed`` and ``failed``.

    ``base_failed``: under 50 words, or over half of the words in repeated three-word windows.
    ``failed`` adds what counts against the host only: over one symbol in ten words, over 30
    repeated lines in a hundred, or a mean word length outside 2 to 15."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = bind(docs, _t=text)
    t = F.col("_t")
    plain = F.translate(t, "\t\n\x0b\f\r", " " * 5)
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, _BLANKS, "")) > 0)
    out = bind(
        out,
        _w=F.array_remove(F.split(plain, " ", -1), ""),
        _lines=F.when(F.contains(t, F.lit("\n")), lines).otherwise(F.array().cast("array<string>")),
        word_chars=F.length(F.translate(t, _BLANKS, "")).cast("bigint"),
        n_symbols=(F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("bigint"),
    )
    w = F.col("_w")
    window = F.transform(
        F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    )
    out = bind(
        out,
        _h=F.when(F.size(w) >= 3, window).otherwise(F.array().cast("array<bigint>")),
        n_words=F.size(w).cast("bigint"),
        n_dup_lines=(F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        _n_lines=F.size("_lines"),
    ).drop("_w", "_lines", "_t")
    # Equal windows stand next to each other once sorted; only texts that repeat one are sorted.
    placed = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = bind(out, _runs=F.when(F.size(F.array_distinct("_h")) < F.size("_h"), placed)).drop("_h")
    runs = F.col("_runs")
    repeated = F.filter(runs, lambda x, j: _is_repeated(j, x, runs))
    covered = F.array_distinct(F.flatten(F.transform(repeated, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    out = bind(out, n_repeat_words=F.when(runs.isNull(), 0).otherwise(F.size(covered)).cast("bigint")).drop("_runs")
    n = F.col("n_words")
    base = (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)
    more = (10 * F.col("n_symbols") > n) | (100 * F.col("n_dup_lines") > 30 * F.col("_n_lines"))
    more = more | (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n)
    return out.withColumns({"base_failed": base, "failed": base | more}).drop("_n_lines")


def host_verdicts(judged: DataFrame, host: str, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``(host, n_docs, n_failed, rate, host_rejected)`` from rows with ``failed``.

    The prior has the mean and the spread that the hosts' own rates show; where hosts differ no more
    than chance allows, or there is one host only, all weight is on the mean. Rows without a host
    are under no verdict. No rows for an empty table."""
    hosts = judged.where(F.col(host).isNotNull()).groupBy(host).agg(
        F.count(F.lit(1)).alias("n_docs"), F.count_if("failed").alias("n_failed")
    )
    hosts = materialize(hosts, "hosts")
    r = F.col("n_failed") / F.col("n_docs")
    total = hosts.agg(
        F.count(F.lit(1)).alias("hosts"),
        F.sum("n_docs").alias("docs"),
        F.sum("n_failed").alias("failed"),
        F.sum(F.col("n_docs") * r * r).alias("squares"),
    ).first()
    alpha, beta = beta_prior(total.hosts, total.docs or 0, total.failed or 0, total.squares or 0.0)
    rate = (F.col("n_failed") + F.lit(alpha)) / (F.col("n_docs") + F.lit(alpha + beta))
    return hosts.select("*", rate.alias("rate"), (rate > F.lit(max_rate)).alias("host_rejected"))


#: The prior weighs as much as so many documents at most.
MAX_WEIGHT = 1000.0


def beta_prior(hosts: int, docs: int, failed: int, squares: float) -> tuple[float, float]:
    """Parameters of the beta prior from document-weighted moments of the hosts' rates."""
    if not docs:
        return 0.5, 0.5
    mean = min(max(failed / docs, 1e-6), 1 - 1e-6)
    spread = squares / docs - (failed / docs) ** 2
    # What binomial noise alone would add to the spread.
    noise = mean * (1 - mean) * hosts / docs
    between = spread - noise
    weight = MAX_WEIGHT
    if between > 0:
        weight = min(max(mean * (1 - mean) / between - 1, 1.0), MAX_WEIGHT)
    return mean * weight, (1 - mean) * weight


def quality_rules(
    docs: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE, carry_text: bool = True
) -> DataFrame:
    """``docs`` with the columns of ``document_rules``, ``host_rejected`` and ``kept``.

    A document is kept when it breaks no base rule and its host isn't refused. A null or empty text
    has no words and fails; a null host is never refused; repeated rows count each. Columns of
    ``docs`` that have one of the new names are replaced. An empty table gives no rows. The rows
    with their counts are written once, since both the hosts and the verdicts read them; ``carry_text=False``
    leaves the texts out of what is written and returned. The table of hosts is joined by broadcast where Spark finds its file small and by a shuffle otherwise."""
    judged = document_rules(docs)
    judged = materialize(judged if carry_text else judged.drop("text"), "judged")
    verdicts = host_verdicts(judged, host, max_rate).select(F.col(host).alias("_host"), "host_rejected")
    out = judged.drop("host_rejected", "kept").join(verdicts, F.col(host) == F.col("_host"), "left").drop("_host")
    rejected = F.coalesce("host_rejected", F.lit(False))
    return out.withColumns({"host_rejected": rejected, "kept": ~F.col("base_failed") & ~rejected})
