"""The whole job: raw shards -> parsed -> labelled -> statistics and audits.

The text is read by three steps only: parsing, labelling and the two samples. Labelling also leaves
what the later steps want to know about a text as narrow columns next to it (leading shingle, place
counts, gender evidence), so duplicates and both audits read a few bytes per document.
"""

from __future__ import annotations

import warnings
import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.functions import text as T
from corpuscope.functions.profiles import BENGALI, ScriptProfile
from corpuscope.operators import aggregates, dedup, gender, geo, topics, vocab
from corpuscope.operators.bengali import (
    DOMAINS,
    FEMALE_PREFIXES,
    MALE_PREFIXES,
    PLACES,
    bengali_model,
)
from corpuscope.operators.domain import DomainModel, domain_distribution, infer_domain
from corpuscope.operators.sampling import keyed_sample, sample_bucket
from corpuscope.session import materialize
from corpuscope.sources import writers
from corpuscope.sources.config import JobConfig
from corpuscope.sources.lexicons import load_lexicon, load_lexicons
from corpuscope.sources.shards import check_script, parse_documents

# Column names of the written tables, where they differ from the operators'.
TABLE_NAMES = {"primary_token_count": "bangla_token_count", "mix_rate": "banglish_rate"}
SEED = "42:"
#: The folders of the labelled table. A row is sampled by its key, whatever its text.
BUCKET = "sample_bucket"


@dataclass(frozen=True)
class Job:
    """One corpus under one storage root.

    ``decompose`` compares texts and word lists in the form that writes nukta letters as two code
    points. Without it a word only matches a text that happens to use the same form."""

    spark: SparkSession
    root: str
    config: JobConfig = JobConfig()
    profile: ScriptProfile = BENGALI
    decompose: bool = False

    def lists(self, paths: Mapping[str, str]) -> dict[str, tuple[str, ...]]:
        loaded = load_lexicons(self.spark, paths)
        if not self.decompose:
            return loaded
        return {n: tuple(dict.fromkeys(map(T.decompose_nukta_str, ws))) for n, ws in loaded.items()}

    def path(self, part: str) -> str:
        return f"{self.root.rstrip('/')}/{part}"

    def output(self, part: str) -> str:
        return self.path(f"{self.config.output.rstrip('/')}/{part}")


def _renamed(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def _read(job: Job, part: str) -> DataFrame:
    back = {v: k for k, v in TABLE_NAMES.items()}
    return _renamed(job.spark.read.parquet(job.path(part)), back)


def _row_key(docs: DataFrame) -> str:
    """Documents from elsewhere need not have keys of rows; their text must do then."""
    return "row_key" if "row_key" in docs.columns else "text"


def _sample(job: Job, fraction: float) -> DataFrame:
    """A sample of the labelled table, from its first folders."""
    docs = _read(job, job.config.labelled)
    return keyed_sample(docs, _row_key(docs), fraction, SEED, BUCKET if BUCKET in docs.columns else None)


def parsed_corpus(job: Job) -> DataFrame:
    raw = job.path(job.config.raw)
    check_script(job.spark, raw, job.profile)
    return parse_documents(job.spark, raw, job.profile, with_id=True, with_key=True)


def parse_stage(job: Job) -> None:
    parsed = parsed_corpus(job)
    writers.write_parquet(_renamed(parsed, TABLE_NAMES), job.path(job.config.parsed))


def load_model(job: Job) -> DomainModel:
    folder = job.path(job.config.lexicon_dir.rstrip("/"))
    return bengali_model(job.lists({d: f"{folder}/{d}.txt" for d in DOMAINS}))


def load_gender_lexicon(job: Job) -> gender.GenderLexicon:
    folder = job.path(job.config.bias_dir.rstrip("/"))
    names = ("occupation_markers", "male_markers", "female_markers")
    lists = job.lists({n: f"{folder}/{n}.txt" for n in names})
    return gender.GenderLexicon.of(
        *(lists[n] for n in names),
        male_prefixes=MALE_PREFIXES,
        female_prefixes=FEMALE_PREFIXES,
    )


def labelled_corpus(
    job: Job,
    parsed: DataFrame,
    model: DomainModel,
    lexicon: gender.GenderLexicon,
    places: Mapping[str, Sequence[str]] = PLACES,
) -> DataFrame:
    """One narrow pass: the label, and what later steps want to know about the text."""
    cfg = job.config
    column = "_text" if job.decompose else "text"
    if job.decompose:
        parsed = parsed.withColumn(column, T.decompose_nukta("text"))
    present = {p: f"_place_{i}" for i, p in enumerate(places)}
    labelled = infer_domain(
        parsed, model, job.profile, column, flags={present[p]: places[p] for p in places}
    )
    labelled = geo.with_place_counts(labelled, places, column, present).drop(*present.values())
    labelled = gender.with_gender_evidence(labelled, lexicon, text_col=column).drop("_text")
    labelled = dedup.with_leading_shingle(labelled, job.profile, cfg.shingle_size, cfg.min_tokens)
    return labelled


def label_stage(
    job: Job,
    parsed: DataFrame,
    model: DomainModel,
    lexicon: gender.GenderLexicon,
    places: Mapping[str, Sequence[str]] = PLACES,
) -> None:
    table = job.config.labelled
    labelled = labelled_corpus(job, parsed, model, lexicon, places)
    labelled = labelled.withColumn(BUCKET, sample_bucket(_row_key(labelled), SEED))
    writers.write_parquet(_renamed(labelled, TABLE_NAMES), job.path(table), partition_by=BUCKET)
    writers.write_csv(domain_distribution(_read(job, table)), job.output("domain_distribution"))


def statistics_stage(job: Job) -> None:
    stats = aggregates.domain_stats(_read(job, job.config.labelled))
    renamed = _renamed(stats, {"avg_mix_rate": "avg_banglish_rate"})
    writers.write_csv(renamed, job.output("domain_stats"))


def vocabulary_stage(job: Job) -> None:
    sample = _sample(job, job.config.vocabulary_fraction)
    counts = materialize(vocab.token_counts(vocab.token_rows(sample, job.profile)), "token-counts")
    if counts.isEmpty():
        warnings.warn("the vocabulary sample holds no token of the script; no vocabulary is written", stacklevel=2)
        return
    writers.write_csv(vocab.type_token_ratio(counts), job.output("ttr"))
    writers.write_parquet(vocab.top_tokens(counts, 100), job.output("token_frequency"))


def duplicate_stage(job: Job) -> None:
    k = job.config.shingle_size
    docs = _read(job, job.config.labelled)
    distinct = dedup.distinct_documents(docs, digest=True)
    groups = materialize(dedup.shingle_groups(distinct), "shingle-groups")
    writers.write_csv(dedup.near_dup_by_domain(groups), job.output("domain_dup_breakdown"))
    top = materialize(dedup.top_dup_clusters(dedup.near_dup_clusters(groups), 50), "top-clusters")
    writers.write_csv(dedup.with_shingle_text(top, docs), job.output("top_dup_clusters"))
    # All documents have been counted with their shingles.
    near = dedup.dup_summary(groups).first()
    before, after = near.documents_before, near.documents_after
    report = job.spark.range(1).select(
        F.lit(before).alias("documents_before_exact_deduplication"),
        F.lit(after).alias("documents_after_exact_deduplication"),
        F.lit(before - after).alias("exact_duplicates"),
        F.lit(round((before - after) / before, 4) if before else 0.0).alias("exact_duplicate_rate"),
        F.lit("shingle_fingerprinting").alias("method"),
        F.lit(k).alias("shingle_size"),
        F.lit(near.eligible_documents).alias("docs_with_enough_tokens"),
        F.lit(near.near_duplicate_clusters).alias("near_duplicate_clusters"),
        F.lit(near.near_duplicate_documents).alias("near_duplicate_documents"),
        F.lit(round(near.near_duplicate_rate, 4)).alias("near_duplicate_rate"),
        F.lit(f"Documents that share their first {k} script tokens form a cluster.").alias("note"),
    )
    writers.write_json_report(report, job.output("dedup_stats"))


def topic_stage(job: Job) -> float:
    """Writes topics and model; returns the log perplexity."""
    cfg = job.config
    stopwords = load_lexicon(job.spark, job.path(cfg.stopwords))
    sample = _sample(job, cfg.lda_fraction)
    tokens = topics.topic_tokens(sample, job.profile, stopwords)
    model = topics.fit_topics(
        tokens, cfg.topics, cfg.max_iterations, cfg.vocabulary_size, cfg.min_df
    )
    long = model.topics(15)
    wide = topics.topics_wide(long)
    writers.write_csv(wide.orderBy("topic"), job.output("topics_csv"))
    writers.write_parquet(long, job.output("topic_terms"))
    log_perplexity, log_likelihood = model.fit_quality()
    fit = job.spark.range(1).select(
        F.lit(round(log_perplexity, 4)).alias("log_perplexity"),
        F.lit(round(log_likelihood, 4)).alias("log_likelihood"),
        F.lit(cfg.topics).alias("num_topics"),
        F.lit(cfg.max_iterations).alias("max_iterations"),
        F.lit(len(model.vectorizer.vocabulary)).alias("vocabulary_size"),
    )
    # A line per topic, and one about the fit.
    terms = F.split("top_words", ", ").alias("terms")
    report = wide.select(F.to_json(F.struct("topic", terms))).union(
        fit.select(F.to_json(F.struct("*")))
    )
    report.write.mode("overwrite").text(job.output("topics_json"))
    model.save(job.path(cfg.models))
    return log_perplexity


def audit_stage(
    job: Job, lexicon: gender.GenderLexicon, places: Mapping[str, Sequence[str]] = PLACES
) -> None:
    docs = _read(job, job.config.labelled)
    bias = materialize(
        gender.gender_bias(gender.gender_scores(docs), lexicon.occupations), "gender-bias"
    ).withColumn("doc_count", F.col("doc_count").cast("string"))
    mentions = materialize(geo.place_mentions(docs, list(places)), "place-mentions")
    mentions = _renamed(mentions, {"place": "division"})
    writers.write_json_lines(bias, job.output("bias/gender_bias"))
    writers.write_json_lines(mentions, job.output("bias/geographic_bias"))

    # Both tables have a row per list entry and domain, which is few enough for one document.
    def listed(df: DataFrame, name: str) -> DataFrame:
        entry = F.struct("*").alias("row")
        return df.select(F.lit(name).alias("part"), F.to_json(entry, {"ignoreNullFields": "false"}).alias("row"))

    rows = listed(bias, "gender_bias").unionByName(listed(mentions, "geographic_bias"))
    per_part = rows.agg(
        *[
            F.array_join(F.sort_array(F.collect_list(F.when(F.col("part") == p, F.col("row")))), ",")
            .alias(p)
            for p in ("gender_bias", "geographic_bias")
        ]
    )
    document = F.concat(
        F.lit('{"gender_bias":['),
        F.col("gender_bias"),
        F.lit('],"geographic_bias":['),
        F.col("geographic_bias"),
        F.lit("]}"),
    )
    summary = job.output("bias/summary_gender_geo")
    per_part.select(document).write.mode("overwrite").text(summary)


def totals_stage(job: Job, log_perplexity: float, seconds: float) -> None:
    totals = aggregates.corpus_totals(_read(job, job.config.labelled))
    report = totals.select(
        "*",
        F.lit(round(log_perplexity, 4)).alias("lda_log_perplexity"),
        F.lit(round(seconds, 2)).alias("benchmark_time_seconds"),
    )
    writers.write_json_report(report, job.output("benchmark"))


def analytics(job: Job) -> None:
    start = time.monotonic()
    statistics_stage(job)
    vocabulary_stage(job)
    duplicate_stage(job)
    log_perplexity = topic_stage(job)
    totals_stage(job, log_perplexity, time.monotonic() - start)


STAGES = ("parse", "label", "analytics", "audit")


def run_pipeline(
    job: Job, keep_parsed: bool = True, stages: Sequence[str] = STAGES
) -> None:
    """Runs the stages asked for, in their order; each picks up the tables of the ones before.

    ``keep_parsed=False`` labels while parsing and never writes the parsed table, which spares
    one write and one read of the whole corpus."""
    if set(stages) - set(STAGES):
        raise ValueError(f"unknown stages: {sorted(set(stages) - set(STAGES))}")
    if job.config.shuffle_partitions:
        job.spark.conf.set("spark.sql.shuffle.partitions", str(job.config.shuffle_partitions))
    if "parse" in stages and keep_parsed:
        parse_stage(job)
    if "label" in stages:
        parsed = _read(job, job.config.parsed) if keep_parsed else parsed_corpus(job)
        label_stage(job, parsed, load_model(job), load_gender_lexicon(job))
    if "analytics" in stages:
        analytics(job)
    if "audit" in stages:
        audit_stage(job, load_gender_lexicon(job))
