import glob
import json
import os
import random
import shutil

import pytest
from pyspark.ml.clustering import LocalLDAModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import functions as F

from corpuscope.__main__ import main
from corpuscope.functions import text as T
from corpuscope.operators import gender, topics
from corpuscope.operators.bengali import DOMAINS, bengali_model
from corpuscope.plans import pipeline
from corpuscope.plans.pipeline import (
    Job,
    label_stage,
    labelled_corpus,
    load_gender_lexicon,
    load_model,
    parsed_corpus,
    run_pipeline,
)
from corpuscope.sources.config import JobConfig

WORDS = ["কথা", "নদী", "আকাশ", "বই", "মানুষ", "সময়", "গান", "পাখি", "ফুল", "ঘর"]
SEEDS = {
    "news": ["সংবাদ"], "encyclopedia": ["বিশ্বকোষ"], "education": ["পরীক্ষা"],
    "blogs": ["ব্লগ"], "social": ["পোস্ট"], "literature": ["কবিতা"],
}


@pytest.fixture(scope="module")
def job(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    rng = random.Random(5)

    def put(name, content):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content, encoding="utf-8")

    docs = []
    for i in range(120):
        seed = SEEDS[DOMAINS[i % 6]][0]
        body = [rng.choice(WORDS) for _ in range(40)]
        body[20:20] = ["নারী", "ডাক্তার"] if i % 2 else ["ভাই", "শিক্ষক"]
        place = "ঢাকা" if i % 4 else "সিলেট"
        docs.append(f"{seed} {seed} {seed} {place}\n{' '.join(body)}")
    docs += [docs[0], docs[0] + "\nশেষ", docs[0].replace("\n", " ") + " আরও"]
    for part in range(3):
        put(f"corpus/raw/{part}.txt", "\n\n".join(docs[part::3]) + "\n")
    for d, seeds in SEEDS.items():
        put(f"domain_resources/lexicons/{d}.txt", "\n".join(seeds))
    put("domain_resources/bangla_stopwords.txt", "কথা\nবই\n")
    put("bias_resources/occupation_markers.txt", "ডাক্তার\nশিক্ষক\nবিচারক\n")
    put("bias_resources/male_markers.txt", "ভাই\nবাবা\n")
    put("bias_resources/female_markers.txt", "বোন\nমা\n")
    config = JobConfig(
        vocabulary_fraction=1.0, lda_fraction=1.0, topics=2, max_iterations=3, vocabulary_size=50, min_df=1
    )
    made = Job(spark, str(root), config)
    run_pipeline(made)
    return made, docs


def lines(job, part):
    out = []
    for path in sorted(glob.glob(os.path.join(job.output(part), "part-*"))):
        with open(path, encoding="utf-8") as f:
            out += f.read().splitlines()
    return out


def table(job, part):
    return job.spark.read.csv(job.output(part), header=True, inferSchema=True)


def test_parsed_and_labelled_tables(job):
    job, docs = job
    parsed = job.spark.read.parquet(job.path("corpus/parsed/"))
    assert parsed.columns == [
        "doc_id", "text", "sentence_count", "token_count", "char_count", "bangla_token_count",
        "latin_token_count", "banglish_rate", "sha256", "predicted_domain", "row_key", "id",
    ]
    assert {r.text for r in parsed.select("text").collect()} == {d.replace("\n", " ") for d in docs}
    assert parsed.select("id").distinct().count() == len(docs)
    labelled = job.spark.read.parquet(job.path("corpus/labelled/"))
    counts = {r.predicted_domain: r["count"] for r in labelled.groupBy("predicted_domain").count().collect()}
    assert counts == {d: 20 + 3 * (d == "news") for d in DOMAINS}


def test_samples_read_their_share_of_the_files_and_copies_one_by_one(job):
    job, docs = job
    labelled = job.spark.read.parquet(job.path("corpus/labelled/"))
    for fraction, folders in ((0.1, 1), (0.2, 2), (0.25, 3), (1.0, 10)):
        sample = pipeline._sample(job, fraction)
        want = {r.row_key for r in labelled.where(T.keyed_uniform("row_key", pipeline.SEED) < fraction).collect()}
        assert {r.row_key for r in sample.collect()} == want
        read = {os.path.dirname(r[0]) for r in sample.select(F.input_file_name()).collect()}
        assert len(read) <= folders
        plan = sample._jdf.queryExecution().executedPlan().toString()
        assert fraction == 1.0 or "PartitionFilters: [isnotnull(sample_bucket" in plan
    copies = {r.row_key for r in labelled.where(F.col("text") == docs[0].replace("\n", " ")).collect()}
    assert len(copies) == 2  # each drawn by its own key


def test_statistics(job):
    job, docs = job
    stats = table(job, "domain_stats")
    assert "avg_banglish_rate" in stats.columns
    assert sum(r.document_count for r in stats.collect()) == len(docs)
    ttr = table(job, "ttr").collect()
    assert {r.predicted_domain for r in ttr} == set(DOMAINS)
    assert all(r.ttr == pytest.approx(r.unique_tokens / r.total_tokens) for r in ttr)
    top = job.spark.read.parquet(job.output("token_frequency"))
    assert top.columns == ["predicted_domain", "token", "count", "rank"]
    assert sum(r["count"] for r in table(job, "domain_distribution").withColumnRenamed("document_count", "count").collect()) == len(docs)


def test_duplicates(job):
    job, docs = job
    stats = json.loads("\n".join(lines(job, "dedup_stats")))
    assert stats["documents_before_exact_deduplication"] == len(docs)
    assert stats["exact_duplicates"] == 1 and stats["shingle_size"] == 8
    by = {r.predicted_domain: r.near_dup_doc_count for r in table(job, "domain_dup_breakdown").collect()}
    assert sum(by.values()) - stats["near_duplicate_clusters"] == stats["near_duplicate_documents"] >= 2
    top = table(job, "top_dup_clusters").collect()
    assert len(top) == stats["near_duplicate_clusters"] and top[0].cluster_size >= 3


def test_topics(job):
    job, _ = job
    wide = table(job, "topics_csv")
    assert wide.columns == ["topic", "top_words"] and wide.count() == 2
    report = [json.loads(x) for x in lines(job, "topics_json")]
    rows = [r for r in report if "topic" in r]
    assert sorted(r["topic"] for r in rows) == [0, 1] and len(report) == 3
    assert not {"কথা", "বই"} & {t for r in rows for t in r["terms"]}
    fit = next(r for r in report if "num_topics" in r)
    assert fit["num_topics"] == 2 and fit["log_perplexity"] > 0 > fit["log_likelihood"]
    lda = LocalLDAModel.load(job.path("models/lda_model"))
    cv = CountVectorizerModel.load(job.path("models/count_vectorizer"))
    assert lda.vocabSize() == len(cv.vocabulary) == fit["vocabulary_size"]
    totals = json.loads("\n".join(lines(job, "benchmark")))
    assert totals["documents"] == 123 and totals["domains"] == 6


def test_audits(job):
    job, docs = job
    gender = [json.loads(x) for x in lines(job, "bias/gender_bias")]
    overall = {r["occupation"]: r for r in gender if r["domain"] == "ALL"}
    assert overall["শিক্ষক"]["direction"] == "male-leaning"
    assert overall["ডাক্তার"]["direction"] == "female-leaning"
    assert overall["বিচারক"] == {
        "occupation": "বিচারক", "domain": "ALL", "avg_bias_score": None, "doc_count": "0",
        "direction": "insufficient data",
    }
    geo = [json.loads(x) for x in lines(job, "bias/geographic_bias")]
    assert set(geo[0]) == {"division", "domain", "total_mentions"}
    total = {r["division"]: r["total_mentions"] for r in geo if r["domain"] == "ALL"}
    assert total["Dhaka"] == sum("ঢাকা" in d for d in docs)
    assert total["Sylhet"] == sum("সিলেট" in d for d in docs) and len(total) == 8
    summary = json.loads("\n".join(lines(job, "bias/summary_gender_geo")))

    def key(r):
        return sorted((k, str(v)) for k, v in r.items())

    assert sorted(summary["gender_bias"], key=key) == sorted(gender, key=key)
    assert sorted(summary["geographic_bias"], key=key) == sorted(geo, key=key)


def test_topic_model_quality(spark):
    rows = [(["aa", "bb", "aa"],), (["cc", "dd"],), (["aa", "cc"],)] * 5
    df = spark.createDataFrame(rows, "tokens array<string>")
    model = topics.fit_topics(df, k=2, max_iter=3, vocabulary_size=10, min_df=2)
    perplexity, likelihood = model.fit_quality()
    assert perplexity == pytest.approx(model.lda.logPerplexity(model.vectors), rel=1e-6)
    assert likelihood == pytest.approx(model.lda.logLikelihood(model.vectors), rel=1e-6)
    rows = model.topics(3).collect()
    assert sorted({r.topic for r in rows}) == [0, 1] and sorted({r["rank"] for r in rows}) == [1, 2, 3]
    df = topics.document_frequency(df, 6)
    assert {(r.term, r.document_frequency, r.term_count) for r in df.collect()} == {("aa", 10, 15), ("cc", 10, 10)}


def test_stopwords_ignore_case_and_keep_glued_words(spark):
    df = spark.createDataFrame([(["The", "the,", "cat"],)], "raw_tokens array<string>")
    assert topics.remove_stopwords(df, ["the"]).first().tokens == ["the,", "cat"]


def test_command_line_without_the_parsed_table(job, tmp_path):
    job, docs = job
    for part in ("domain_resources", "bias_resources"):
        shutil.copytree(job.path(part), tmp_path / part)
    shutil.copytree(job.path("corpus/raw"), tmp_path / "corpus/raw")
    (tmp_path / "domain_resources/config.json").write_text('{"duplicate_detection": {"shingle_size": 8}}')
    other = Job(job.spark, str(tmp_path))
    main(["--root", str(tmp_path), "--no-parsed", "--stages", "parse", "label", "audit"])
    columns = ["text", "predicted_domain", "shingle", "place_counts", "gender_evidence", "token_count"]
    both = [
        sorted(map(str, j.spark.read.parquet(j.path("corpus/labelled/")).select(columns).collect()))
        for j in (job, other)
    ]
    assert both[0] == both[1] and len(both[0]) == len(docs)
    assert sorted(lines(job, "bias/gender_bias")) == sorted(lines(other, "bias/gender_bias"))
    assert not os.path.exists(other.path("corpus/parsed"))
    with pytest.raises(ValueError):
        run_pipeline(other, stages=["nonsense"])


def test_decomposed_comparison(spark, tmp_path):
    folder = tmp_path / "bias_resources"
    folder.mkdir()
    whole, parts = "প\u09dcু\u09dfা", "প\u09a1\u09bcু\u09af\u09bcা"
    for name, words in (("occupation", whole), ("male", "ভাই"), ("female", "বোন")):
        (folder / f"{name}_markers.txt").write_text(f"{words}\n", encoding="utf-8")
    for decompose, want in ((False, []), (True, [parts])):
        job = Job(spark, str(tmp_path), decompose=decompose)
        parsed = spark.createDataFrame([(f"ভাই {parts}", 2, 0)], "text string, token_count int, latin_token_count int")
        label_stage(job, parsed, bengali_model({}), load_gender_lexicon(job))
        row = spark.read.parquet(job.path("corpus/labelled/")).first()
        assert [e.occupation for e in row.gender_evidence] == want


def test_labelling_is_one_narrow_pass(job):
    job, _ = job
    model, lexicon = load_model(job), load_gender_lexicon(job)
    # From shards, all that is shuffled is the open ends of splits and counts of documents, file by file.
    df = labelled_corpus(job, parsed_corpus(job), model, lexicon)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == plan.count("Exchange hashpartitioning(file#") + plan.count("BroadcastExchange ")
    # The files themselves were read once, to write the table of pieces that is scanned here.
    assert "FileScan text" not in plan and "MapInArrow" not in plan
    texts = [line for line in plan.splitlines() if "FileScan" in line and "lines:string" in line]
    assert sum("whole#" in t and "= 1)" in t for t in texts) == 1  # the others scan open ends
    parsed = job.spark.createDataFrame([], parsed_corpus(job).schema)
    path = job.path("parsed-for-plan")
    parsed.write.mode("overwrite").parquet(path)
    df = labelled_corpus(job, job.spark.read.parquet(path), model, lexicon)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("FileScan") == 1
    # tokens for the counts, tokens for the shingle, normalised tokens, and two splits into lines
    assert plan.count("split(") <= 6
    assert plan.count("ArrowEvalPython") <= 1 and "BatchEvalPython" not in plan
    # the audits never see the text again
    labelled = job.spark.read.parquet(job.path("corpus/labelled/"))
    scores = gender.gender_scores(labelled)
    assert "text" not in scores._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
