import os

# Small products gain nothing from threads; set before numpy is loaded here and in the workers.
os.environ.setdefault("OMP_NUM_THREADS", "1")

import pytest
from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.001"

PROSE = "The quick brown fox jumps over the lazy dog while seven other animals watch from the far side. "


@pytest.fixture(scope="session")
def tables():
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables")
    return SF_DIR


@pytest.fixture(scope="session")
def texts(spark, tables):
    rows = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text for r in rows}


#: Null, empty and blank texts, one word, repeated rows, a null id, one very long word, a long text.
HARD = [
    (1, None),
    (2, ""),
    (3, " \n\t\x0b \r\n"),
    (4, "word"),
    (5, PROSE * 3),
    (5, PROSE * 3),
    (None, PROSE * 3),
    (7, "x" * 200_000),
    (8, "alpha beta " * 60_000),
    (9, "Größe  œuvre  日本語 😀 é <|endoftext|> 'tis it's"),
]
#: Columns that operators make themselves or that are none of their business.
CLASHING = [
    "score", "kept", "spans", "base_spans", "ids", "starts", "bytes", "lang_pred", "n_words", "base_failed",
    "host_rejected", "n_tokens", "predicted", "values", "key", "n", "node", "row", "_range", "keys", "slot", "window",
]


@pytest.fixture(scope="session")
def hard(spark):
    """Hard rows with clashing columns, all null; two partitions."""
    docs = spark.createDataFrame(HARD, "doc_id bigint, text string").repartition(2)
    docs = docs.withColumns({c: F.lit(None).cast("string") for c in ("source", "lang", *CLASHING)})
    return docs.withColumn("n_chars", F.lit(None).cast("bigint"))


@pytest.fixture(scope="session")
def nothing(hard):
    return hard.where("false")
