"""Job settings from a JSON file."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class JobConfig:
    """Paths are relative to the storage root of the job."""

    raw: str = "corpus/raw/*.txt"
    parsed: str = "corpus/parsed/"
    labelled: str = "corpus/labelled/"
    lexicon_dir: str = "domain_resources/lexicons/"
    stopwords: str = "domain_resources/bangla_stopwords.txt"
    bias_dir: str = "bias_resources/"
    output: str = "output/"
    models: str = "models/"
    vocabulary_fraction: float = 0.1
    lda_fraction: float = 0.2
    shingle_size: int = 8
    min_tokens: int = 8
    topics: int = 20
    max_iterations: int = 20
    vocabulary_size: int = 50_000
    min_df: float = 5
    shuffle_partitions: int | None = None

    @classmethod
    def from_dict(cls, d: Mapping) -> JobConfig:
        paths, sampling = d.get("paths", {}), d.get("sampling", {})
        dup, lda, spark = d.get("duplicate_detection", {}), d.get("lda", {}), d.get("spark", {})
        k = int(dup.get("shingle_size", 8))
        found = {
            "raw": paths.get("raw_corpus"),
            "parsed": paths.get("parsed_corpus"),
            "labelled": paths.get("labelled_corpus"),
            "lexicon_dir": paths.get("lexicon_dir"),
            "stopwords": paths.get("stopwords"),
            "bias_dir": paths.get("bias_dir"),
            "output": paths.get("output"),
            "models": paths.get("models"),
            "vocabulary_fraction": sampling.get("vocabulary"),
            "lda_fraction": sampling.get("lda"),
            "shingle_size": k,
            "min_tokens": int(dup.get("min_tokens", k)),
            "topics": lda.get("topics"),
            "max_iterations": lda.get("max_iterations"),
            "vocabulary_size": lda.get("vocabulary_size"),
            "min_df": lda.get("min_df"),
            "shuffle_partitions": spark.get("shuffle_partitions"),
        }
        return cls(**{k: v for k, v in found.items() if v is not None})


def load_config(spark: SparkSession, path: str) -> JobConfig:
    text = spark.read.text(path, wholetext=True).first()
    if text is None:
        raise ValueError(f"empty configuration: {path}")
    return JobConfig.from_dict(json.loads(text.value))
