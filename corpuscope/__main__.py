"""``spark-submit`` entry: ``python -m corpuscope --root s3a://bucket/root``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from corpuscope.plans.pipeline import STAGES, Job, run_pipeline
from corpuscope.sources.config import load_config


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="corpuscope", description=__doc__)
    parser.add_argument("--root", required=True, help="storage root of the corpus")
    parser.add_argument("--config", help="default: ROOT/domain_resources/config.json")
    parser.add_argument("--stages", nargs="+", choices=STAGES, default=list(STAGES))
    parser.add_argument("--no-parsed", action="store_true", help="do not write the parsed table")
    parser.add_argument("--decompose", action="store_true", help="compare nukta letters decomposed")
    args = parser.parse_args(argv)

    spark = SparkSession.builder.appName("corpuscope").getOrCreate()
    root = args.root.rstrip("/")
    config = load_config(spark, args.config or f"{root}/domain_resources/config.json")
    job = Job(spark, root, config, decompose=args.decompose)
    run_pipeline(job, not args.no_parsed, args.stages)


if __name__ == "__main__":
    main()
