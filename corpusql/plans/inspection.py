"""Inspection job: profile of a converted corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusql.operators import corpus, profile
from corpusql.sources import readers


def inspect_corpus(spark: SparkSession, path: str, fmt: str = "json", top: int = 10, samples: int = 3, seed: int = 42,
                   db_id: str | None = None) -> dict[str, DataFrame]:
    """The reports over a split directory, each a lazy DataFrame; ``db_id`` restricts all of
    them to one database."""
    examples = readers.scan_split_directory(spark, path, fmt)
    if db_id is not None:
        examples = corpus.filter_database(examples, db_id)
    return {
        "split_stats": profile.split_stats(examples),
        "lengths": profile.length_profile(examples),
        "top_databases": profile.top_databases(examples, top),
        "sql_features": profile.sql_feature_distribution(examples),
        "token_estimate": profile.token_estimate(examples),
        "samples": corpus.sample_examples(examples, samples, seed),
    }
