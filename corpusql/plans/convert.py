"""Conversion job: catalog and raw examples on files -> instruction sets and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusql.operators import catalog as cat
from corpusql.operators import corpus
from corpusql.session import stored
from corpusql.sources import readers, writers


def convert(spark: SparkSession, catalog_path: str, train_path: str, test_path: str, out: str, val_ratio: float = 0.1,
            seed: int = 42, test_split: str = "dev", fmt: str = "json") -> DataFrame:
    """Writes ``out/splits`` (train, val and ``test_split``) and ``out/metadata``; returns the
    one-row metadata. The schema lookup is built once and read by both example files."""
    catalog = readers.scan_catalog(spark, catalog_path)
    lookup = stored(cat.schema_lookup(cat.schema_ddl(catalog)), "schema-lookup")
    train = corpus.convert_examples(readers.scan_examples(spark, train_path), lookup)
    test = corpus.convert_examples(readers.scan_examples(spark, test_path), lookup)
    examples = corpus.split_by_database(train, val_ratio, seed).unionByName(test.withColumn("split", F.lit(test_split)))
    writers.write_splits(examples, f"{out}/splits", fmt=fmt)
    written = readers.scan_split_directory(spark, f"{out}/splits", fmt)
    metadata = writers.conversion_metadata(written, catalog, train_path, val_ratio, seed, test_split)
    writers.write_metadata(metadata, f"{out}/metadata")
    return metadata
