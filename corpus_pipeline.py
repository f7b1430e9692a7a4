"""A corpus pipeline of five stages, each one of the operators of ``corpusql.llm``.

Each function takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and
reread as the next one's ``docs``. All but the last return the columns of ``documents``:

1. quality: documents that the classifier rejects go;
2. near_dedup: one document of each SimHash group stays;
3. substring_dedup: words in windows that an earlier document has are cut from the
   texts; a document that loses all its words stays, with an empty text;
4. mix: documents are left out or repeated so that each source comes to its target;
5. tokens: ``(doc_id, n_ids, ids, decoded_sha256)`` per row.

Nulls, empty and repeated rows are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusql.llm import fmindex, mixing, pieces, quality, simhash
from corpusql.llm.common import stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), settled=True)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = fmindex.without_repeats(docs)
    if "n_chars" not in docs.columns:
        return cut
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("mix", mix_stage),
    ("tokens", token_stage),
]

#: The classifier, the fingerprints and the pieces have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
