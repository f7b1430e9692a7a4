"""Responses -> predicted SQL, normalized text, exact match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusql.functions import sqltext


def extract_predictions(responses: DataFrame, response_col: str = "response") -> DataFrame:
    """Add ``pred_sql`` and ``strategy`` (narrow projection)."""
    ex = sqltext.extract_sql(response_col)
    return (responses.withColumn("_ex", ex)
            .withColumn("pred_sql", F.col("_ex.sql"))
            .withColumn("strategy", F.col("_ex.strategy")).drop("_ex"))


def strategy_counts(extracted: DataFrame) -> DataFrame:
    return extracted.groupBy("strategy").agg(F.count("*").alias("n_responses"))


def normalize_texts(pairs: DataFrame, cols=("gold_sql", "pred_sql")) -> DataFrame:
    """``(sql, normalized)`` over the distinct SQL texts of the given columns."""
    texts = None
    for c in cols:
        t = pairs.select(F.col(c).alias("sql"))
        texts = t if texts is None else texts.unionByName(t)
    return (texts.where(F.col("sql").isNotNull()).distinct()
            .select("sql", sqltext.normalize_sql("sql").alias("normalized")))


def exact_match(pairs: DataFrame, gold: str = "gold_sql", pred: str = "pred_sql") -> DataFrame:
    """Add ``exact_match``: equality of normalized texts (computed in-row)."""
    return pairs.withColumn(
        "exact_match",
        F.coalesce(sqltext.normalize_sql(gold) == sqltext.normalize_sql(pred), F.lit(False)))
