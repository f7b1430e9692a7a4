"""Corpus profiling: lengths, database frequencies, SQL features, token budget.

Every statistic is one aggregation pass with partial (map-side) aggregation;
percentages divide by a scalar subquery, never by a cross join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusql.functions import sqltext
from corpusql.functions.text import word_count


def _len_stats(col: str, alias: str) -> list:
    n = F.length(col).cast("bigint")
    return [F.min(n).alias(f"min_{alias}"), F.max(n).alias(f"max_{alias}"),
            (F.sum(n).cast("double") / F.count(F.lit(1))).alias(f"avg_{alias}")]


def split_stats(examples: DataFrame) -> DataFrame:
    """Per split: rows, distinct databases, schema and query length (characters)."""
    return examples.groupBy("split").agg(
        F.count("*").alias("n_examples"),
        F.countDistinct("db_id").alias("n_databases"),
        *_len_stats("schema", "schema_len"), *_len_stats("output", "query_len"))


def length_profile(examples: DataFrame) -> DataFrame:
    """One dataset: rows, databases, schema/query length, question length in words."""
    words = word_count("question").cast("bigint")
    return examples.agg(
        F.count("*").alias("n_examples"),
        F.countDistinct("db_id").alias("n_databases"),
        *_len_stats("schema", "schema_len"), *_len_stats("output", "query_len"),
        F.min(words).alias("min_question_words"), F.max(words).alias("max_question_words"),
        (F.sum(words).cast("double") / F.count(F.lit(1))).alias("avg_question_words"))


def top_databases(examples: DataFrame, k: int = 10) -> DataFrame:
    """Most frequent databases; ties keep first-seen order (smallest ``pos``)."""
    total = examples.agg(F.count("*")).scalar()
    counts = examples.groupBy("db_id").agg(F.count("*").alias("n_examples"),
                                           F.min("pos").alias("first_pos"))
    return (counts.orderBy(F.desc("n_examples"), "first_pos").limit(k)
            .select("db_id", "n_examples",
                    (F.col("n_examples").cast("double") * 100.0 / total).alias("pct")))


def sql_feature_flags(examples: DataFrame, sql_col: str = "output") -> DataFrame:
    return examples.select("pos", "db_id", sqltext.feature_flags(sql_col).alias("features"))


def sql_feature_distribution(examples: DataFrame, sql_col: str = "output") -> DataFrame:
    """``(feature, n_examples, pct)`` for features present at least once."""
    ind = sqltext.distribution_indicators(sql_col)
    sums = examples.agg(F.count(F.lit(1)).alias("_total"),
                        *[F.sum(c).alias(f"_f{i}") for i, c in enumerate(ind)])
    stacked = sums.select("_total", F.inline(F.array(*[
        F.struct(F.lit(name).alias("feature"), F.col(f"_f{i}").alias("n_examples"))
        for i, name in enumerate(sqltext.DISTRIBUTION_FEATURES)])))
    return (stacked.where(F.col("n_examples") > 0)
            .select("feature", F.col("n_examples").cast("bigint").alias("n_examples"),
                    (F.col("n_examples").cast("double") * 100.0 / F.col("_total")).alias("pct")))


def token_estimate(examples: DataFrame, limits=(512, 1024)) -> DataFrame:
    """``chars // 4`` over instruction + schema + question + output."""
    est = F.floor((F.length("instruction") + F.length("schema") + F.length("question")
                   + F.length("output")) / 4).cast("bigint")
    aggs = [F.count(F.lit(1)).alias("n_examples"), F.min(est).alias("min_tokens"),
            F.max(est).alias("max_tokens"),
            (F.sum(est).cast("double") / F.count(F.lit(1))).alias("avg_tokens")]
    for lim in limits:
        aggs.append(F.count(F.when(est > lim, 1)).alias(f"n_over_{lim}"))
    out = examples.agg(*aggs)
    for lim in limits:
        out = out.withColumn(f"pct_over_{lim}",
                             F.col(f"n_over_{lim}").cast("double") * 100.0 / F.col("n_examples"))
    return out
