"""Evaluation job: examples + responses -> predictions -> metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusql.operators import execution, matching, metrics, prompting
from corpusql.plans import fixtures as fx
from corpusql.session import stored
from corpusql.sources import writers
from corpusql.sources.registry import DatabaseSessions


def exact_match_by_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimum slice: converted examples joined to their responses, SQL extracted,
    exact match scored, accuracy aggregated per database."""
    ex = fx.instruction_examples(spark, sf_dir)
    resp = fx.responses(spark, sf_dir).select("pos", "response")
    scored = (matching.extract_predictions(ex.join(resp, "pos"))
              .transform(lambda d: matching.exact_match(d, "output", "pred_sql")))
    return scored.groupBy("db_id").agg(
        F.count("*").alias("n_examples"),
        F.count(F.when(F.col("exact_match"), 1)).alias("exact_match_count"),
        (F.count(F.when(F.col("exact_match"), 1)).cast("double") * 100.0 / F.count("*"))
        .alias("exact_match_accuracy"))


def prompts_for(test: DataFrame, train: DataFrame, mode: str, k: int = 3, seed: int = 42) -> DataFrame:
    """``(index, db_id, prompt)`` of one mode."""
    if mode == "zero-shot":
        return prompting.prompt_zero_shot(test, key="index")
    return prompting.prompt_few_shot(test, prompting.select_few_shot(test, train, k, seed))


def evaluate(spark: SparkSession, test: DataFrame, responses: DataFrame, sessions: DatabaseSessions, out: str,
             k: int = 3, seed: int = 42, fmt: str = "json") -> tuple[DataFrame, DataFrame]:
    """Scores the responses of all modes that ran and writes predictions, metrics and
    configuration; returns the metrics and the comparison of both modes (empty unless both ran).

    ``test(index, db_id, question, output)``, ``responses(mode, index, response,
    generation_time_s)``.
    """
    preds = stored(matching.extract_predictions(responses), "predictions")
    pairs = (preds.join(test.select("index", "db_id", "output"), "index")
             .select(F.struct("mode", "index").alias("example_id"), "db_id", F.col("output").alias("gold_sql"), "pred_sql"))
    verdicts = execution.execution_accuracy(spark, pairs, sessions).select(
        "example_id.mode", "example_id.index", "exec_match", "pred_error", "db_found")
    records = stored(metrics.prediction_records(test, preds, verdicts), "records")
    summary = metrics.eval_metrics(records)
    writers.write_results(records, summary, out, fmt=fmt, num_few_shot=k, seed=seed)
    return summary, metrics.mode_comparison(summary)
