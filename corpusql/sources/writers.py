"""Sinks: split sets, conversion metadata, evaluation results.

Outputs are partitioned directories (JSON Lines or Parquet), UTF-8 with
non-ASCII text kept as is. Writes are whole-directory commits through Spark's
output committer, so a lost executor only re-runs its tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INSTRUCTION_COLUMNS = ["instruction", "schema", "question", "output", "db_id", "pos"]


def write_splits(examples: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """``examples`` carries a ``split`` column; one sub-directory per split."""
    (examples.select(*INSTRUCTION_COLUMNS, "split")
     .repartitionByRange("split", "db_id", "pos")      # a large database spans files
     .sortWithinPartitions("split", "db_id", "pos")
     .write.mode(mode).partitionBy("split").format(fmt).save(path))


def conversion_metadata(examples: DataFrame, catalog: DataFrame, source: str,
                        val_ratio: float, seed: int, test_split: str = "dev") -> DataFrame:
    """One-row metadata: counts per split and the number of *catalog* databases."""
    counts = examples.groupBy().agg(
        F.count(F.when(F.col("split") == "train", 1)).alias("train"),
        F.count(F.when(F.col("split") == "val", 1)).alias("val"),
        F.count(F.when(F.col("split") == test_split, 1)).alias("dev_test"),
    )
    n_db = catalog.agg(F.countDistinct("db_id").alias("total"))
    return counts.select(
        F.lit(source).alias("source"),
        F.lit(float(val_ratio)).alias("val_ratio"),
        F.lit(int(seed)).alias("seed"),
        F.struct("train", "val", "dev_test").alias("counts"),
        F.struct(n_db.scalar().alias("total")).alias("num_databases"),
    )


def write_metadata(metadata: DataFrame, path: str, mode: str = "overwrite") -> None:
    metadata.coalesce(1).write.mode(mode).json(path)


def run_config(metrics: DataFrame, num_few_shot: int, seed: int) -> DataFrame:
    """``(mode, num_few_shot, seed, total_examples)`` of each mode that ran."""
    return metrics.select("mode", F.when(F.col("mode") == "few-shot", F.lit(num_few_shot)).otherwise(F.lit(0)).alias("num_few_shot"),
                          F.lit(int(seed)).alias("seed"), "total_examples")


def write_results(predictions: DataFrame, metrics: DataFrame, path: str,
                  fmt: str = "json", mode: str = "overwrite", num_few_shot: int = 0, seed: int = 42) -> None:
    """Predictions, metrics and run configuration, each partitioned by ``mode``."""
    run_config(metrics, num_few_shot, seed).write.mode(mode).partitionBy("mode").format(fmt).save(f"{path}/config")
    predictions.write.mode(mode).partitionBy("mode").format(fmt).save(f"{path}/predictions")
    metrics.write.mode(mode).partitionBy("mode").format(fmt).save(f"{path}/metrics")


def content_digest(columns: dict[str, str]) -> F.Column:
    """Order-free digest of rows: the sum of 48 bits of md5 over the columns' texts, each by the SQL expression
    given for it; NULL is a text of its own. As a string, since it grows with the rows."""
    key = F.concat_ws("\u001f", *[F.coalesce(F.expr(e).cast("string"), F.lit("\u001e")) for e in columns.values()])
    return F.sum(F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("decimal(38,0)")).cast("string")


#: Columns of a stored prediction as texts that do not depend on how a number is printed.
PREDICTION_TEXTS = {c: c for c in ("index", "db_id", "question", "gold_sql", "pred_sql")} | {
    c: f"cast({c} as int)" for c in ("exact_match", "exec_match", "db_found")} | {
    "pred_error": "pred_error", "generation_time_s": "cast(floor(generation_time_s * 1000) as bigint)"}


def read_results(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """A written bundle as one row per mode: the metrics, the configuration, and count and digest of the
    predictions. A mode that any of the three lacks is there with NULLs, so a lost part shows."""
    def part(name: str, schema: str) -> DataFrame:
        return spark.read.schema(schema).format(fmt).load(f"{path}/{name}")
    predictions = part("predictions", PREDICTION_FIELDS).groupBy("mode").agg(
        F.count("*").alias("n_predictions"), content_digest(PREDICTION_TEXTS).alias("predictions_digest"))
    config = part("config", CONFIG_FIELDS).withColumnRenamed("total_examples", "config_examples")
    return part("metrics", METRIC_FIELDS).join(config, "mode", "full").join(predictions, "mode", "full")


PREDICTION_FIELDS = ("mode string, index bigint, db_id string, question string, gold_sql string, pred_sql string, exact_match boolean, "
                     "exec_match boolean, pred_error string, generation_time_s double, db_found boolean")
CONFIG_FIELDS = "mode string, num_few_shot int, seed int, total_examples bigint"
METRIC_FIELDS = ("mode string, total_examples bigint, exact_match_accuracy double, execution_accuracy double, exact_match_count bigint, "
                 "execution_match_count bigint, execution_error_count bigint, error_rate double, avg_generation_time_s double")
