"""Live accuracy metrics over a stream of prediction records.

The evaluator reports running exact-match / execution accuracy while
predictions arrive. Here prediction files landing in a directory are a file
stream; the per-mode counts are a streaming aggregation whose state is one
row per mode (checkpointed in the shared folder, so a restarted query resumes
where it stopped). Ratios are derived from the counts in each micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusql.operators.metrics import verdict_counts
from corpusql.session import scratch_path
from corpusql.sources import schemas


def prediction_stream(spark: SparkSession, path: str, fmt: str = "parquet",
                      max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schemas.PREDICTION).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def live_counts(predictions: DataFrame) -> DataFrame:
    """Streaming per-mode counts (state: one row per mode)."""
    return verdict_counts(predictions, ["mode"]).drop("_gen_sum")


def with_ratios(counts: DataFrame) -> DataFrame:
    tot = F.col("total_examples")
    return counts.select(
        "*",
        (F.col("exact_match_count").cast("double") * 100.0 / tot).alias("running_em_pct"),
        (F.col("execution_match_count").cast("double") * 100.0 / tot).alias("running_exec_pct"))


def start_live_metrics(spark: SparkSession, source_path: str, sink_table: str,
                       checkpoint: str | None = None) -> StreamingQuery:
    """Run the live metrics into a memory table (``complete`` mode: one row per mode)."""
    checkpoint = checkpoint or scratch_path(spark, "live-metrics-ckpt")
    return (with_ratios(live_counts(prediction_stream(spark, source_path)))
            .writeStream.outputMode("complete").format("memory").queryName(sink_table)
            .option("checkpointLocation", checkpoint).start())
