"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusql.functions.prompts import CONFIG_PROMPT_TEMPLATE
from corpusql.operators import batches, catalog as cat, corpus, matching, metrics, profile, prompting
from corpusql.operators import execution
from corpusql.plans import fixtures as fx
from corpusql.session import scratch_path, stored
from corpusql.sources import readers, registry as reg, writers

Query = Callable[[SparkSession, str], DataFrame]


# ---------------------------------------------------------------- sources / sinks
def q_scan_catalog(spark, sf):
    path = scratch_path(spark, "catalog")
    fx.catalog(spark, sf).write.json(path)
    return readers.scan_catalog(spark, path).select(
        "db_id", "pos", "table_names_original", "column_names_original", "column_types",
        "primary_keys", "foreign_keys")


def _array_file(records: DataFrame, path: str) -> None:
    """The records as pretty-printed JSON arrays of ``fx.ARRAY_RECORDS`` each, without positions."""
    ordered = records.select(F.to_json(F.struct(*[c for c in records.columns if c != "pos"]), {"pretty": "true"}).alias("r"),
                             F.floor(F.col("pos") / fx.ARRAY_RECORDS).cast("bigint").alias("file"), "pos")
    files = ordered.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("pos", "r"))).alias("rs"))
    text = F.concat(F.lit("[\n"), F.array_join(F.transform("rs", lambda x: x["r"]), ",\n"), F.lit("\n]\n"))
    named = files.select(F.format_string("%08d", "file").alias("part"), text.alias("value"))
    named.repartition("part").write.option("lineSep", " ").partitionBy("part").text(path)


def q_scan_examples_array(spark, sf):
    """Examples of JSON arrays without positions: they come from the order of files and records."""
    path = scratch_path(spark, "examples-array")
    _array_file(fx.raw_examples(spark, sf), path)
    return readers.scan_examples(spark, path).select("db_id", "question", "query", "pos")


def q_scan_catalog_array(spark, sf):
    path = scratch_path(spark, "catalog-array")
    _array_file(fx.catalog(spark, sf), path)
    return readers.scan_catalog(spark, path).select(
        "db_id", "pos", "table_names_original", "column_names_original", "column_types", "primary_keys", "foreign_keys")


def q_scan_examples(spark, sf):
    path = scratch_path(spark, "raw-examples")
    fx.raw_examples(spark, sf).write.json(path)
    return readers.scan_examples(spark, path).select("db_id", "question", "query", "pos")


def q_scan_instructions(spark, sf):
    path = scratch_path(spark, "splits-json")
    writers.write_splits(fx.split_examples(spark, sf), path, fmt="json")
    df = readers.scan_instructions(spark, {s: f"{path}/split={s}" for s in ("train", "val", "dev")})
    return df.select("split", "db_id", "pos", "question", "output", "schema", "instruction")


def q_resolve_database(spark, sf):
    return reg.resolve_database(fx.raw_examples(spark, sf), fx.registry_table(spark, sf))


def q_write_splits(spark, sf):
    path = scratch_path(spark, "splits")
    writers.write_splits(fx.split_examples(spark, sf), path, fmt="parquet")
    return readers.scan_split_directory(spark, path).select(
        "split", "db_id", "pos", "question", "output", "schema", "instruction")


def q_write_metadata(spark, sf):
    path = scratch_path(spark, "metadata")
    md = writers.conversion_metadata(fx.split_examples(spark, sf), fx.catalog(spark, sf),
                                     source="documents", val_ratio=fx.VAL_RATIO, seed=fx.SEED)
    writers.write_metadata(md, path)
    back = spark.read.schema(md.schema).json(path)
    return back.select("source", "val_ratio", "seed",
                       F.col("counts.train").alias("counts_train"),
                       F.col("counts.val").alias("counts_val"),
                       F.col("counts.dev_test").alias("counts_dev_test"),
                       F.col("num_databases.total").alias("num_databases_total"))


def q_write_results(spark, sf):
    path = scratch_path(spark, "results-out")
    preds = fx.predictions_from_events(spark, sf)
    m = metrics.eval_metrics(preds)
    writers.write_results(preds.drop("ts", "event_id"), m, path, fmt="parquet", num_few_shot=fx.FEW_SHOT_K, seed=fx.SEED)
    return writers.read_results(spark, path, fmt="parquet")


# ---------------------------------------------------------------- catalog
def q_catalog_columns(spark, sf):
    return cat.catalog_columns(fx.catalog(spark, sf))


def q_catalog_primary_keys(spark, sf):
    return cat.catalog_primary_keys(fx.catalog(spark, sf))


def q_catalog_foreign_keys(spark, sf):
    return cat.catalog_foreign_keys(fx.catalog(spark, sf))


def q_schema_ddl(spark, sf):
    return cat.schema_ddl(fx.catalog(spark, sf))


def q_schema_lookup(spark, sf):
    return fx.schema_lookup(spark, sf)


# ---------------------------------------------------------------- corpus
def q_convert_examples(spark, sf):
    return fx.instruction_examples(spark, sf)


def q_orphan_examples(spark, sf):
    return corpus.orphan_examples(fx.raw_examples(spark, sf), fx.schema_lookup(spark, sf))


def q_split_by_database(spark, sf):
    return fx.split_examples(spark, sf).select("pos", "db_id", "split")


def q_split_order(spark, sf):
    return corpus.split_order(fx.split_examples(spark, sf).select("split", "db_id", "pos"))


def q_split_summary(spark, sf):
    return corpus.split_summary(fx.split_examples(spark, sf))


# ---------------------------------------------------------------- profiling
def q_split_stats(spark, sf):
    return profile.split_stats(fx.split_examples(spark, sf))


def q_length_profile(spark, sf):
    return profile.length_profile(fx.instruction_examples(spark, sf))


def q_top_databases(spark, sf):
    return profile.top_databases(fx.instruction_examples(spark, sf), 10)


def q_sql_feature_flags(spark, sf):
    return profile.sql_feature_flags(fx.instruction_examples(spark, sf))


def q_sql_feature_distribution(spark, sf):
    return profile.sql_feature_distribution(fx.instruction_examples(spark, sf))


def q_token_estimate(spark, sf):
    return profile.token_estimate(fx.instruction_examples(spark, sf))


def q_filter_database(spark, sf):
    return corpus.filter_database(fx.instruction_examples(spark, sf), "src3").select("pos", "db_id", "question")


def q_available_databases(spark, sf):
    return corpus.available_databases(fx.instruction_examples(spark, sf), 10)


def q_sample_examples(spark, sf):
    return corpus.sample_examples(fx.instruction_examples(spark, sf), 20, fx.SEED).select("pos", "db_id")


# ---------------------------------------------------------------- prompts
def q_prompt_zero_shot(spark, sf):
    return prompting.prompt_zero_shot(fx.test_examples(spark, sf), key="index")


def q_prompt_template(spark, sf):
    return prompting.prompt_template(fx.test_examples(spark, sf), CONFIG_PROMPT_TEMPLATE, key="index")


def _picks(spark, sf):
    return prompting.select_few_shot(fx.test_examples(spark, sf), fx.train_examples(spark, sf),
                                     fx.FEW_SHOT_K, fx.SEED)


def q_select_few_shot(spark, sf):
    return _picks(spark, sf).select("index", "slot", "pick_pos", "pick_db_id")


def q_prompt_few_shot(spark, sf):
    return prompting.prompt_few_shot(fx.test_examples(spark, sf), _picks(spark, sf))


def q_prompt_few_shot_shared(spark, sf):
    return prompting.prompt_few_shot_shared(fx.test_examples(spark, sf), _picks(spark, sf))


def q_chat_messages(spark, sf):
    msgs = prompting.chat_messages(prompting.prompt_zero_shot(fx.test_examples(spark, sf), key="index"),
                                   key="index")
    return msgs.select("index", F.posexplode("messages").alias("turn", "m")) \
        .select("index", "turn", F.col("m.role").alias("role"), F.col("m.content").alias("content"))


def q_sft_text(spark, sf):
    return prompting.sft_text(fx.train_examples(spark, sf), keep=("pos",))


# ---------------------------------------------------------------- matching
def q_extract_sql(spark, sf):
    return matching.extract_predictions(fx.responses(spark, sf)).select("index", "pred_sql", "strategy")


def q_extract_strategy_counts(spark, sf):
    return matching.strategy_counts(matching.extract_predictions(fx.responses(spark, sf)))


def q_normalize_sql(spark, sf):
    return matching.normalize_texts(fx.sql_pairs(spark, sf))


def q_exact_match(spark, sf):
    return matching.exact_match(fx.sql_pairs(spark, sf)).select("pos", "exact_match")


# ---------------------------------------------------------------- execution
def _sessions(spark, sf):
    return reg.DatabaseSessions(spark, fx.registry_table(spark, sf))


def q_execute_queries(spark, sf):
    pairs = fx.example_pairs(spark, sf)
    sides = pairs.select("db_id", F.col("gold_sql").alias("sql")).unionByName(
        pairs.select("db_id", F.col("pred_sql").alias("sql")))
    _, status = execution.execute_queries(spark, sides, _sessions(spark, sf))
    return status.select("db_id", "exec_sql", F.col("error").isNotNull().alias("failed"), "n_rows")


def q_compare_result_sets(spark, sf):
    rows, status = fx.result_rows(spark, sf)
    return execution.result_sets_equal(rows, status).withColumnRenamed("pair_id", "example_id")


def _exec_verdicts(spark, sf):
    return execution.execution_accuracy(spark, fx.example_pairs(spark, sf), _sessions(spark, sf))


def q_execution_accuracy(spark, sf):
    v = _exec_verdicts(spark, sf)
    return v.select("example_id", "db_id", "exec_match", "gold_rows", "pred_rows",
                    F.col("gold_error").isNotNull().alias("gold_failed"),
                    F.col("pred_error").isNotNull().alias("pred_failed"), "db_found")


def q_missing_database_verdict(spark, sf):
    """Every example of a database that is not there, without running a text."""
    sessions = _sessions(spark, sf)
    test = fx.raw_examples(spark, sf).select(F.col("pos").alias("example_id"), "db_id", F.col("query").alias("gold_sql"),
                                             F.col("query").alias("pred_sql"))
    v = execution.execution_accuracy(spark, test.join(sessions.physical(), "db_id", "left_anti"), sessions)
    return v.select("example_id", "db_id", "exec_match", "gold_rows", "pred_rows",
                    F.col("gold_error").isNotNull().alias("gold_failed"),
                    F.col("pred_error").isNotNull().alias("pred_failed"), "db_found")


# ---------------------------------------------------------------- metrics
def _records(spark, sf):
    """Full scoring of the held-out examples against the derived responses."""
    test = fx.test_examples(spark, sf).select("index", "db_id", "question", "output", "pos")
    resp = fx.responses(spark, sf).join(test.select("pos", F.col("index").alias("_i")), "pos") \
        .select("mode", F.col("_i").alias("index"), "response", "generation_time_s")
    preds = stored(matching.extract_predictions(resp), "predictions")      # extracted once
    pairs = preds.join(test.select("index", "db_id", "output"), "index").select(
        F.col("index").alias("example_id"), "db_id", F.col("output").alias("gold_sql"), F.col("pred_sql"))
    v = execution.execution_accuracy(spark, pairs, _sessions(spark, sf))
    verdicts = v.select(F.lit("zero-shot").alias("mode"), F.col("example_id").alias("index"),
                        "exec_match", "pred_error", "db_found")
    return metrics.prediction_records(test, preds, verdicts)


def q_prediction_records(spark, sf):
    return _records(spark, sf).select("mode", "index", "db_id", "exact_match", "exec_match",
                                      F.col("pred_error").isNotNull().alias("pred_failed"),
                                      "db_found", "generation_time_s")


def q_limit_examples(spark, sf):
    return corpus.limit_examples(fx.predictions_from_events(spark, sf), 100).select("mode", "index", "event_id")


def q_eval_metrics(spark, sf):
    return metrics.eval_metrics(fx.predictions_from_events(spark, sf))


def q_error_rate(spark, sf):
    return metrics.eval_metrics(fx.predictions_from_events(spark, sf)).select(
        "mode", "execution_error_count", "total_examples", "error_rate")


def q_running_metrics(spark, sf):
    return metrics.running_metrics(fx.predictions_from_events(spark, sf), 50)


def q_mode_comparison(spark, sf):
    return metrics.mode_comparison(metrics.eval_metrics(fx.predictions_from_events(spark, sf)), "click", "view")


def q_model_comparison(spark, sf):
    p = fx.predictions_from_events(spark, sf).withColumn(
        "model", F.when(F.pmod("event_id", F.lit(3)) == 0, F.lit("org/tuned-7b"))
        .when(F.pmod("event_id", F.lit(3)) == 1, F.lit("org/base-7b")).otherwise(F.lit("base")))
    return metrics.model_comparison(p)


def q_failure_sample(spark, sf):
    return metrics.failure_sample(fx.predictions_from_events(spark, sf), 10).select(
        "mode", "rank", "index", "db_id", "n_failures")


def q_error_buckets(spark, sf):
    return metrics.error_buckets(_records(spark, sf), 2)


def q_latency_summary(spark, sf):
    # every fourth request has no latency
    ev = fx.table(spark, sf, "events").withColumn("value", F.when(F.pmod("event_id", F.lit(4)) != 0, F.col("value")))
    return metrics.latency_summary(ev, group="event_type", latency="value", ts="ts")


# ---------------------------------------------------------------- batches
def q_truncate_tokens(spark, sf):
    t = batches.truncate_tokens(fx.token_features(spark, sf), fx.MAX_SEQ)
    return t.select("pos", "input_ids", F.size("input_ids").alias("n_tokens"))


def q_default_features(spark, sf):
    return batches.default_features(fx.token_features(spark, sf)).select("pos", "attention_mask", "labels")


def q_pad_batch(spark, sf):
    return batches.pad_batch(fx.token_features(spark, sf), fx.BATCH_SIZE).select(
        "pos", "batch", "input_ids", "attention_mask", "labels")


def q_completion_mask(spark, sf):
    padded = batches.pad_batch(fx.token_features(spark, sf), fx.BATCH_SIZE)
    return batches.completion_mask(padded, fx.TOKEN_TEMPLATE).select("pos", "labels")


QUERIES: dict[str, Query] = {
    name[2:]: fn for name, fn in sorted(globals().items())
    if name.startswith("q_") and callable(fn)
}
