"""Inputs that once gave wrong or lost results."""
import json

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corpusql.operators import catalog as cat
from corpusql.operators import corpus, execution, metrics, prompting
from corpusql.plans import convert, evaluate, inspection, training
from corpusql.plans import fixtures as fx
from corpusql.session import scratch_path
from corpusql.sources import readers, registry, writers
from corpusql.sources.registry import DatabaseSessions

from conftest import SF_SMALL

ENTRY = {"db_id": "shop", "table_names_original": ["item", "sale"],
         "column_names_original": [[-1, "*"], [0, "id"], [0, "name"], [1, "item_id"]],
         "column_types": ["text", "number", "text", "number"], "primary_keys": [1], "foreign_keys": [[3, 1]]}


def _array(path, rows):
    path.write_text(json.dumps(rows, indent=2, ensure_ascii=False))
    return str(path)


def test_json_arrays_have_file_order(spark, tmp_path):
    rows = [{"db_id": f"d{i % 3}", "question": f"q{i}", "query": f"SELECT {i}"} for i in range(50)]
    got = readers.scan_examples(spark, _array(tmp_path / "train.json", rows)).orderBy("pos").collect()
    assert [(r.pos, r.question) for r in got] == [(i, f"q{i}") for i in range(50)]


def test_bad_records_and_missing_files_raise(spark, tmp_path):
    with pytest.raises(PySparkException):
        readers.scan_examples(spark, str(tmp_path / "none.json"))
    for k, bad in enumerate(('[{"db_id": "a", "query": "SELECT 1"}, {"db_id": ', '[{"db_id": "a", "question": "no query"}]')):
        path = tmp_path / f"bad{k}.json"
        path.write_text(bad)
        with pytest.raises((PySparkException, Py4JJavaError)):
            readers.scan_examples(spark, str(path)).collect()


def test_unanswered_examples_stay(spark):
    ex = spark.createDataFrame([(0, "d", "q", "SELECT 1"), (1, "d", "q", "SELECT 2")], "index bigint, db_id string, question string, output string")
    resp = spark.createDataFrame([("m", 0, "SELECT 1", 1.0)], "mode string, index bigint, response string, generation_time_s double")
    verdicts = spark.createDataFrame([("m", 0, True, None, True)], "mode string, index bigint, exec_match boolean, pred_error string, db_found boolean")
    m = metrics.eval_metrics(metrics.prediction_records(ex, resp, verdicts)).first()
    assert (m.total_examples, m.exact_match_count, m.execution_match_count, m.execution_error_count) == (2, 1, 1, 1)
    with pytest.raises(PySparkException):
        metrics.prediction_records(ex, resp, verdicts.where("index = 7")).collect()


def test_model_names_with_slashes(spark):
    rows = [("org/base-7b", mode, i, i < n, i < n, None, 1.0, True) for mode, n in (("zero-shot", 1), ("few-shot", 3)) for i in range(4)]
    p = spark.createDataFrame(rows, "model string, mode string, index bigint, exact_match boolean, exec_match boolean, "
                                    "pred_error string, generation_time_s double, db_found boolean")
    got = {(r.model, r.mode): r.exact_match_accuracy for r in metrics.model_comparison(p).collect()}
    assert got == {("org/base-7b", "zero-shot"): 25.0, ("org/base-7b", "few-shot"): 75.0}
    assert metrics.mode_comparison(metrics.eval_metrics(p)).count() == 2
    assert metrics.mode_comparison(metrics.eval_metrics(p.where("mode = 'few-shot'"))).count() == 0


def test_missing_database_is_no_invalid_sql(spark):
    p = spark.createDataFrame([("m", 0, "SELECT 1", "SELECT 1", True, False, "Database not found: x", False),
                               ("m", 1, "SELECT a FROM t", "SELECT a FROM u", False, False, "Database not found: x", False)],
                              "mode string, index bigint, gold_sql string, pred_sql string, exact_match boolean, exec_match boolean, "
                              "pred_error string, db_found boolean")
    assert {r.category: r.examples for r in metrics.error_buckets(p).collect()} == {"other": [0], "wrong_join": [1]}


def test_null_latencies(spark):
    p = spark.createDataFrame([("m", i, float(i) if i % 2 else None) for i in range(1, 101)], "mode string, index bigint, generation_time_s double")
    r = metrics.latency_summary(p).first()
    assert (r.n_requests, r.p50) == (100, 50.0) and abs(r.p95 - 94.1) < 1e-9


def test_few_shot_with_several_schema_lengths(spark):
    train = spark.createDataFrame([(f"d{i % 4}", i, "s" * (5 + (i * 7) % 11), f"q{i}", f"o{i}") for i in range(60)],
                                  "db_id string, pos bigint, schema string, question string, output string")
    test = spark.createDataFrame([(i, f"d{i % 4}") for i in range(200)], "index bigint, db_id string")
    picks = prompting.select_few_shot(test, train, 3, 42).join(test, "index").collect()
    assert len(picks) == 600 and all(r.pick_db_id != r.db_id for r in picks)
    ordered = sorted(((len(r.schema), r.db_id, r.pos) for r in train.collect()))
    pool = {d: {pos for _, _, pos in [x for x in ordered if x[1] != d][:45 // 2]} for d in ("d0", "d1", "d2", "d3")}
    for d, allowed in pool.items():
        assert {r.pick_pos for r in picks if r.db_id == d} <= allowed
        assert len({r.pick_pos for r in picks if r.db_id == d}) > len(allowed) * 0.8


def test_wide_schema(spark):
    n, k = 2000, 500
    row = ("wide", ["t0", "t1"], [["-1", "*"]] + [[str(i % 2), f"c{i}"] for i in range(n)], ["number"] * (n + 1), ["1"],
           [[i + 1, i + 2] for i in range(k)], 0)
    df = spark.createDataFrame([row], "db_id string, table_names_original array<string>, column_names_original array<array<string>>, "
                                      "column_types array<string>, primary_keys array<string>, foreign_keys array<array<int>>, pos bigint")
    schema = cat.schema_ddl(df).first().schema
    assert schema.count("FOREIGN KEY") == k and schema.count(" INTEGER") == n


def test_texts_that_are_no_queries(spark):
    sessions = DatabaseSessions(spark, fx.registry(spark, SF_SMALL) | {"gone": {"nation": "/nowhere/nation.parquet"}})
    texts = ["nation", "SELECT 1 AS a) UNION ALL (SELECT 2", f"SELECT * FROM parquet.`{SF_SMALL}/nation.parquet`",
             "SELECT reflect('java.lang.System', 'currentTimeMillis')", "SELECT n_name FROM nation"]
    pairs = spark.createDataFrame([(i, "src0", "SELECT n_name FROM nation", t) for i, t in enumerate(texts)]
                                  + [(9, "gone", "SELECT 1", "SELECT 1")], "example_id bigint, db_id string, gold_sql string, pred_sql string")
    v = {r.example_id: r for r in execution.execution_accuracy(spark, pairs, sessions).collect()}
    assert [v[i].pred_error is None for i in range(5)] == [False] * 4 + [True] and v[4].exec_match
    assert v[9].pred_error == "Database not found: gone" and not v[9].db_found
    reg = registry.registry_from_dirs(spark, [("here", "nation", f"{SF_SMALL}/nation.parquet"), ("gone", "nation", "/nowhere/x")])
    found = registry.resolve_database(spark.createDataFrame([("here",), ("gone",), ("other",)], "db_id string"), reg)
    assert {r.db_id: r.found for r in found.collect()} == {"here": True, "gone": False, "other": False}


def test_one_database_writes_several_files(spark, tmp_path):
    ex = spark.range(20_000).select(F.lit("i").alias("instruction"), F.lit("s" * 50).alias("schema"), F.lit("q").alias("question"),
                                    F.lit("o").alias("output"), F.lit("one").alias("db_id"), F.col("id").alias("pos"), F.lit("train").alias("split"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        writers.write_splits(ex, str(tmp_path / "out"), fmt="parquet")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "out" / "split=train").glob("part-*.parquet"))) > 1


def test_convert_and_inspect_jobs(spark, tmp_path):
    rows = [{"db_id": ["shop", "none"][i % 5 == 4], "question": f"q{i}", "query": "SELECT count(*) FROM item"} for i in range(20)]
    out = scratch_path(spark, "convert")
    md = convert.convert(spark, _array(tmp_path / "tables.json", [ENTRY]), _array(tmp_path / "train.json", rows),
                         _array(tmp_path / "dev.json", rows[:5]), out).first()
    assert (md.counts.val, md.counts.dev_test, md.num_databases.total) == (16, 4, 1)
    report = inspection.inspect_corpus(spark, f"{out}/splits")
    assert report["lengths"].first().n_examples == 20 and report["samples"].count() == 3
    assert "FOREIGN KEY (item_id) REFERENCES item(id)" in readers.scan_split_directory(spark, f"{out}/splits", "json").first().schema


def test_training_job(spark):
    ex = spark.createDataFrame([(10 * i, "s", "q " * i, "SELECT 1") for i in range(1, 8)], "pos bigint, schema string, question string, output string")
    got = training.training_batches(ex, lambda t: F.transform(F.split(t, " "), F.length), [5], 64, 3).orderBy("pos").collect()
    assert [r.batch for r in got] == [0, 0, 0, 1, 1, 1, 2]
    assert all(len(r.input_ids) == len(r.labels) == len(r.attention_mask) <= 64 for r in got)


def test_evaluate_job_over_two_modes(spark):
    sessions = DatabaseSessions(spark, fx.registry(spark, SF_SMALL))
    test = spark.createDataFrame([(i, "src0", "q", "SELECT count(*) FROM nation") for i in range(3)],
                                 "index bigint, db_id string, question string, output string")
    resp = spark.createDataFrame([("zero-shot", 0, "SELECT count(*) FROM nation", 1.0), ("zero-shot", 1, "SELECT 3", 1.0),
                                  ("few-shot", 0, "```sql\nSELECT count(*) FROM nation;\n```", 2.0), ("few-shot", 1, "SELECT 25", 2.0)],
                                 "mode string, index bigint, response string, generation_time_s double")
    out = scratch_path(spark, "evaluate")
    summary, comparison = evaluate.evaluate(spark, test, resp, sessions, out)
    assert {r.mode: (r.total_examples, r.execution_match_count) for r in summary.collect()} == {"zero-shot": (3, 1), "few-shot": (3, 2)}
    assert {r.metric: round(r.difference, 3) for r in comparison.collect()} == {"exact_match_accuracy": 0.0, "execution_accuracy": 33.333}
    config = {r.mode: r.num_few_shot for r in spark.read.json(f"{out}/config").collect()}
    assert config == {"zero-shot": 0, "few-shot": 3}
    assert spark.read.json(f"{out}/predictions").count() == 6
