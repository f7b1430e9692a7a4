from pyspark.sql import functions as F

from corpusql.operators import metrics
from test_sqltext import GOLDEN

# Times and verdicts of the stored records.
TIMES = [1.48, 0.91, 1.62, 1.61, 4.59, 4.61, 8.02, 2.49, 1.63, 2.03]
EXEC = [True, True, True, True, True, True, False, False, True, True]


def _preds(spark):
    rows = [("zero-shot", i, "concert_singer", "q", g, p, em, ex, None, t, True)
            for i, ((g, p, em), ex, t) in enumerate(zip(GOLDEN, EXEC, TIMES))]
    return spark.createDataFrame(rows, "mode string, index bigint, db_id string, question string, gold_sql string, "
                                       "pred_sql string, exact_match boolean, exec_match boolean, pred_error string, "
                                       "generation_time_s double, db_found boolean")


def test_golden_metrics(spark):
    m = metrics.eval_metrics(_preds(spark)).first()
    assert m["total_examples"] == 10
    assert m["exact_match_count"] == 3 and m["execution_match_count"] == 8
    assert m["exact_match_accuracy"] == 30.0 and m["execution_accuracy"] == 80.0
    assert m["execution_error_count"] == 0
    assert round(m["avg_generation_time_s"], 2) == 2.9


def test_failure_sample_and_buckets(spark):
    fs = metrics.failure_sample(_preds(spark), 10).collect()
    assert [r["index"] for r in sorted(fs, key=lambda r: r["rank"])] == [6, 7]
    assert fs[0]["n_failures"] == 2
    b = {r["category"]: r for r in metrics.error_buckets(_preds(spark)).collect()}
    assert b["false_negative_exact_match"]["n_examples"] == 5
    assert b["wrong_join"]["examples"] == [6]


def test_running_metrics(spark):
    rows = [("m", i, i % 2 == 0, i % 4 == 0, None, 1.0, True) for i in range(120)]
    p = spark.createDataFrame(rows, "mode string, index bigint, exact_match boolean, exec_match boolean, "
                                    "pred_error string, generation_time_s double, db_found boolean")
    got = {r["n_seen"]: r for r in metrics.running_metrics(p, 50).collect()}
    assert sorted(got) == [1, 50, 100]
    assert got[1]["running_em_pct"] == 100.0 and got[100]["running_em_pct"] == 50.0
    assert got[100]["running_exec_pct"] == 25.0


def test_latency_summary(spark):
    rows = [("m", i, float(i)) for i in range(1, 101)]
    p = spark.createDataFrame(rows, "mode string, index bigint, generation_time_s double")
    r = metrics.latency_summary(p).first()
    assert r["p50"] == 50.5 and abs(r["p95"] - 95.05) < 1e-9 and r["n_requests"] == 100
