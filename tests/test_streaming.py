from corpusql.operators import metrics
from corpusql.plans import fixtures as fx
from corpusql.session import scratch_path
from corpusql.sources import schemas
from corpusql.streaming import live_metrics

from conftest import SF_SMALL


def test_live_metrics_match_batch(spark):
    preds = fx.predictions_from_events(spark, SF_SMALL).select(*schemas.PREDICTION.fieldNames())
    src = scratch_path(spark, "pred-stream")
    # two arrivals of files, processed as they land
    preds.where("index < 100").write.parquet(src + "/a")
    preds.where("index >= 100").write.parquet(src + "/b")
    q = live_metrics.start_live_metrics(spark, src + "/*", "live_metrics_test")
    try:
        q.processAllAvailable()
        live = {r["mode"]: r for r in spark.table("live_metrics_test").collect()}
    finally:
        q.stop()
    batch = {r["mode"]: r for r in metrics.eval_metrics(preds).collect()}
    assert set(live) == set(batch)
    for m, b in batch.items():
        assert live[m]["total_examples"] == b["total_examples"]
        assert live[m]["exact_match_count"] == b["exact_match_count"]
        assert live[m]["execution_error_count"] == b["execution_error_count"]
        assert live[m]["running_exec_pct"] == b["execution_accuracy"]
