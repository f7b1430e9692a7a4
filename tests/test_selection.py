"""Order statistics by selection against sorting."""
import math
import random

import pytest
from pyspark.sql import functions as F

from corpusql.operators import metrics


@pytest.mark.parametrize("bins, few", [(4096, 4096), (4, 2), (2, 1)])
def test_every_rank(spark, monkeypatch, bins, few):
    monkeypatch.setattr(metrics, "BINS", bins)
    monkeypatch.setattr(metrics, "FEW", few)
    rng = random.Random(4)
    groups = {
        "uniform": [rng.random() for _ in range(60)], "ties": [rng.choice([1.5, 2.5]) for _ in range(50)], "one": [3.25],
        "steep": [math.exp(rng.random() * 600 - 300) * rng.choice([-1, 1]) for _ in range(60)], "same": [7.0] * 40,
        "edges": [float("inf"), float("-inf"), float("nan"), float("nan"), 1.7e308, -1.7e308, 5e-324, 0.0, -0.0, 1.0, float("inf")]}
    values = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    wanted = spark.createDataFrame([(g, k) for g, vs in groups.items() for k in range(len(vs))], "g string, rank bigint")
    got = {(r.g, r["rank"]): r.v for r in metrics.selected(values, wanted).collect()}
    for g, vs in groups.items():
        ordered = sorted(vs, key=lambda v: (math.isnan(v), 0.0 if math.isnan(v) else v))
        for k, v in enumerate(ordered):
            assert got[g, k] == v or math.isnan(got[g, k]) and math.isnan(v), (g, k)
    assert len(got) == sum(map(len, groups.values()))


def test_percentiles_need_no_sort_of_the_values(spark):
    log = spark.range(50_000).select(F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("mode"),
                                     (F.pmod(F.xxhash64("id"), F.lit(10_007)) / 7).alias("generation_time_s"))
    got = {(r["mode"], r.p): r.q for r in metrics.exact_percentiles(log, "mode", "generation_time_s", (0.0, 0.25, 0.5, 0.95, 1.0)).collect()}
    rows = {m: sorted(r.generation_time_s for r in log.where(F.col("mode") == m).collect()) for m in "ab"}
    for (m, p), q in got.items():
        at = (len(rows[m]) - 1) * p
        low, high = rows[m][math.floor(at)], rows[m][math.ceil(at)]
        assert abs(q - (low + (high - low) * (at - math.floor(at)))) < 1e-9
    assert len(got) == 10
    empty = metrics.latency_summary(log.where("mode = 'x'"))
    assert empty.count() == 0
