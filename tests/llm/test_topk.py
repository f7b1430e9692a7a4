"""Exact top-k search against all pairs."""
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusql.llm import topk


def _brute(rows, is_query, k):
    vectors = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
               if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, q in vectors:
        if is_query(i):
            scored = sorted({(-sum(a * b for a, b in zip(q, v)), j) for j, v in vectors if j != i})
            out |= {(i, rank + 1, j, -s) for rank, (s, j) in enumerate(scored[:k])}
    return out


def _search(spark, rows, k=3, lists=2):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<float>, key int, v string")
    got = topk.search(df, F.col("vec_id") % 5 == 0, k=k, lists=lists).collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


@pytest.mark.parametrize("lists", [1, 2, 3])
def test_ties_copies_and_bad_vectors(spark, lists):
    rng = random.Random(lists)
    common = [0.5, -0.25, 1.0, 0.0]
    rows = [(i, common) for i in range(40)] + [(i, [rng.choice([-1.0, -0.5, 0.5, 1.0]) for _ in range(4)]) for i in range(40, 120)]
    rows += [(200, None), (205, [1.0, None, 0.0, 0.0]), (210, [float("nan"), 0.0, 0.0, 0.0]), (215, [float("inf"), 1.0, 1.0, 1.0]),
             (None, common), (41, rows[41][1])]
    assert _search(spark, rows, lists=lists) == _brute(rows, lambda i: i % 5 == 0, 3)


def test_few_candidates_and_none(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.5])]
    assert _search(spark, rows) == {(0, 1, 1, 256 * 128 + 512 * 128)}
    assert _search(spark, [(0, [1.0])]) == set()
    assert _search(spark, []) == set()


def test_query_blocks_are_never_broadcast(spark, monkeypatch):
    """Copies of query blocks for each group of vectors were one broadcast, some 64 times what Spark took its size for."""
    plans = []
    plan_of = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    monkeypatch.setattr(topk, "stored", lambda df, name, write=topk.stored: write(plan_of(df), name))
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    plan_of(topk.search(df, F.col("vec_id") % 5 == 0))
    assert any("matrix" in plan for plan in plans)
    assert not [x for plan in plans for x in re.findall(r"BroadcastHashJoin \[([^]]*)\]", plan) if "list#" in x or "at#" in x]


@pytest.mark.parametrize("lists", [1, 2, 3])
def test_many_groups_and_large_components(spark, lists):
    rng = random.Random(lists)
    sizes = [1.0, 1.0, 1.0, 200.0, 10_000.0]    # 2, 4 and, with row 201, 8 bytes a component; both precisions of scores
    rows = [(i, [rng.choice(sizes) * rng.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) for _ in range(5)]) for i in range(90)]
    rows += [(100 + i, [0.0] * 5) for i in range(12)] + [(120 + i, [-1.0, 1.0] * i) for i in range(3)]
    rows += [(201, [8_500_000.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    for k in (1, 4):
        got = topk.search(df, F.col("vec_id") % 5 == 0, k=k, lists=lists, block=7, query_block=3, group=100, most=400).collect()
        assert {tuple(r) for r in got} == _brute([(i, v + [0.0] * (6 - len(v))) for i, v in rows], lambda i: i % 5 == 0, k)
