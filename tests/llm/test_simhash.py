"""SimHash components against all pairs."""
import random

import pytest
from pyspark.sql import functions as F

from corpusql.llm import simhash

from brute import edge_rows, fingerprint, groups, table


def _check(docs, rows, **kw):
    got = simhash.near_duplicates(docs, **kw).collect()
    prints = [(i, fingerprint(t, kw.get("width", 3))) for i, t in rows]
    want = groups(prints, kw.get("most", 2))
    assert len(got) == len(rows)
    for r in got:
        f = r.fp & (1 << 64) - 1
        assert (r.doc_id, f) in want and r.component_id == want[r.doc_id, f]


def test_edges(spark):
    rows = edge_rows()
    _check(table(spark, rows), [(i, t) for i, t, _, _ in rows])


@pytest.mark.parametrize("limit", [48, 2])
def test_links_of_planted_fingerprints(spark, monkeypatch, limit):
    """Chains, stars and far pairs; with ``limit`` 2 every bucket is a crowd."""
    monkeypatch.setattr(simhash, "PAIRS_UP_TO", limit)
    rng = random.Random(5)
    prints = set()
    for _ in range(12):
        f = rng.getrandbits(64)
        prints.add(f)
        for _ in range(10):
            f ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            prints.add(f)
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(prints)]
    nodes = spark.createDataFrame([(f, k) for k, f in enumerate(signed)], "fp bigint, doc bigint")
    plan = simhash.plan_index(nodes.select("fp"), 2)
    assert sum(t for _, t in plan) == 2 - len(plan) + 1 and sorted(b for g, _ in plan for b in g) == list(range(64))
    edges = simhash.links(nodes.select("fp"), plan, 2)
    assert edges.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 2).count() == 0
    found = {r.fp: r.least for r in simhash.components(nodes, edges).collect()}
    want = groups([(k, f & (1 << 64) - 1) for k, f in enumerate(signed)], 2)
    for k, f in enumerate(signed):
        assert found.get(f, k) == want[k, f & (1 << 64) - 1]


def test_one_of_each_and_empty(spark):
    rows = edge_rows()
    docs = table(spark, rows)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    prints = [(i, fingerprint(t)) for i, t, _, _ in rows]
    want = groups(prints, 2)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({v for v in want.values()})
    assert simhash.near_duplicates(table(spark, [])).count() == 0
    assert simhash.one_of_each(table(spark, [])).count() == 0


def test_one_of_each_without_ids_and_with_repeated_ids(spark):
    """Every component leaves one row: ids that are null or have several texts name none."""
    text = lambda c: " ".join(f"{c}{i}x{i * i}" for i in range(200))
    t, u, v = text("t"), text("u"), text("v")
    near = {x: x.upper() for x in (t, u, v)}          # other text, equal fingerprint
    rows = [(1, t), (None, near[t]), (None, u), (None, near[u]), (None, u), (3, v), (1, near[v]), (4, v), (1, near[t])]
    kept = simhash.one_of_each(table(spark, [(i, x, "en", "a") for i, x in rows])).collect()
    assert len(kept) == 3
    by = {fingerprint(r.text): r.doc_id for r in kept}
    assert by == {fingerprint(t): 1, fingerprint(u): None, fingerprint(v): 1}
