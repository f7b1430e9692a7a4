"""The field against enumeration, and held-out accuracy."""
import itertools

import numpy as np

from corpusql.llm import toxicity

from brute import edge_rows, table
from conftest import SF_SMALL


def test_marginals_are_sums_over_paths():
    rng = np.random.default_rng(3)
    e, length = rng.normal(size=(4, 6)), np.array([6, 4, 1, 3])
    start, trans = rng.normal(size=2), rng.normal(size=(2, 2))
    p, pairs, log_z = toxicity.forward_backward(e, length, start, trans)
    for i, n in enumerate(length):
        weight = {}
        for path in itertools.product((0, 1), repeat=int(n)):
            s = start[path[0]] + sum(e[i, t] for t in range(n) if path[t]) + sum(trans[a, b] for a, b in zip(path, path[1:]))
            weight[path] = np.exp(s)
        z = sum(weight.values())
        assert np.isclose(np.log(z), log_z[i])
        for t in range(n):
            assert np.isclose(p[i, t], sum(w for path, w in weight.items() if path[t]) / z)
        assert (p[i, n:] == 0).all()
        for a, b in itertools.product((0, 1), repeat=2):
            want = sum(w * sum(x == (a, b) for x in zip(path, path[1:])) for path, w in weight.items()) / z
            assert np.isclose(pairs[i, a, b], want)


def test_table_of_plain_chains_is_exact():
    text = b"one two three. four five\nsix seven IDIOT eight nine ten. " * 40
    data = np.frombuffer(text, np.uint8)
    tokens = toxicity.Tokens(data, np.array([0, 100, 100, len(data)]))
    field = toxicity.Field()
    field.w, field.start = np.linspace(-2, 3, toxicity.FEATURES), np.array([0.3, -0.2])
    field.trans = np.array([[0.5, -0.7], [0.1, 0.4]])
    keys = np.sort(np.unique(tokens.hashes[0])[:5])
    _, bits = toxicity.features(tokens, keys, np.linspace(1.5, 5, 5))
    got = field.marginals(tokens, bits)
    for a, n in zip(tokens.chains, tokens.lengths):
        e = toxicity.design(bits[None, a:a + n]) @ field.w
        p, _, _ = toxicity.forward_backward(e, np.array([n]), field.start, field.trans)
        assert np.allclose(got[a:a + n], p[0])


def test_spans_and_edges(spark):
    calm = [(i, f"A calm and friendly sentence number {i}. Another kind one follows here.", "en", "a") for i in range(150)]
    rude = [(200 + i, f"A calm start number {i}. You bletcherous é grommit, go away.", "en", "a") for i in range(60)]
    rows = calm + rude + [(300 + k, *r[1:]) for k, r in enumerate(edge_rows())] + [(None, rude[0][1], "en", "a")]
    labels = [(r[0], 0) for r in calm] + [(r[0], 1) for r in rude] + [(201, 0), (None, 1), (5, None)]
    docs = table(spark, rows)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    texts = {r[0]: r[1] or "" for r in rows}
    for r in rude:
        found = [texts[r[0]][s.start:s.end] for s in got[r[0]].spans]
        assert got[r[0]].score >= 0.5 and any("bletcherous" in f or "grommit" in f for f in found)
    assert all(got[r[0]].score < 0.5 and not got[r[0]].spans for r in calm)
    assert got[302].score == got[303].score < 0.5 and got[None].score >= 0.5


def test_without_labels_and_documents(spark):
    docs = table(spark, edge_rows())
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert {r.score for r in toxicity.score(docs, model).collect()} == {0.0}
    assert toxicity.score(table(spark, []), model).count() == 0


def test_held_out_accuracy(spark):
    path = SF_SMALL.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    got = [r for r in toxicity.op4_toxicity(spark, path).collect() if r.held_out and r.doc_id in labels]
    assert len(got) > 40 and sum(r.predicted == labels[r.doc_id] for r in got) >= 0.9 * len(got)
