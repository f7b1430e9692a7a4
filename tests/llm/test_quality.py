"""Kneser-Ney probabilities against a direct computation, and the decisions."""
import math
from collections import Counter, defaultdict

import numpy as np

from corpusql.llm import quality

from brute import edge_rows, table


def _keys(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return quality.ngrams(data, np.array([0, len(data)])).tolist()


def _brute(texts):
    """Natural logs of all probabilities, from nested counters."""
    bits, order = quality.SYMBOL_BITS, quality.ORDER
    tables = {order: Counter(k for t in texts for k in _keys(t))}
    for n in range(order - 1, 0, -1):
        tables[n] = Counter(k & (1 << bits * n) - 1 for k in tables[n + 1])
    lower = None
    for n in range(1, order + 1):
        of = Counter(tables[n].values())
        n1, n2, n3, n4 = (of.get(i, 0) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 0.75, 3 - 4 * y * n4 / n3 if n3 else 0.9]
        d = [min(max(x, 0.1), k + 0.9) for k, x in enumerate(d)]
        total, freed = defaultdict(int), defaultdict(float)
        for k, c in tables[n].items():
            total[k >> bits] += c
            freed[k >> bits] += d[min(c, 3) - 1]

        def p(k, n=n, d=d, total=total, freed=freed, lower=lower):
            below = lower(k & (1 << bits * (n - 1)) - 1) if lower else 1 / quality.SYMBOLS
            ctx, c = k >> bits, tables[n].get(k, 0)
            if ctx not in total:
                return below
            return (c - d[min(c, 3) - 1] if c else 0) / total[ctx] + freed[ctx] / total[ctx] * below
        lower = p
    return lower


def test_probabilities(spark):
    texts = ["the cat sat on the mat.\nthe dog sat.", "a cat and a dog; THE END 42%", "abab abab abab"]
    counts = quality.count_ngrams(spark.createDataFrame([(t,) for t in texts] + [(None,), ("",)], "text string"))
    log_p = quality.dense(quality.smoothed(counts))
    brute = _brute(texts)
    rng = np.random.default_rng(0)
    some = [*_keys(texts[0]), *_keys("unseen WORDS zq!"), *rng.integers(0, len(log_p), 300).tolist()]
    for k in some:
        assert math.isclose(math.exp(log_p[k]), brute(k), rel_tol=2e-4)
    sums = np.exp(log_p.astype(np.float64)).reshape(-1, quality.SYMBOLS).sum(1)
    assert np.allclose(sums[::997], 1, atol=1e-3)


def _documents():
    good = [(i, f"The quick brown fox number {i} jumps over the lazy dog and runs home again. " * 3, "en", "a") for i in range(60)]
    bad = [(100 + i, "@@## $$%% QQXXZZ!! ||~~ " * 12, "en", "a") for i in range(5)]
    return good, bad


def test_junk_goes_and_edges_have_their_results(spark):
    good, bad = _documents()
    rows = good + bad + [(200, None, "en", "a"), (201, "", None, "b"), (202, good[0][1], "xx", "b"), (0, good[0][1], "en", "a")]
    docs = table(spark, rows)
    labels = spark.createDataFrame([(r[0], 1) for r in good] + [(0, 1), (None, 1), (100, 0), (200, None)], "doc_id bigint, quality int")
    got = {}
    for r in quality.classify(docs, labels).collect():
        assert got.setdefault(r.doc_id, r.keep) == r.keep
    assert len(got) == len({r[0] for r in rows})
    assert all(not got[r[0]] for r in bad) and not got[200] and not got[201] and got[202]
    assert sum(got[r[0]] for r in good) >= 0.95 * len(good)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in rows if got[r[0]])


def test_no_labels_and_no_documents(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    rows = edge_rows()
    kept = quality.keep_good(table(spark, rows), none).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(r[0]) for r in rows if r[1])
    assert quality.classify(table(spark, []), none).count() == 0


def _brute_logs(texts):
    """Natural log of a code point's probability after the three before it, from nested counters of tuples."""
    def grams(text):
        padded = "\n" * 3 + text
        return [padded[i:i + 4] for i in range(len(text))]
    tables = {4: Counter(g for t in texts for g in grams(t))}
    for n in (3, 2, 1):
        tables[n] = Counter(g[1:] for g in tables[n + 1])
    below = None
    for n in range(1, 5):
        of = Counter(tables[n].values())
        n1, n2, n3, n4 = (of.get(i, 0) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 0.75, 3 - 4 * y * n4 / n3 if n3 else 0.9]
        d = [min(max(x, 0.1), k + 0.9) for k, x in enumerate(d)]
        total, freed = Counter(), defaultdict(float)
        for g, c in tables[n].items():
            total[g[:-1]] += c
            freed[g[:-1]] += d[min(c, 3) - 1]

        def p(g, n=n, d=d, total=total, freed=freed, lower=below):
            rest = lower(g[1:]) if lower else 1 / (len(tables[1]) + 1)
            if g[:-1] not in total:
                return rest
            c = tables[n].get(g, 0)
            return ((c - d[min(c, 3) - 1] if c else 0) + freed[g[:-1]] * rest) / total[g[:-1]]
        below = p
    usual = sum(c * math.log(below(g)) for g, c in tables[4].items()) / sum(tables[4].values())

    def perplexity(text):
        logs = sum(math.log(below(g)) for g in grams(text))
        return math.exp(-(logs + quality.PRIOR * usual) / (len(text) + quality.PRIOR))
    return perplexity


def test_perplexity_of_code_points_against_nested_counters(spark, monkeypatch):
    monkeypatch.setattr(quality, "BLOCK_BYTES", 64)
    good = ["the cat sat on the mat.\nthe dog sat.", "кот сидел на окне, пёс лежал у двери", "猫が窓に座っていた。犬は寝ていた。", "abab abab 😀 abab"]
    rows = [(i, t, "en", "a") for i, t in enumerate([*good, "unseen WORDS zq!", "окно двери кот", "x", "", None, good[1]])]
    labels = spark.createDataFrame([(i, 1) for i in range(4)], "doc_id bigint, quality int")
    got = {r.doc_id: r.perplexity for r in quality.classify(table(spark, rows).repartition(3), labels).collect()}
    brute = _brute_logs(good)
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        assert math.isclose(got[i], brute(text), rel_tol=1e-5) if text else got[i] is None


def test_shuffled_letters_of_another_script_are_rejected(spark):
    words = "кот сидел на окне а пёс лежал у двери и ждал когда вернётся хозяин с прогулки по саду".split()
    good = [(i, " ".join(words[(i * k + k) % len(words)] for k in range(60)), "ru", "a") for i in range(40)]
    rng = np.random.default_rng(1)
    letters = [c for c in "абвгдежзиклмнопрстуфхцчшщ"]
    bad = [(100 + i, " ".join("".join(rng.choice(letters, 5)) for _ in range(60)), "ru", "a") for i in range(5)]
    labels = spark.createDataFrame([(r[0], 1) for r in good], "doc_id bigint, quality int")
    keep = {r.doc_id: r.keep for r in quality.classify(table(spark, good + bad), labels).collect()}
    assert not any(keep[r[0]] for r in bad) and sum(keep[r[0]] for r in good) >= 38


def test_the_model_stays_out_of_the_driver(spark, monkeypatch):
    """Only counts of counts, of which there are four an order, are collected."""
    monkeypatch.setattr(type(spark.range(1)), "toPandas", lambda self: (_ for _ in ()).throw(AssertionError("collected")))
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda *a: (_ for _ in ()).throw(AssertionError("broadcast")))
    good, bad = _documents()
    labels = spark.createDataFrame([(r[0], 1) for r in good], "doc_id bigint, quality int")
    assert quality.classify(table(spark, good + bad), labels).where("keep").count() >= 0.95 * len(good)


def test_no_row_holds_a_whole_block():
    """Texts of one block travel in several streams, each of them whole texts in their order."""
    import numpy as np
    import pyarrow as pa
    batch = pa.record_batch([pa.array(range(9))], ["doc_id"])
    lengths = np.array([0, 3, 1, 1, 0, 5, 1, 0, 1]) * quality.STREAM // 2
    blocks = np.array([4] * 7 + [5, 5])
    found = [(rows.column(0).to_pylist(), block) for rows, block in quality.streams(batch, lengths, blocks)]
    assert [k for rows, _ in found for k in rows] == list(range(9)) and {b for rows, b in found if 8 in rows or 7 in rows} == {5}
    assert all(sum(lengths[k] for k in rows[:-1]) < quality.STREAM for rows, _ in found) and len(found) > 4
