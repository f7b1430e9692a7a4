"""Source divergence against every pair over every kept term."""
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusql.llm import divergence

from brute import edge_rows, table

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def _brute(rows, least=3, ranks=200):
    docs = [(lang or "", source or "", Counter(TERM.findall((t or "").translate(LOWER)))) for _, t, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(w for _, _, c in mine for w in c)
        kept = sorted(w for w in df if df[w] >= least)
        count = defaultdict(Counter)
        for _, source, c in mine:
            count[source].update({w: n for w, n in c.items() if df[w] >= least})
        whole = sum(count.values(), Counter())
        v = len(kept)

        def p(c, w):
            return 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + v)
        for s in {d[1] for d in mine}:
            found = {"pair": [], "term": []}
            for t in {d[1] for d in mine} - {s}:
                found["pair"].append((t, sum((p(count[s], w) - p(count[t], w)) ** 2 // p(count[t], w) for w in kept)))
            for w in kept:
                a, q = p(count[s], w), p(whole, w)
                if count[s][w] and a > q:
                    found["term"].append((w, (a - q) ** 2 // q))
            for part, items in found.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, value, k) for k, (i, value) in enumerate(items, 1) if part == "pair" or k <= ranks]
    return sorted(out)


def _got(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


def _rows(n=150):
    rng = random.Random(11)
    pool = [f"term{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)] + ["Ünï", "ünï", "İx", "ΣΑΣ", "THE", "the", "x1y"]
    texts = [" ".join(rng.choice(pool[:rng.choice([10, 87])]) for _ in range(rng.randrange(40))) for _ in range(n)]
    texts += texts[:30]
    return [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None, ""])) for i, t in enumerate(texts)]


@pytest.mark.parametrize("gather", [400_000, 20])
def test_against_dense_sums(spark, monkeypatch, gather):
    monkeypatch.setattr(divergence, "GATHER", gather)
    rows = _rows() + edge_rows()
    got = _got(divergence.source_divergence(table(spark, rows), ranks=5))
    assert got == _brute(rows, ranks=5)
    assert {r[2] for r in got} == {"pair", "term"}


def test_copies_count_each(spark):
    """A text of many copies is one row, with as many documents as it has copies."""
    rows = [(i, "alpha beta", "en", "ab"[i % 2]) for i in range(50)] + [(60, "gamma", "en", "b"), (60, "gamma", "en", "b"), (61, "gamma", "en", "c")]
    one = {r.text: {s.source: s.n for s in r.sources} for r in divergence.collapsed(table(spark, rows)).collect()}
    assert one == {"alpha beta": {"a": 25, "b": 25}, "gamma": {"b": 2, "c": 1}}
    assert _got(divergence.source_divergence(table(spark, rows))) == _brute(rows)


def test_without_kept_terms_and_empty(spark):
    rows = [(1, "once", "en", "a"), (2, None, "en", "b"), (3, "", None, None), (4, "123 456", "fr", "x"), (5, "only one", "fr", "x")]
    assert _got(divergence.source_divergence(table(spark, rows))) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)] == _brute(rows)
    assert divergence.source_divergence(table(spark, [])).count() == 0


def test_long_text(spark):
    rows = [(1, "long words here " * 100_000, "en", "a"), (2, "long here", "en", "b"), (3, "here long", "en", "b"), (4, "here", "en", "c")]
    assert _got(divergence.source_divergence(table(spark, rows))) == _brute(rows)


def test_shares_beyond_a_long(spark):
    big = 10**12
    row = spark.range(1).select(divergence.share(F.lit(big), F.lit(3 * big), F.lit(7)).alias("p"),
                                divergence.share(F.lit(5), F.lit(100), F.lit(7)).alias("q")).first()
    assert (row.p, row.q) == (1 + 10**9 * (big + 1) // (3 * big + 7), 1 + 10**9 * 6 // 107)
