"""Circulant MinHash components against all pairs of sets."""
import random
from collections import defaultdict

import numpy as np
import pytest

from corpusql.llm import minhash

from brute import edge_rows, table, words


def _set(text, width=2):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i:i + width]) for i in range(max(len(w) - width + 1, 1))) if w else frozenset()


def _brute(rows, least=80, width=2):
    """``(id, size, component, kept)`` of every row."""
    sets = sorted({s for s in (_set(t, width) for _, t, _, _ in rows) if s}, key=sorted)
    root = {s: s for s in sets}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s
    for k, a in enumerate(sets):
        for b in sets[k + 1:]:
            if 100 * len(a & b) >= least * len(a | b):
                root[find(a)] = find(b)
    ids = defaultdict(list)
    for i, t, _, _ in rows:
        if _set(t, width):
            ids[find(_set(t, width))].append(i)
    name = {s: min((i for i in v if i is not None), default=None) for s, v in ids.items()}
    out = []
    for i, t, _, _ in rows:
        s = _set(t, width)
        c = name[find(s)] if s else i
        out.append((i, len(s), c, i == c))
    return sorted(out, key=repr)


def _families(n=12):
    """Chains of small edits, stars around one text, and texts that share a long passage only."""
    rng = random.Random(7)
    pool = [f"v{i}" for i in range(3000)]
    rows, k = [], 100
    for f in range(n):
        base = [rng.choice(pool) for _ in range(rng.choice([3, 8, 40, 120]))]
        text = list(base)
        for step in range(8):
            text = list(base) if f % 2 else text
            for _ in range(max(1, len(text) // 25)):
                text[rng.randrange(len(text))] = rng.choice(pool)
            rows.append((k, " ".join(text), "en", "a"))
            k += 1
    passage = [rng.choice(pool) for _ in range(90)]
    for _ in range(60):
        own = [rng.choice(pool) for _ in range(rng.choice([5, 15, 30, 60]))]
        rows.append((k, " ".join(passage + own), "en", "b"))
        k += 1
    return rows


@pytest.mark.parametrize("limit", [48, 1])
def test_against_all_pairs(spark, monkeypatch, limit):
    """With ``limit`` 1 every bucket with several components is a large one."""
    monkeypatch.setattr(minhash, "PAIRS_UP_TO", limit)
    rows = edge_rows() + _families() + [(None, "only here without id", "en", "a"), (None, "only here without id", "en", "a")]
    got = minhash.near_duplicates(table(spark, rows)).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=repr) == _brute(rows)


def test_other_width_and_similarity(spark):
    rows = edge_rows() + _families(6)
    got = minhash.near_duplicates(table(spark, rows), width=3, least=90).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=repr) == _brute(rows, 90, 3)


def test_coordinates_agree_as_often_as_sets_overlap():
    rng = np.random.default_rng(5)
    agree = []
    for _ in range(60):
        x = rng.integers(0, 1 << 64, 190, dtype=np.uint64)
        a, b = np.unique(x[:180]), np.unique(x[20:])          # similarity 160 / 190
        s = minhash.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        agree.append((s[0] == s[1]).mean())
    assert abs(np.mean(agree) - 160 / 190) < 0.02
    assert len(np.unique(minhash._first_permutation(np.arange(1 << 16, dtype=np.uint32)))) == 1 << 16


def test_similarity_at_the_limit_and_empty(spark):
    nine, ten = " ".join(f"a{i}" for i in range(9)), " ".join(f"a{i}" for i in range(11))    # sets of 8 and 10: 0.8
    rows = [(5, nine, "en", "a"), (3, ten, "en", "a"), (9, " ".join(f"a{i}" for i in range(12)), "en", "a"), (8, "", "en", "a"), (7, None, "en", "a")]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(table(spark, rows)).collect()}
    assert got == {5: (8, 3, False), 3: (10, 3, True), 9: (11, 3, False), 8: (0, 8, True), 7: (0, 7, True)}
    assert minhash.near_duplicates(table(spark, [])).count() == 0


def test_one_family_of_many_sets_needs_few_pairs(spark):
    """A star is compared by its centre: the pairs grow with the sets, not with their square."""
    rng = random.Random(2)
    base = [f"b{i}" for i in range(300)]
    rows = []
    for i in range(400):
        text = list(base)
        text[rng.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(text), "en", "a"))
    nodes = minhash.stored(minhash.node_table(minhash.stored(minhash.set_table(table(spark, rows)), "t")), "t")
    shared = minhash.shared_buckets(nodes)
    assert shared.where("node != first").select("first", "node").distinct().count() < 20 * 400
    got = minhash.near_duplicates(table(spark, rows)).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1
