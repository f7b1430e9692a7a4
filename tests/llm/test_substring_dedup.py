"""FM-index and merged-transform deduplication against brute force."""
import random

import numpy as np
import pytest

from corpusql.llm import bwtmerge, fmindex, repeats

from brute import byte_dedup, edge_rows, fm_dedup, table


def test_wavelet_rank_and_intervals():
    rng = np.random.default_rng(1)
    for sigma in (2, 5, 40):
        text = rng.integers(0, sigma, 700)
        matrix = fmindex.WaveletMatrix(text, sigma)
        at, symbol = rng.integers(0, 701, 300), rng.integers(0, sigma, 300)
        assert matrix.rank(symbol, at).tolist() == [int((text[:a] == c).sum()) for a, c in zip(at, symbol)]
    text = rng.integers(1, 4, 400)
    text[::50] = 0
    index = fmindex.FMIndex(text, 5)
    for a in range(0, 390):
        pattern = text[a:a + 5].tolist()
        if 0 in pattern:
            continue
        lo, hi = (int(x[0]) for x in index.intervals(np.array([a]), 5))
        same = [i for i in range(396) if text[i:i + 5].tolist() == pattern]
        assert sorted(index.suffix[lo:hi].tolist()) == same and index.suffix[lo] == same[0]


def test_merge_is_the_sorted_order():
    rng = random.Random(2)
    block, depth = 1, 6
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(3, 40))).encode() for _ in range(30)]
    data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    sizes = np.array([len(t) + 1 for t in texts])
    begin = np.cumsum(sizes) - sizes
    seg = np.repeat(np.arange(len(texts)), sizes)
    ends = (begin + sizes - 1)[seg]
    code = bwtmerge.symbols(data, ends, block)
    before = np.where(np.arange(len(data)) - 1 >= begin[seg], code[np.arange(len(data)) - 1], 0)
    transforms, rows = [], []
    for a, b in ((0, 7), (7, 8), (8, 21), (21, 30)):
        lo, hi = begin[a], begin[b - 1] + sizes[b - 1]
        order = lo + bwtmerge.sorted_rows(code[lo:hi], ends[lo:hi] - lo, block, depth)
        rows.append(order)
        transforms.append(before[order])
    merged, common = bwtmerge.merge(transforms, depth)
    at = np.concatenate(rows)[merged]
    key = [tuple(code[p:min(p + depth, ends[p] + 1)]) for p in at]
    assert key == sorted(key)

    def shared(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return min(n, depth)
    for k in range(1, len(key)):
        full = shared(key[k - 1], key[k])
        assert common[k] == (depth if key[k - 1] == key[k] else full)


def _corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(12)]
    passages = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 30))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 25)))]
        for _ in range(rng.randint(0, 2)):
            parts.append(rng.choice(passages))
            parts.append(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 12))))
        rows.append((rng.randint(0, n), rng.choice(["  ", "\n", " "]).join(parts)))
    return rows


@pytest.mark.parametrize("heavy", [1 << 14, 4])
def test_fm_dedup_is_brute_force(spark, monkeypatch, heavy):
    monkeypatch.setattr(repeats, "HEAVY", heavy)          # few common runs: also with heavy anchors
    monkeypatch.setattr(repeats, "LEAST_HEAVY", 2)
    rows = _corpus(3)
    docs = table(spark, [(i, t, "en", "s") for i, t in rows])
    got = fmindex.remove_repeats(docs, length=6).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.text) for r in got) == sorted(fm_dedup(rows, 6))


def test_bytes_dedup_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(bwtmerge, "SHARD_BYTES", 300)
    rows = _corpus(4)
    docs = table(spark, [(i, t, "en", "s") for i, t in rows])
    got = bwtmerge.remove_repeats(docs, length=24).collect()
    assert (sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got)
            == sorted(byte_dedup(rows, 24)))


def _sorted(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r))


def test_edges(spark):
    rows = edge_rows()
    docs = table(spark, rows)
    pairs = [(i, t) for i, t, _, _ in rows]
    got = fmindex.remove_repeats(docs).collect()
    assert _sorted((r.doc_id, r.n_words, r.n_removed, r.text) for r in got) == _sorted(fm_dedup(pairs, 13))
    got = bwtmerge.remove_repeats(docs).collect()
    assert (_sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got)
            == _sorted(byte_dedup(pairs, 400)))
    kept = fmindex.without_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    assert {r.key for r in kept.collect()} == {"k"}


def test_empty_tables(spark):
    docs = table(spark, [])
    assert fmindex.remove_repeats(docs).count() == 0
    assert bwtmerge.remove_repeats(docs).count() == 0


@pytest.mark.parametrize("hot", [1 << 20, 300, 0])
def test_split_hot_keys_are_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_BYTES", hot)
    rows = _corpus(5)
    docs = table(spark, [(i, t, "en", "s") for i, t in rows])
    got = fmindex.remove_repeats(docs, length=6).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.text) for r in got) == sorted(fm_dedup(rows, 6))
    got = bwtmerge.remove_repeats(docs, length=80).collect()
    assert (sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got)
            == sorted(byte_dedup(rows, 80)))


def test_one_hot_key_is_no_single_group(spark, monkeypatch):
    """A passage shorter than a window in 300 texts, no two of the same surroundings, some with more in common."""
    most = 20_000
    monkeypatch.setattr(repeats, "LEAST_HEAVY", 1 << 40)
    monkeypatch.setattr(repeats, "HOT_BYTES", most, raising=False)
    monkeypatch.setattr(bwtmerge, "TASK_BYTES", most)
    make = bwtmerge.repeated_starts

    def limited(length):
        solve = make(length)

        def run(texts, starts, n, least):
            assert sum(map(len, texts)) <= 2 * most, "one key is one group"
            return solve(texts, starts, n, least)
        return run
    monkeypatch.setattr(bwtmerge, "repeated_starts", limited)
    rng = random.Random(6)
    filler = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, ends = filler(385), [filler(40) for _ in range(3)]
    rows = [(i, filler(300) + passage + (ends[i % 3] if i < 9 else "") + filler(300)) for i in range(300)]
    docs = table(spark, [(i, t, "en", "s") for i, t in rows])
    got = bwtmerge.remove_repeats(docs).collect()
    assert (sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got)
            == sorted(byte_dedup(rows, 400)))
