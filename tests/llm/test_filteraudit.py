"""Survival words against taking every document through every order."""
import random
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest

from corpusql.llm import filteraudit

from brute import edge_rows, table, words

LABELS = "doc_id bigint, quality int, toxic int, part string"


def _fails(rows):
    least = {}
    for i, t, _, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    out = []
    for i, t, _, source in rows:
        t = t or ""
        w = words(t)
        out.append((i, source or "", {f for f, c in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
            any(c in "#$%&*|" for c in t), t in least and (i is None or least[t] < i))) if c}))
    return out


def _brute(rows, good, toxic):
    by_part = defaultdict(list)
    for i, part, fails in _fails(rows):
        by_part[part].append((i, fails))
    out = {}
    for part, docs in by_part.items():
        shapley = defaultdict(int)
        mine = {}
        for order in map("".join, permutations("ABCDE")):
            alive = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in alive if f in d[1]]
                alive = [d for d in alive if f not in d[1]]
                shapley[f] += len(gone)
                failing = sum(f in x for _, x in docs)
                mine[order, step] = (len(alive), len(gone), failing - len(gone), sum(x == {f} for _, x in docs),
                                     sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))
        for (order, step), v in mine.items():
            out[part, order, step] = (*v, shapley[order[step - 1]])
    return out


def _rows():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)] + ["Up", "HIGH", "a$b", "c|d"]
    extra = []
    for i in range(100, 180):
        n = rng.choice([5, 150, 220, 400])
        pool = rng.sample(vocabulary, rng.choice([20, 120, 400]))
        extra.append((i, " ".join(rng.choice(pool) for _ in range(n)), "en", rng.choice(["a", "b", None, ""])))
    copies = [(200 + k, extra[k % 5][1], "de", rng.choice(["a", "c"])) for k in range(40)]
    return edge_rows() + extra + copies + [(None, extra[0][1], "en", "a"), (None, "alone", "en", "a"), (None, "alone", "en", "z")]


def test_carry_save_counts():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 4, 10, 1000, 4097):
        words_ = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
        want = [int(((words_ >> np.uint32(s)) & np.uint32(1)).sum()) for s in range(32)]
        assert filteraudit.carry_save(words_).tolist() == want


@pytest.mark.parametrize("groups", [4096, 1])
def test_against_every_order(spark, monkeypatch, groups):
    monkeypatch.setattr(filteraudit, "MOST_GROUPS", groups)
    rows = _rows()
    labels = [(i, i % 2, int(i % 3 == 0), "x") for i in range(0, 240, 2)] + [(100, 1, 0, "x"), (101, None, None, "x"), (None, 1, 1, "x"), (9, 1, 1, None)]
    good = {i for i, q, _, _ in labels if q == 1} - {None}
    toxic = {i for i, _, t, _ in labels if t == 1} - {None}
    got = filteraudit.filter_audit(table(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    want = _brute(rows, good, toxic)
    assert len(got) == len(want) == 120 * 5 * len({s or "" for _, _, _, s in rows})
    for r in got:
        assert (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) == want[r.part, r.filter_order, r.step]


def test_empty_tables(spark):
    labels = spark.createDataFrame([], LABELS)
    assert filteraudit.filter_audit(table(spark, []), labels).count() == 0
    got = filteraudit.filter_audit(table(spark, [(1, None, None, None)]), labels).collect()
    assert len(got) == 600 and {r.part for r in got} == {""}
    assert all(r.kept == int("A" not in r.filter_order[:r.step]) and r.shapley == (120 if r.filter_order[r.step - 1] == "A" else 0) for r in got)


def test_very_long_text(spark):
    text = "ab " * 400_000 + "Z"
    got = filteraudit.filter_audit(table(spark, [(1, text, "en", "a"), (2, text, "en", "a")]), spark.createDataFrame([], LABELS))
    last = {r.filter_order: r for r in got.where("step = 1").collect()}
    assert [(last[o].kept, last[o].removed) for o in ("ABCDE", "BACDE", "CABDE", "DABCE", "EABCD")] == [(2, 0), (0, 2), (2, 0), (2, 0), (1, 1)]
