"""Homomorphic fingerprints: edits, order, insertion and deletion."""
import hashlib
import math
import re
import struct

import xxhash

from pyspark.sql import functions as F

from corpusql.llm import multiset

from brute import edge_rows, table


def _lanes(spark, *texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string")
    return [r.lanes for r in multiset.document_fingerprints(df).orderBy("doc_id").collect()]


def test_order_insertion_and_deletion(spark):
    one, two = "First line here.\nSecond line.\n", "A third one! "
    a, b, ab, ba = _lanes(spark, one, two, one + two, two + one)
    assert ab == ba != a
    df = spark.createDataFrame([(a, b, ab)], "a array<bigint>, b array<bigint>, ab array<bigint>")
    r = df.select(multiset.insert(F.col("a"), F.col("b")).alias("sum"), multiset.delete(F.col("ab"), F.col("b")).alias("rest")).first()
    assert r["sum"] == ab and r["rest"] == a


def test_edits_of_edge_documents(spark):
    rows = edge_rows()
    got = multiset.fingerprint_edits(table(spark, rows))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    got = got.collect()
    distinct = sorted({(i, t) for i, t, _, _ in rows}, key=lambda r: (r[0] is None, r[0] or 0))
    after = {d: n for d, n in zip(distinct, distinct[1:] + distinct[:1])}
    assert len(got) == len(rows)
    prints = {}
    for r in got:
        text, head = next(((t or "", after[i, t][1] or "") for i, t in distinct if i == r.doc_id))
        q = len(text) // 4
        edited = text[:len(text) - q] + head[:q]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if q == 0:
            assert r.near_edited == 1 and r.edited_fingerprint == r.fingerprint
    assert len(set(prints.values())) == len(prints)
    assert next(r for r in got if r.doc_id == 0).near_next == 1
    assert next(r for r in got if r.doc_id == 10).near_edited > 0.5


def test_one_document_and_none(spark):
    r = multiset.fingerprint_edits(table(spark, [(5, "Alone here. Really alone.", "en", "a")])).first()
    assert r.next_id == 5 and r.near_next == 1
    assert multiset.fingerprint_edits(table(spark, [])).count() == 0


def _fingerprint(text):
    """The lanes in plain Python."""
    parts = PARAGRAPH.findall(text)
    hashes = [[xxhash.xxh64_intdigest(p.encode(), xxhash.xxh64_intdigest(struct.pack("<i", j), 42)) for p in parts] for j in range(5)]
    wide = [sum(h >> s & 0xFFFFFFFF for h in hs) & 0xFFFFFFFF for hs in hashes[:4] for s in (0, 32)]
    counts = [sum(h >> b & 1 for h in hashes[4]) for b in range(64)]
    signs = [2 * counts[b + s] - len(parts) for s in (0, 32) for b in range(30)]
    return wide, len(parts), signs


PARAGRAPH = re.compile(multiset.PARAGRAPH, re.ASCII)


def _likeness(one, other):
    if one == other:
        return 1.0
    size = math.sqrt(sum(x * x for x in one)) * math.sqrt(sum(x * x for x in other))
    return max(0.0, min(1.0, sum(x * y for x, y in zip(one, other)) / size)) if size else 0.0


def test_lanes_and_likeness_in_plain_python(spark):
    rows = [(i, t) for i, t, _, _ in edge_rows() if i is not None and i != 7]
    texts = [t or "" for _, t in sorted(rows)]
    got = multiset.fingerprint_edits(table(spark, [(i, t, "en", "a") for i, t in rows])).orderBy("doc_id").collect()
    lanes = [r.lanes for r in multiset.document_fingerprints(table(spark, [(i, t, "en", "a") for i, t in rows])).orderBy("doc_id").collect()]
    for k, r in enumerate(got):
        wide, n, signs = _fingerprint(texts[k])
        assert (lanes[k][:8], lanes[k][-1]) == (wide, n)
        head = texts[(k + 1) % len(texts)]
        q = len(texts[k]) // 4
        edited = _fingerprint(texts[k][:len(texts[k]) - q] + head[:q])
        assert r.edited_fingerprint.startswith("".join(f"{x:08x}" for x in edited[0])) and r.edited_fingerprint.endswith(f"{edited[1]:016x}")
        assert abs(r.near_edited - _likeness(signs, edited[2])) < 1e-9
        assert abs(r.near_next - _likeness(signs, _fingerprint(head)[2])) < 1e-9


def test_a_million_equal_lines(spark):
    """Counters of a very long text stay apart: it points where a short one of the same lines does."""
    rows = [(1, "a\n" * (1 << 20), "en", "a"), (2, "a\n" * 1000 + "b\n", "en", "a")]
    got = {r.doc_id: r for r in multiset.fingerprint_edits(table(spark, rows)).collect()}
    assert got[1].near_next > 0.99 and got[2].near_next > 0.99
