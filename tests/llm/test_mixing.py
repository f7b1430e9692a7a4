"""Mixing against sorting by hash."""
import math

from corpusql.llm import mixing

from brute import edge_rows, mix, table, words


def test_edges(spark):
    rows = edge_rows()
    taken, target = mix([(i, t, s) for i, t, _, s in rows])
    got = mixing.mix_table(table(spark, rows)).collect()
    want = sorted((str(rows[k][0]), len(words(rows[k][1])), taken[k]) for k in taken)
    assert sorted((str(r.doc_id), r.size, r.taken) for r in got) == want
    for r in got:
        assert math.isclose(r.target, target[r.source]) and r.taken <= 3 * r.size


def test_documents_are_repeated_and_keep_their_columns(spark):
    rows = edge_rows()
    docs = table(spark, rows)
    taken, _ = mix([(i, t, s) for i, t, _, s in rows])
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(words(r.text)) for r in mixed.collect()) == sum(taken.values())


def test_sources_of_no_words_and_empty_tables(spark):
    docs = table(spark, [(1, None, "en", "a"), (2, "", "en", "b")])
    assert {(r.doc_id, r.target, r.taken) for r in mixing.mix_table(docs).collect()} == {(1, 0.0, 0), (2, 0.0, 0)}
    assert mixing.mix_table(table(spark, [])).count() == 0
    assert mixing.mix_documents(table(spark, [])).count() == 0


def test_reruns_agree_and_plan_is_native(spark):
    docs = table(spark, edge_rows())
    one, two = (sorted(map(tuple, mixing.mix_table(docs).collect()), key=repr) for _ in range(2))
    assert one == two
    plan = mixing.mix_table(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
