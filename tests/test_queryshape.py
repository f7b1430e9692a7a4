"""Shapes of texts that patterns read wrongly."""
import pytest

from corpusql.operators import metrics, queryshape

CASES = [
    ("SELECT count(*) FROM a -- join b ON sum(x)", (["a"], 0, ["COUNT"])),
    ("SELECT 'from z join q max(' FROM a /* FROM b */", (["a"], 0, [])),
    ("SELECT * FROM a, b, `c d` WHERE a.x = b.x", (["a", "b", "c d"], 2, [])),
    ("WITH t AS (SELECT avg(v) FROM a) SELECT max(m) FROM t JOIN b USING (k)", (["a", "b"], 1, ["AVG", "MAX"])),
    ("SELECT x FROM a WHERE k IN (SELECT min(k) FROM b WHERE EXISTS (SELECT 1 FROM C))", (["a", "b", "c"], 0, ["MIN"])),
    ("SELECT from_date, join_date FROM a", (["a"], 0, [])),
    ("SELECT sum (v), SUM(DISTINCT v), summary(v) FROM db.a", (["db, a"], 0, ["SUM", "SUM"])),
    ("SELECT 1 UNION SELECT count(x) OVER (PARTITION BY y) FROM a CROSS JOIN b", (["a", "b"], 1, ["COUNT"])),
]


@pytest.mark.parametrize("sql, shape", CASES)
def test_shape(spark, sql, shape):
    assert queryshape.text_shape(spark, sql) == shape


def test_buckets_of_texts_with_misleading_words(spark, monkeypatch):
    monkeypatch.setattr(queryshape, "PARSED_AT_ONCE", 2)
    gold = "SELECT count(*) FROM a WHERE s = 'x'"
    preds = ["SELECT count(*) FROM a WHERE s = 'from b join c'",      # only the literal differs
             "SELECT count(*) FROM a, b WHERE s = 'x'", "SELECT sum(v) FROM a WHERE s = 'count('", "no query from a"]
    rows = [("m", i, gold, p, False, False, None, True) for i, p in enumerate(preds)]
    df = spark.createDataFrame(rows, "mode string, index bigint, gold_sql string, pred_sql string, exact_match boolean, exec_match boolean, "
                                     "pred_error string, db_found boolean")
    assert {r.category: r.examples for r in metrics.error_buckets(df, 5).collect()} == {
        "other": [0], "wrong_join": [1, 3], "wrong_aggregation": [2]}
    assert metrics.error_buckets(df.where("index > 9")).count() == 0
