from pyspark.sql import functions as F

from corpusql.operators import execution
from corpusql.plans import fixtures as fx
from corpusql.sources.registry import DatabaseSessions

from conftest import SF_SMALL


def _rows(spark, rows):
    return spark.createDataFrame(rows, "pair_id bigint, side string, row array<string>")


def _status(spark, rows):
    return spark.createDataFrame(rows, "pair_id bigint, side string, error string")


def test_result_set_edges(spark):
    r = [
        # 1 permuted rows -> equal
        (1, "gold", ["a", "1"]), (1, "gold", ["b", "2"]), (1, "pred", ["b", "2"]), (1, "pred", ["a", "1"]),
        # 2 duplicates with different multiplicity -> not equal
        (2, "gold", ["a"]), (2, "gold", ["a"]), (2, "pred", ["a"]),
        # 3 permuted columns -> not equal
        (3, "gold", ["a", "1"]), (3, "pred", ["1", "a"]),
        # 5 one empty
        (5, "gold", ["x"]),
        # 6 error on pred side
        (6, "gold", ["x"]), (6, "pred", ["x"]),
        # 7 NULL (as None) against text None -> equal; 8: 1 vs 1.0 -> not equal
        (7, "gold", ["None"]), (7, "pred", ["None"]), (8, "gold", ["1"]), (8, "pred", ["1.0"]),
    ]
    st = [(i, s, None) for i in range(1, 9) for s in ("gold", "pred")]
    st = [x for x in st if not (x[0] == 6 and x[1] == "pred")] + [(6, "pred", "boom")]
    got = {x["pair_id"]: x["exec_match"] for x in execution.result_sets_equal(_rows(spark, r), _status(spark, st)).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: False, 6: False, 7: True, 8: False}


def test_result_set_symmetry(spark):
    r = [(1, "gold", ["a"]), (1, "pred", ["a"]), (1, "pred", ["a"])]
    flip = [(i, "pred" if s == "gold" else "gold", row) for i, s, row in r]
    st = [(1, "gold", None), (1, "pred", None)]
    a = execution.result_sets_equal(_rows(spark, r), _status(spark, st)).first()["exec_match"]
    b = execution.result_sets_equal(_rows(spark, flip), _status(spark, st)).first()["exec_match"]
    assert a == b is False


def test_execution_accuracy_pairs(spark):
    sessions = DatabaseSessions(spark, fx.registry(spark, SF_SMALL))
    v = {r["example_id"]: r for r in execution.execution_accuracy(
        spark, fx.execution_pairs(spark, SF_SMALL), sessions).collect()}
    assert v[1]["exec_match"] and v[4]["exec_match"] and v[7]["exec_match"] and v[13]["exec_match"]
    assert not v[3]["exec_match"] and not v[5]["exec_match"] and not v[6]["exec_match"]
    assert v[9]["pred_error"].startswith("[UNRESOLVED_COLUMN") and v[9]["pred_rows"] == -1
    assert "TABLE_OR_VIEW_NOT_FOUND" in v[10]["pred_error"]
    assert v[15]["pred_error"] is not None                       # not a query
    assert v[16]["db_found"] is False and v[16]["gold_rows"] == -1 and not v[16]["exec_match"]
    assert v[18]["exec_match"] and not v[19]["exec_match"]


def test_rows_that_differ_only_in_their_cuts_or_nulls(spark):
    """Rows are compared by one text each, which is shorter than the array and differs for every two rows."""
    rows = [["a", "b"], ["ab"], ["a1:b"], ["1:a", "b"], ["a", None], ["a", "n"], [None, "a"], ["", "a"], ["a", ""], ["a"], [], ["é", "☃"], ["é☃"]]
    keyed = _rows(spark, [(i, "gold", r) for i, r in enumerate(rows)]).select(execution.row_key("row").alias("k"))
    assert keyed.distinct().count() == len(rows)
    pairs = [(i * len(rows) + j, a, b) for i, a in enumerate(rows) for j, b in enumerate(rows)]
    both = _rows(spark, [x for i, a, b in pairs for x in ((i, "gold", a), (i, "pred", b))])
    status = _status(spark, [(i, side, None) for i, _, _ in pairs for side in ("gold", "pred")])
    got = {r["pair_id"]: r["exec_match"] for r in execution.result_sets_equal(both, status).collect()}
    assert got == {i: a == b for i, a, b in pairs}
