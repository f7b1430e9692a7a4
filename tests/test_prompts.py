from pyspark.sql import functions as F

from corpusql.functions import prompts as P
from corpusql.operators import prompting


def test_zero_shot_and_template(spark):
    df = spark.createDataFrame([("CREATE TABLE t ({x});", "How many?")], "schema string, question string")
    z = df.select(P.zero_shot_prompt("schema", "question")).first()[0]
    assert z == ("Given the following database schema, write a SQL query that answers the question.\n\n"
                 "Schema:\nCREATE TABLE t ({x});\n\nQuestion: How many?\n\nSQL:")
    t = df.select(P.template_prompt(None, "schema", "question")).first()[0]
    assert t == z                                    # default template equals the zero-shot text
    c = df.select(P.template_prompt(P.CONFIG_PROMPT_TEMPLATE, "schema", "question")).first()[0]
    assert c == z + "\n"
    lit = df.select(P.template_prompt("{{schema}} {question}", "schema", "question")).first()[0]
    assert lit == "{schema} How many?"


def test_sft_text(spark):
    df = spark.createDataFrame([("S", "Q", "SELECT 1", "i", "db")],
                               "schema string, question string, output string, instruction string, db_id string")
    out = prompting.sft_text(df)
    assert out.columns == ["text"]
    assert out.first()[0].endswith("SQL:\n SELECT 1")


def _train(spark, dbs):
    rows = []
    pos = 0
    for d, n, slen in dbs:
        for i in range(n):
            rows.append((d, "S" * slen, f"q{pos}", f"SELECT {pos}", pos))
            pos += 1
    return spark.createDataFrame(rows, "db_id string, schema string, question string, output string, pos bigint")


def test_few_shot_invariants(spark):
    train = _train(spark, [("a", 6, 10), ("b", 4, 30), ("c", 8, 5), ("d", 2, 50)])
    test = spark.createDataFrame([(i, db) for i, db in enumerate(["a", "b", "c", "zz", ""] * 4)],
                                 "index bigint, db_id string")
    picks = prompting.select_few_shot(test, train, 3, 42).collect()
    by = {}
    for r in picks:
        by.setdefault(r["index"], []).append(r)
    tr = {r["pos"]: r for r in train.collect()}
    ordered = sorted(tr.values(), key=lambda r: (len(r["schema"]), r["db_id"], r["pos"]))
    for r in test.collect():
        got = by[r["index"]]
        assert sorted(x["slot"] for x in got) == [1, 2, 3]
        assert len({x["pick_pos"] for x in got}) == 3                       # distinct
        cands = [x for x in ordered if not r["db_id"] or x["db_id"] != r["db_id"]]
        pool = cands[: len(cands) // 2] if len(cands) // 2 >= 3 else cands
        assert {x["pick_pos"] for x in got} <= {x["pos"] for x in pool}     # within the pool
        assert all(x["pick_db_id"] != r["db_id"] for x in got)               # never own database


def test_few_shot_small_pool_and_k0(spark):
    train = _train(spark, [("a", 2, 10), ("b", 2, 20)])
    test = spark.createDataFrame([(0, "a")], "index bigint, db_id string")
    picks = prompting.select_few_shot(test, train, 5, 1).collect()
    assert sorted(r["pick_pos"] for r in picks) == [2, 3]                   # pool < k -> all candidates
    assert prompting.select_few_shot(test, train, 0, 1).count() == 0
    full = spark.createDataFrame([(0, "a", "SCH", "Q?")], "index bigint, db_id string, schema string, question string")
    prompt = prompting.prompt_few_shot(full, prompting.select_few_shot(test, train, 0, 1)).first()["prompt"]
    assert prompt == (P.FEW_SHOT_HEADER + "\n\n### Your Turn\nSchema:\nSCH\n\nQuestion: Q?\n\nSQL:")


def test_few_shot_prompt_text(spark):
    train = _train(spark, [("b", 2, 3)])
    test = spark.createDataFrame([(0, "a", "SCH", "Q?")], "index bigint, db_id string, schema string, question string")
    picks = prompting.select_few_shot(test, train, 1, 3)
    p = prompting.prompt_few_shot(test, picks).first()["prompt"]
    assert "\n### Example 1\nSchema:\nSSS\n\nQuestion: q" in p
    assert p.endswith("\n### Your Turn\nSchema:\nSCH\n\nQuestion: Q?\n\nSQL:")
    s = prompting.prompt_few_shot_shared(test, picks).first()["prompt"]
    assert s.startswith(P.SHARED_FEW_SHOT_HEADER + "\n### Example 1\n\nSchema:\nSSS\n\nQuestion: q")


def test_few_shot_plan_has_no_cross_join(spark):
    train = _train(spark, [("a", 3, 1), ("b", 3, 2)])
    test = spark.createDataFrame([(0, "a")], "index bigint, db_id string")
    plan = prompting.select_few_shot(test, train, 2, 1)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
