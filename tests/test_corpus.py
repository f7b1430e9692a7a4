import pytest
from pyspark.sql import functions as F

from corpusql.operators import corpus


def _examples(spark, n_db, per_db=3):
    rows = [(f"db{d}", f"q{d}-{i}", d * 100 + i) for d in range(n_db) for i in range(per_db)]
    return spark.createDataFrame(rows, "db_id string, question string, pos bigint")


@pytest.mark.parametrize("n_db,ratio,n_val", [(0, 0.1, 0), (1, 0.1, 1), (2, 0.1, 1), (2, 1.0, 2),
                                              (20, 0.0, 1), (20, 0.1, 2), (20, 1.0, 20)])
def test_split_counts(spark, n_db, ratio, n_val):
    df = corpus.split_by_database(_examples(spark, n_db), ratio, 42)
    per_db = df.groupBy("db_id").agg(F.countDistinct("split").alias("k"), F.first("split").alias("s")).collect()
    assert all(r["k"] == 1 for r in per_db)                 # whole databases only
    assert sum(r["s"] == "val" for r in per_db) == n_val
    assert df.count() == n_db * 3


def test_split_deterministic_across_partitions(spark):
    a = corpus.split_by_database(_examples(spark, 30).repartition(7), 0.2, 7)
    b = corpus.split_by_database(_examples(spark, 30).coalesce(1), 0.2, 7)
    assert sorted(a.select("pos", "split").collect()) == sorted(b.select("pos", "split").collect())


def test_split_order_dense(spark):
    df = corpus.split_by_database(_examples(spark, 5), 0.4, 1)
    ordered = corpus.split_order(df).collect()
    for s in ("train", "val"):
        rows = sorted([r for r in ordered if r["split"] == s], key=lambda r: r["ord"])
        assert [r["ord"] for r in rows] == list(range(len(rows)))
        assert [(r["db_id"], r["pos"]) for r in rows] == sorted((r["db_id"], r["pos"]) for r in rows)


def test_sample_examples(spark):
    ex = _examples(spark, 4)
    assert corpus.sample_examples(ex, 0, 1).count() == 12
    assert corpus.sample_examples(ex, 50, 1).count() == 12
    s = corpus.sample_examples(ex, 5, 1).collect()
    assert len(s) == 5 and len({r["pos"] for r in s}) == 5
    assert s == corpus.sample_examples(ex, 5, 1).collect()


def test_convert_and_orphans(spark):
    raw = spark.createDataFrame([("a", "q1", "SELECT 1", 0), ("zz", "q2", "SELECT 2", 1)],
                                "db_id string, question string, query string, pos bigint")
    lookup = spark.createDataFrame([("a", "CREATE TABLE t (\n  c TEXT\n);")], "db_id string, schema string")
    conv = corpus.convert_examples(raw, lookup).collect()
    assert len(conv) == 1 and conv[0]["output"] == "SELECT 1"
    assert conv[0]["instruction"].startswith("Given the database schema")
    orph = corpus.orphan_examples(raw, lookup).collect()
    assert [(r["db_id"], r["n_skipped"]) for r in orph] == [("zz", 1)]
