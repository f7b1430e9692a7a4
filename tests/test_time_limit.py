"""Executed texts: fused jobs, blame by halves, and the time limit."""
import time

from corpusql.operators import execution
from corpusql.plans import fixtures as fx
from corpusql.sources import registry
from corpusql.sources.registry import DatabaseSessions

from conftest import SF_SMALL

ENDLESS = "SELECT count(*) FROM lineitem a, lineitem b, lineitem c WHERE a.l_quantity + b.l_quantity + c.l_quantity < 0"


def _run(spark, texts, **kw):
    sessions = DatabaseSessions(spark, fx.registry_table(spark, SF_SMALL))
    queries = spark.createDataFrame([("src0", t) for t in texts], "db_id string, sql string")
    rows, status = execution.execute_queries(spark, queries, sessions, **kw)
    return {r.exec_sql: r for r in status.collect()}, rows


def test_an_endless_text_ends_in_the_limit(spark):
    began = time.monotonic()
    got, _ = _run(spark, [ENDLESS, "SELECT count(*) FROM nation", "SELECT n_name FROM nation WHERE n_regionkey = 1"], time_limit_s=6.0)
    assert time.monotonic() - began < 90
    assert got[ENDLESS].error == "timed out after 6 s" and got[ENDLESS].n_rows == -1
    assert got["SELECT count(*) FROM nation"].error is None and got["SELECT n_name FROM nation WHERE n_regionkey = 1"].n_rows == 5
    assert spark.sql("SELECT 1 AS a").first().a == 1         # no tag is left behind


def test_one_failing_text_is_blamed_alone(spark, monkeypatch):
    runs = []
    whole = execution._run_fused
    monkeypatch.setattr(execution, "_run_fused", lambda session, texts, *a: (runs.append(len(texts)), whole(session, texts, *a))[1])
    good = [f"SELECT {i} + count(*) AS n FROM nation" for i in range(30)]
    bad = "SELECT 1 / (n_nationkey - n_nationkey) FROM nation"
    got, rows = _run(spark, [*good, bad, "SELECT nothing FROM nation"], fused=32)
    assert all(got[t].error is None and got[t].n_rows == 1 for t in good)
    assert "DIVIDE_BY_ZERO" in got[bad].error and "UNRESOLVED_COLUMN" in got["SELECT nothing FROM nation"].error
    assert rows.count() == 30 and max(runs) == 31 and len(runs) <= 12    # halves of the batch with the failing text
    runs.clear()
    _run(spark, good, fused=10)
    assert runs == [10, 10, 10]


def test_errors_beyond_what_the_driver_holds(spark, monkeypatch):
    monkeypatch.setattr(execution, "ERRORS_HELD", 2)
    got, _ = _run(spark, [f"SELECT c{i} FROM nation" for i in range(9)] + ["SELECT 1 AS a"], fused=2, max_workers=1)
    assert sum(r.error is not None for r in got.values()) == 9 and got["SELECT 1 AS a"].n_rows == 1


def test_databases_of_a_registry_table(spark, monkeypatch):
    monkeypatch.setattr(DatabaseSessions, "SESSIONS_HELD", 1)
    entries = [("a", "nation", f"{SF_SMALL}/nation.parquet"), ("b", "nation", f"{SF_SMALL}/region.parquet"), ("gone", "nation", "/nowhere/x"),
               ("half", "nation", f"{SF_SMALL}/nation.parquet"), ("half", "region", "/nowhere/y"), ("same", "nation", f"{SF_SMALL}/nation.parquet")]
    sessions = DatabaseSessions(spark, registry.registry_from_dirs(spark, entries))
    phys = {r.db_id: r.phys for r in sessions.physical().collect()}
    assert set(phys) == {"a", "b", "same"} and phys["a"] == phys["same"] != phys["b"]
    queries = spark.createDataFrame([(d, "SELECT count(*) FROM nation") for d in ("a", "b", "same", "gone")], "db_id string, sql string")
    rows, status = execution.execute_queries(spark, queries, sessions)
    assert sorted((r.db_id, r.n_rows) for r in status.collect()) == [("a", 1), ("b", 1), ("gone", -1)]
    assert sorted(r.row[0] for r in rows.collect()) == ["25", "5"]


def test_paths_that_tasks_cannot_look_at(spark, monkeypatch):
    """A file system without a client in the tasks is asked by the driver, some paths at a time."""
    monkeypatch.setattr(registry, "DRIVER_PATHS", 2)
    root = spark._jvm.org.apache.hadoop.fs.Path(SF_SMALL).toUri().toString()
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.t.link./in", f"file://{root}")
    entries = [(t, t, f"viewfs://t/in/{t}.parquet") for t in ("nation", "region", "part", "none")] + [("file", "x", f"file://{SF_SMALL}/nation.parquet")]
    there = {r.path: r.there for r in registry.existing_paths(registry.registry_from_dirs(spark, entries)).collect()}
    assert there == {p: "none" not in p for _, _, p in entries}
