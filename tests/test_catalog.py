from corpusql.operators import catalog as cat
from corpusql.sources import schemas

ROWS = [
    # db, tables, columns, types, pk (as text), fks, pos
    ("a", ["t", "u", "empty"],
     [["-1", "*"], ["0", "id"], ["0", "name"], ["1", "tid"], ["1", "k2"], ["5", "ghost"]],
     ["text", "number", "text", "number", "weird", "text"],
     ["1", "[3,4]"], [[3, 1], [3, 2], [4, 0]], 0),
    ("b", ["x"], [["-1", "*"], ["0", "c"]], ["text", "time"], None, None, 1),
    ("b", ["y"], [["-1", "*"], ["0", "d"]], ["text", "boolean"], ["1"], [], 2),
]

DDL_A = ("CREATE TABLE t (\n  id INTEGER PRIMARY KEY,\n  name TEXT\n);\n\n"
         "CREATE TABLE u (\n  tid INTEGER PRIMARY KEY,\n  k2 TEXT PRIMARY KEY,\n"
         "  FOREIGN KEY (tid) REFERENCES t(name)\n);")


def _catalog(spark):
    return spark.createDataFrame(ROWS, schemas.CATALOG)


def test_schema_ddl(spark):
    got = {(r["db_id"], r["pos"]): r["schema"] for r in cat.schema_ddl(_catalog(spark)).collect()}
    assert got[("a", 0)] == DDL_A
    assert got[("b", 1)] == "CREATE TABLE x (\n  c TEXT\n);"
    assert got[("b", 2)] == "CREATE TABLE y (\n  d INTEGER PRIMARY KEY\n);"


def test_schema_lookup_last_wins(spark):
    got = {r["db_id"]: r["schema"] for r in cat.schema_lookup(cat.schema_ddl(_catalog(spark))).collect()}
    assert got["b"] == "CREATE TABLE y (\n  d INTEGER PRIMARY KEY\n);"


def test_columns_and_keys(spark):
    cols = cat.catalog_columns(_catalog(spark)).where("db_id = 'a'").orderBy("col_idx").collect()
    assert [c["column_name"] for c in cols] == ["id", "name", "tid", "k2"]
    assert [c["sql_type"] for c in cols] == ["INTEGER", "TEXT", "INTEGER", "TEXT"]
    pks = cat.catalog_primary_keys(_catalog(spark)).where("db_id = 'a'").orderBy("col_idx").collect()
    assert [p["column_name"] for p in pks] == ["id", "tid", "k2"]
    fks = cat.catalog_foreign_keys(_catalog(spark)).where("db_id = 'a'").collect()
    assert [(f["child_column"], f["ref_table"], f["ref_column"]) for f in fks] == [("tid", "t", "name")]
