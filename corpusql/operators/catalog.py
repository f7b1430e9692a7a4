"""Schema catalog -> per-column rows, keys, and ``CREATE TABLE`` text.

A catalog entry (one database) is a row of parallel arrays. Everything except
the last-entry-wins lookup is computed inside the row with higher-order array
functions: narrow, no shuffle, whatever the number of databases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Catalog column type -> SQL type; anything else maps to TEXT.
TYPE_MAP = {"text": "TEXT", "number": "INTEGER", "time": "TEXT", "boolean": "INTEGER", "others": "TEXT"}
DEFAULT_SQL_TYPE = "TEXT"
# ---------------------------------------------------------------------------

def sql_type(raw) -> Column:
    type_map = F.create_map(*[F.lit(x) for kv in TYPE_MAP.items() for x in kv])
    return F.coalesce(F.try_element_at(type_map, raw), F.lit(DEFAULT_SQL_TYPE))


def _at(arr, i0) -> Column:
    """0-based, null when out of range."""
    return F.try_element_at(arr, i0 + 1)


def primary_key_ints(df: DataFrame) -> Column:
    """``primary_keys`` as ``array<int>``; NULL -> empty.

    Read as ``array<string>``, a nested (composite) entry arrives as the text
    ``[a,b]`` and is flattened into its members.
    """
    dt = df.schema["primary_keys"].dataType
    pk = F.col("primary_keys")
    if isinstance(dt, T.ArrayType) and isinstance(dt.elementType, T.StringType):
        pk = F.flatten(F.transform(pk, lambda x: F.when(
            F.trim(x).startswith("["), F.from_json(x, T.ArrayType(T.IntegerType())))
            .otherwise(F.array(x.try_cast("int")))))
    return F.coalesce(pk.cast("array<int>"), F.array().cast("array<int>"))


def _columns(df: DataFrame) -> Column:
    """``array<struct<idx, t, name, raw_type>>`` of real columns (no '*',
    table index within the table list)."""
    names = F.col("column_names_original")
    tables = F.col("table_names_original")
    types = F.col("column_types")
    cols = F.transform(names, lambda c, i: F.struct(
        i.alias("idx"),
        _at(c, F.lit(0)).try_cast("int").alias("t"),
        _at(c, F.lit(1)).alias("name"),
        _at(types, i).alias("raw_type"),
    ))
    return F.filter(cols, lambda c: (c["t"] >= 0) & (c["t"] < F.size(tables)))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once: inside a lambda an expression would be
    evaluated again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _foreign_keys() -> Column:
    """``array<struct<child, nth, parent, child_table, child_column, ref_table, ref_column>>``
    of the pairs whose child and parent are real columns (not '*'); of several pairs for a child
    the last. One pass over the pairs and one sort."""
    names = F.col("column_names_original")
    tables = F.col("table_names_original")
    pairs = F.coalesce(F.col("foreign_keys"), F.array().cast("array<array<int>>"))

    def table_of(idx):
        t = _at(_at(names, idx), F.lit(0)).try_cast("int")
        return F.when((idx >= 0) & (t >= 0), _at(tables, t))

    resolved = F.transform(pairs, lambda f, n: F.struct(
        _at(f, F.lit(0)).alias("child"), n.alias("nth"), _at(f, F.lit(1)).alias("parent"),
        table_of(_at(f, F.lit(0))).alias("child_table"), _at(_at(names, _at(f, F.lit(0))), F.lit(1)).alias("child_column"),
        table_of(_at(f, F.lit(1))).alias("ref_table"), _at(_at(names, _at(f, F.lit(1))), F.lit(1)).alias("ref_column")))
    real = F.array_sort(F.filter(resolved, lambda f: f["child_table"].isNotNull() & f["ref_table"].isNotNull()))
    return let(real, lambda all_: F.filter(all_, lambda f, i: ~F.get(all_, i + 1)["child"].eqNullSafe(f["child"])))


def schema_ddl(catalog: DataFrame) -> DataFrame:
    """``(db_id, pos, schema)``: one ``CREATE TABLE`` block per table with columns,
    column lines in index order then FK lines in column order; tables joined by a
    blank line."""
    def lines(cols, fks, pk):
        keyed = F.map_from_entries(F.transform(fks, lambda f: F.struct(f["child"], f)))
        return let(keyed, lambda of: F.transform(cols, lambda c: F.struct(
            c["t"].alias("t"),
            F.concat(F.lit("  "), c["name"], F.lit(" "), sql_type(c["raw_type"]),
                     F.when(F.array_contains(pk, c["idx"]), F.lit(" PRIMARY KEY")).otherwise(F.lit(""))).alias("line"),
            let(F.try_element_at(of, c["idx"]), lambda f: F.concat(
                F.lit("  FOREIGN KEY ("), c["name"], F.lit(") REFERENCES "), f["ref_table"], F.lit("("), f["ref_column"],
                F.lit(")"))).alias("fk"))))

    def block(mine, tname):
        fk_lines = F.filter(F.transform(mine, lambda c: c["fk"]), lambda x: x.isNotNull())
        body = F.array_join(F.concat(F.transform(mine, lambda c: c["line"]), fk_lines), ",\n")
        return F.when(F.size(mine) > 0, F.concat(F.lit("CREATE TABLE "), tname, F.lit(" (\n"), body, F.lit("\n);")))

    def blocks(rows):
        return F.filter(F.transform("table_names_original", lambda tname, ti: let(
            F.filter(rows, lambda c: c["t"] == ti), lambda mine: block(mine, tname))), lambda b: b.isNotNull())

    schema = let(_foreign_keys(), lambda fks: let(primary_key_ints(catalog), lambda pk: let(
        lines(_columns(catalog), fks, pk), lambda rows: F.array_join(blocks(rows), "\n\n"))))
    return catalog.select("db_id", "pos", schema.alias("schema"))


def schema_lookup(ddl: DataFrame) -> DataFrame:
    """``(db_id, schema)``; a duplicated ``db_id`` keeps its last entry (max ``pos``).
    ``max_by`` aggregates partially before the shuffle, so a hot id costs nothing."""
    return ddl.groupBy("db_id").agg(F.max_by("schema", "pos").alias("schema"))


def catalog_columns(catalog: DataFrame) -> DataFrame:
    """One row per real column: table, name, raw and SQL type, primary-key flag."""
    pk = primary_key_ints(catalog)
    return (catalog
            .withColumn("_pk", pk)
            .select("db_id", "pos", "table_names_original", "_pk",
                    F.inline(_columns(catalog)))
            .select("db_id", "pos",
                    F.col("idx").alias("col_idx"),
                    F.col("t").alias("table_idx"),
                    _at(F.col("table_names_original"), F.col("t")).alias("table_name"),
                    F.col("name").alias("column_name"),
                    F.col("raw_type").alias("column_type"),
                    sql_type(F.col("raw_type")).alias("sql_type"),
                    F.array_contains("_pk", F.col("idx")).alias("is_primary_key")))


def catalog_primary_keys(catalog: DataFrame) -> DataFrame:
    return (catalog_columns(catalog).where("is_primary_key")
            .select("db_id", "pos", "col_idx", "table_name", "column_name"))


def catalog_foreign_keys(catalog: DataFrame) -> DataFrame:
    """Resolved FK edges ``(child table, column) -> (parent table, column)``; last pair
    per child wins; edges to '*' dropped."""
    return (catalog.select("db_id", "pos", F.explode(_foreign_keys()).alias("fk"))
            .select("db_id", "pos", F.col("fk.child").alias("child_idx"), "fk.child_table", "fk.child_column",
                    F.col("fk.parent").alias("parent_idx"), "fk.ref_table", "fk.ref_column"))
