"""Sources: catalog, raw examples, instruction sets.

Records come from JSON arrays, JSON Lines or Parquet. All three are read by several tasks a
file: an array is cut into byte ranges (``sources/json_array.py``). A folder holds files of one kind; one
of another kind raises. Records without a position column get ``pos`` from the file
name and row order (see ``with_file_pos``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusql.session import stored
from corpusql.sources import schemas
from corpusql.sources.json_array import read_array

#: One row of 24 bytes per file split: up to so many splits their offsets are broadcast.
BROADCAST_SPLITS = 1_000_000


def _is_json_array(spark: SparkSession, path: str) -> bool:
    head = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    return bool(head) and head[0][0].lstrip("\ufeff \t").startswith("[")


def read_records(spark: SparkSession, path: str, schema, fmt: str | None = None, required: tuple = ()) -> DataFrame:
    """Read JSON (array or lines) or Parquet with a fixed schema.

    A missing path raises ``AnalysisException`` (PATH_NOT_FOUND), a malformed record fails
    the read, and so does a record without one of ``required``. The records of arrays have their ``pos``.
    """
    fmt = fmt or ("parquet" if path.rstrip("/").endswith(".parquet") else "json")
    if fmt == "parquet":
        return _with_required(spark.read.schema(schema).parquet(path), required)
    if _is_json_array(spark, path):
        return _with_required(_array_records(spark, path, schema), required)
    return _with_required(spark.read.schema(schema).option("mode", "FAILFAST").json(path), required)


def _array_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parsed records of array files; ``pos`` is the place in the files unless all records carry one."""
    found = read_array(spark, path)
    parsed = found.select(F.col("pos").alias("_at"), F.from_json("record", schema, {"mode": "FAILFAST"}).alias("r"))
    flat = parsed.select("_at", "r.*")
    if "pos" not in schema.names:
        return flat.drop("_at")
    flat = stored(flat, "array-records")
    own = flat.agg(F.bool_and(F.col("pos").isNotNull()).alias("own")).first()["own"]
    return flat.withColumn("pos", F.col("pos" if own else "_at")).select(*schema.names)


def _with_required(df: DataFrame, names: tuple) -> DataFrame:
    """Raises for a record without a value in ``names`` when that value is read."""
    return df.withColumns({n: F.coalesce(F.col(n), F.raise_error(F.lit(f"a record has no {n}")).cast(df.schema[n].dataType))
                           for n in names})


def with_file_pos(df: DataFrame) -> DataFrame:
    """``pos`` of records that lack one: the record's place in (file path, position in the file)
    order, dense from 0. If all records carry ``pos`` it is kept; if only some do, all are numbered
    anew, so no two share a number.

    Records do not move: a first pass counts each file split's rows, the counts give each split its
    first number, and a row adds its offset within the split to that. Both passes read the
    same splits; if Spark has cut or packed them otherwise in between, the second raises.
    """
    split = [F.xxhash64(F.input_file_name()).alias("_file"), F.input_file_block_start().alias("_start")]
    row = F.monotonically_increasing_id()
    placed = df.select(*split, F.input_file_name().alias("_path"), row.alias("_row"), F.col("pos").isNull().alias("_none"))
    counts = stored(placed.groupBy("_path", "_file", "_start").agg(
        F.count("*").alias("_n"), F.count_if("_none").alias("_without"), F.min("_row").alias("_least")), "file-splits")
    totals = counts.agg(F.sum("_without").alias("without"), F.count("*").alias("splits")).first()
    if not totals["without"]:
        return df
    # one row per file split, in one task
    first = F.coalesce(F.sum("_n").over(Window.orderBy("_path", "_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = stored(counts.select("_file", "_start", "_least", "_n", first.alias("_first")), "file-offsets")
    if totals["splits"] <= BROADCAST_SPLITS:
        starts = F.broadcast(starts)
    numbered = df.select("*", *split, row.alias("_row")).join(starts, ["_file", "_start"], "left")
    nth = F.col("_row") - F.col("_least")
    moved = F.raise_error(F.lit("the files were cut otherwise when their rows were counted")).cast("bigint")
    return numbered.withColumn("pos", F.when((nth >= 0) & (nth < F.col("_n")), F.col("_first") + nth).otherwise(moved)).select(*df.columns)


def scan_catalog(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    return with_file_pos(read_records(spark, path, schemas.CATALOG, fmt, ("db_id", "table_names_original")))


def scan_examples(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    return with_file_pos(read_records(spark, path, schemas.RAW_EXAMPLE, fmt, ("db_id", "query")))


def scan_instructions(spark: SparkSession, paths: dict[str, str], fmt: str | None = None) -> DataFrame:
    """Several instruction files -> one DataFrame with a ``split`` column."""
    out = None
    for split, path in paths.items():
        df = with_file_pos(read_records(spark, path, schemas.INSTRUCTION, fmt))
        df = df.withColumn("split", F.lit(split))
        out = df if out is None else out.unionByName(df)
    return out


def scan_split_directory(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read a ``partitionBy("split")`` output back (partition pruning on ``split``)."""
    schema = T.StructType(schemas.INSTRUCTION.fields + [T.StructField("split", T.StringType())])
    return spark.read.schema(schema).format(fmt).load(path)
