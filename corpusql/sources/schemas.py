"""Record layouts (Spark DDL)."""

from pyspark.sql import types as T

CATALOG = T.StructType([
    T.StructField("db_id", T.StringType()),
    T.StructField("table_names_original", T.ArrayType(T.StringType())),
    # inner pair is [table_idx, name]; table_idx -1 marks the '*' pseudo-column
    T.StructField("column_names_original", T.ArrayType(T.ArrayType(T.StringType()))),
    T.StructField("column_types", T.ArrayType(T.StringType())),
    # read as strings so a nested (composite) entry does not null the whole field
    T.StructField("primary_keys", T.ArrayType(T.StringType())),
    T.StructField("foreign_keys", T.ArrayType(T.ArrayType(T.IntegerType()))),
    T.StructField("pos", T.LongType()),
])

RAW_EXAMPLE = T.StructType([
    T.StructField("db_id", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("query", T.StringType()),
    T.StructField("pos", T.LongType()),
])

INSTRUCTION = T.StructType([
    T.StructField("instruction", T.StringType()),
    T.StructField("schema", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("output", T.StringType()),
    T.StructField("db_id", T.StringType()),
    T.StructField("pos", T.LongType()),
])

PREDICTION = T.StructType([
    T.StructField("mode", T.StringType()),
    T.StructField("index", T.LongType()),
    T.StructField("db_id", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("gold_sql", T.StringType()),
    T.StructField("pred_sql", T.StringType()),
    T.StructField("exact_match", T.BooleanType()),
    T.StructField("exec_match", T.BooleanType()),
    T.StructField("pred_error", T.StringType()),
    T.StructField("generation_time_s", T.DoubleType()),
    T.StructField("db_found", T.BooleanType()),
])
