"""Inputs derived from the driver tables (``/root/testdata/sf*/``).

The tables hold no SQL text, catalogs or model responses, so those are derived
by deterministic expressions; ``oracles.py`` repeats each derivation in DuckDB
SQL. Every derivation reads whole tables, so work grows with the scale factor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusql.operators import catalog as cat
from corpusql.operators import corpus
from corpusql.session import stored

# Fixture constants (shared with the DuckDB oracle; not reference values).
GOLD_TEMPLATES = (
    "SELECT count(*) FROM lineitem WHERE l_quantity > 45",
    "SELECT c_name ,  c_acctbal FROM customer WHERE c_nationkey = 3 ORDER BY c_acctbal DESC LIMIT 3",
    "SELECT n_name, count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name HAVING count(*) > 50",
    "SELECT p_name FROM part WHERE p_name LIKE '%gear%' AND p_size = 7",
    "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders) AND o_custkey = 7",
    "SELECT s_name FROM supplier WHERE s_nationkey = 5 UNION SELECT c_name FROM customer WHERE c_nationkey = 5",
    "SELECT r_name ,  max(n_nationkey) FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "SELECT DISTINCT l_returnflag FROM lineitem WHERE l_discount  >  0.05",
)
RAW_TYPES = ("text", "number", "time", "boolean", "others", "blob")
TPCH_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
VAL_RATIO = 0.1
SEED = 42
FEW_SHOT_K = 3
TOKEN_TEMPLATE = [614, 884]   # tokens of "of the" (see token_features)
BATCH_SIZE = 8
ARRAY_RECORDS = 5000          # records of an array file
MAX_SEQ = 48


# Gold/predicted pairs for the execution operators (fixture values): result
# equal, different, order-insensitive, multiplicity, column order, both empty,
# one empty, failing prediction, non-query text, missing database, NULL vs 'None',
# 1 vs 1.0.
EXECUTION_PAIRS = (
    (1, "src0", "SELECT count(*) FROM orders", "SELECT COUNT(*) FROM orders"),
    (2, "src0", "SELECT c_mktsegment, count(*) FROM customer GROUP BY c_mktsegment",
     "SELECT c_mktsegment, count(c_custkey) FROM customer GROUP BY 1"),
    (3, "src1", "SELECT n_name FROM nation WHERE n_regionkey = 1",
     "SELECT n_name FROM nation WHERE n_regionkey = 2"),
    (4, "src1", "SELECT r_name FROM region ORDER BY r_name", "SELECT r_name FROM region ORDER BY r_name DESC"),
    (5, "src2", "SELECT o_orderstatus FROM orders", "SELECT DISTINCT o_orderstatus FROM orders"),
    (6, "src2", "SELECT l_returnflag, l_linestatus FROM lineitem WHERE l_quantity > 49",
     "SELECT l_linestatus, l_returnflag FROM lineitem WHERE l_quantity > 49"),
    (7, "src4", "SELECT p_name FROM part WHERE p_size > 1000", "SELECT p_name FROM part WHERE p_size < 0"),
    (8, "src4", "SELECT p_name FROM part WHERE p_size > 1000", "SELECT p_name FROM part WHERE p_size = 1"),
    (9, "src5", "SELECT s_name FROM supplier", "SELECT s_nme FROM supplier"),
    (10, "src5", "SELECT count(*) FROM lineitem", "SELECT count(*) FROM lineitems"),
    (11, "src6", "SELECT c_name FROM customer WHERE c_acctbal > 9000",
     "SELECT c.c_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE c.c_acctbal > 9000"),
    (12, "src6", "SELECT o_orderpriority, count(*) FROM orders GROUP BY o_orderpriority",
     "SELECT o_orderpriority, count(*) FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority"),
    (13, "src8", "SELECT max(l_linenumber) FROM lineitem", "SELECT max(l_linenumber) FROM lineitem;"),
    (14, "src8", "SELECT c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
     "SELECT DISTINCT c_name FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 400000"),
    (15, "src9", "SELECT count(*) FROM nation", "DELETE FROM nation"),
    (16, "src3", "SELECT count(*) FROM region", "SELECT count(*) FROM region"),
    (17, "src9", "SELECT l_orderkey FROM lineitem WHERE l_quantity > 49 INTERSECT SELECT o_orderkey FROM orders",
     "SELECT DISTINCT l_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 49"),
    (18, "src10", "SELECT CAST(NULL AS STRING) AS x", "SELECT 'None' AS x"),
    (19, "src10", "SELECT 1 AS x", "SELECT 1.0 AS x"),
    (20, "src11", "SELECT l_linenumber FROM lineitem WHERE l_orderkey = 1",
     "SELECT l_linenumber FROM lineitem WHERE l_orderkey = 1 UNION ALL SELECT l_linenumber FROM lineitem WHERE l_orderkey = 1"),
    (21, "src12", "SELECT sum(l_linenumber) FROM lineitem", "SELECT sum(l_linenumber) AS s FROM lineitem WHERE l_linenumber > 0"),
    (22, "src12", "SELECT min(c_acctbal), avg(c_custkey) FROM customer",
     "SELECT min(c_acctbal), avg(c_custkey) FROM customer WHERE c_nationkey >= 0"),
    (23, "src14", "SELECT c_nationkey, count(*) FROM customer GROUP BY c_nationkey HAVING count(*) > 60",
     "SELECT c_nationkey, count(*) FROM customer GROUP BY c_nationkey HAVING count(*) >= 61"),
    (24, "src14", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)",
     "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT max(o_totalprice) FROM orders)"),
    (25, "src15", "SELECT n_name FROM nation UNION SELECT r_name FROM region", "SELECT r_name FROM region UNION SELECT n_name FROM nation"),
    (26, "src15", "SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier",
     "SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier)"),
    (27, "src16", "SELECT p_name FROM part WHERE p_name LIKE '%ar%'", "SELECT p_name FROM part WHERE p_name LIKE '%ar'"),
    (28, "src16", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5",
     "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 6"),
    (29, "src18", "SELECT r_name, count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey "
     "JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
     "SELECT r_name, count(l_orderkey) FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey "
     "JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY r_name"),
    (30, "src18", "SELECT n_name FROM nation", "nation"),
    (31, "src19", "SELECT 1 AS a", "SELECT 1 AS a) UNION ALL (SELECT 2"),
    (32, "src19", "SELECT count(*) FROM nation", "SELECT reflect('java.lang.System', 'currentTimeMillis')"),
    (33, "src0", "SELECT 1 AS a", "SELECT count(*) FROM parquet.`/tmp`"),
)


def execution_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(EXECUTION_PAIRS), "example_id bigint, db_id string, gold_sql string, pred_sql string")


def example_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs above and one per document (``example_id = 100 + doc_id``): its gold text and the predicted one."""
    d = table(spark, sf_dir, "documents")
    return execution_pairs(spark, sf_dir).unionByName(d.select(
        (F.col("doc_id") + 100).alias("example_id"), F.col("source").alias("db_id"), gold_sql().alias("gold_sql"),
        perturbed_sql().alias("pred_sql")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pick(arr_values, idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in arr_values]), (idx + 1).cast("int"))


def mixed_key() -> Column:
    """``doc_id + doc_id div 10``: the held-out documents (ids divisible by 10) take every template, variant
    and response shape."""
    return F.col("doc_id") + F.expr("doc_id div 10")


def gold_sql() -> Column:
    return _pick(GOLD_TEMPLATES, F.pmod(mixed_key(), F.lit(len(GOLD_TEMPLATES))))


def raw_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(db_id, question, query, pos)``: one example per document, db = source."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("db_id"), F.col("text").alias("question"),
                    gold_sql().alias("query"), F.col("doc_id").alias("pos"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One catalog entry per document (db_id = source; sources ending in 7 have
    none, so their examples are orphans; every other id repeats, last wins)."""
    d = table(spark, sf_dir, "documents").where(~F.col("source").like("%7"))
    t = 1 + F.pmod("doc_id", F.lit(3))
    k = 1 + F.pmod("n_chars", F.lit(6))
    tables = F.transform(F.sequence(F.lit(0), (t - 1).cast("int")),
                         lambda i: F.concat(F.col("lang"), F.lit("_t"), i.cast("string")))
    cols = F.concat(F.array(F.array(F.lit("-1"), F.lit("*"))),
                    F.transform(F.sequence(F.lit(0), (k - 1).cast("int")),
                                lambda j: F.array(F.pmod(j, t).cast("string"), F.concat(F.lit("c"), j.cast("string")))))
    types = F.concat(F.array(F.lit("text")),
                     F.transform(F.sequence(F.lit(0), (k - 1).cast("int")),
                                 lambda j: _pick(RAW_TYPES, F.pmod(F.col("doc_id") + j, F.lit(6)))))
    pk = (F.when(F.pmod("doc_id", F.lit(11)) == 0, F.lit(None))
          .when((F.pmod("doc_id", F.lit(5)) == 0) & (k >= 2), F.array(F.lit(1), F.lit(2)))
          .otherwise(F.array(F.lit(1))))
    ki = k.cast("int")
    fk = F.when(F.pmod("doc_id", F.lit(11)) == 0, F.lit(None)).otherwise(F.filter(F.array(
        F.when(k >= 2, F.array(ki, F.lit(1))),
        F.when((k >= 3) & (F.pmod("doc_id", F.lit(7)) == 0), F.array(ki, F.lit(2))),
        F.when((k >= 2) & (F.pmod("doc_id", F.lit(13)) == 0), F.array(F.lit(2), F.lit(0)))),
        lambda x: x.isNotNull()))
    return d.select(F.col("source").alias("db_id"), tables.alias("table_names_original"),
                    cols.alias("column_names_original"), types.alias("column_types"),
                    pk.cast("array<string>").alias("primary_keys"),
                    fk.cast("array<array<int>>").alias("foreign_keys"),
                    F.col("doc_id").alias("pos"))


def schema_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(cat.schema_lookup(cat.schema_ddl(catalog(spark, sf_dir))), "schema-lookup")


def instruction_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.convert_examples(raw_examples(spark, sf_dir), schema_lookup(spark, sf_dir))


def split_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training file (doc_id % 10 != 0) split by database into train/val; the
    held-out file (doc_id % 10 == 0) is 'dev' and never split."""
    ex = instruction_examples(spark, sf_dir)
    train_file = ex.where(F.pmod("pos", F.lit(10)) != 0)
    dev = ex.where(F.pmod("pos", F.lit(10)) == 0).withColumn("split", F.lit("dev"))
    return corpus.split_by_database(train_file, VAL_RATIO, SEED).unionByName(dev)


def test_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out rows with ``index = pos div 10`` (their position in the test file)."""
    ex = instruction_examples(spark, sf_dir).where(F.pmod("pos", F.lit(10)) == 0)
    return ex.withColumn("index", F.floor(F.col("pos") / 10).cast("bigint"))


def train_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_examples(spark, sf_dir).where(F.col("split") == "train")


def predicted_text(gold: str, variant: int) -> str:
    """Predicted SQL variants: same, upper-cased, doubled spaces, comments + ';',
    re-spaced commas, unknown column, other tables, other aggregate, no SQL, same result by another text."""
    if variant == 7:
        for a, b in (("count(*)", "max(1)"), ("max(", "min("), ("avg(", "max(")):
            if a in gold:
                return gold.replace(a, b)
        return gold
    return (gold, gold.upper(), gold.replace(" ", "  "), "SELECT /* pick */ " + gold.removeprefix("SELECT ") + " -- generated\n;",
            gold.replace(" ,  ", ", "), gold.replace("SELECT ", "SELECT no_such_column, ", 1),
            "SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey", "",
            "SELEC " + gold.removeprefix("SELECT "), f"SELECT * FROM ({gold}) AS q")[variant]


N_VARIANTS = 10
PREDICTED = tuple(predicted_text(g, v) for g in GOLD_TEMPLATES for v in range(N_VARIANTS))


def perturbed_sql() -> Column:
    t, v = F.pmod(mixed_key(), F.lit(len(GOLD_TEMPLATES))), F.pmod(mixed_key(), F.lit(N_VARIANTS))
    return _pick(PREDICTED, t * N_VARIANTS + v)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(mode, index, response, generation_time_s, pos)`` wrapping a perturbed
    prediction in six response shapes."""
    d = table(spark, sf_dir, "documents")
    pred = perturbed_sql()
    w = F.pmod(mixed_key(), F.lit(6))
    resp = (F.when(w == 0, F.concat(F.lit("```sql\n"), pred, F.lit("\n```")))
            .when(w == 1, F.concat(F.lit("Here is the query:\n```\n"), pred, F.lit("\n```\nIt answers the question.")))
            .when(w == 2, F.concat(pred, F.lit(";\n\nThis query "), F.col("text")))
            .when(w == 3, F.concat(F.lit("Answer for "), F.col("source"), F.lit(":\n"), pred))
            .when(w == 4, F.concat(F.lit("```sqlite\n"), pred, F.lit("\n```")))
            .otherwise(F.concat(F.lit("The query is "), pred)))
    return d.select(F.lit("zero-shot").alias("mode"), F.col("doc_id").alias("index"),
                    resp.alias("response"),
                    (F.pmod("n_chars", F.lit(900)).cast("double") / 100.0).alias("generation_time_s"),
                    F.col("doc_id").alias("pos"))


def sql_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("pos"), gold_sql().alias("gold_sql"),
                    perturbed_sql().alias("pred_sql"))


def predictions_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction records from ``events``: mode = event_type, dense per-mode index."""
    from corpusql.operators.positions import dense_positions
    e = table(spark, sf_dir, "events")
    g = dense_positions(e.select("event_id", "event_type", "user_id", "value", "props", "ts"),
                        ["event_type", "event_id"], name="_g")
    starts = g.groupBy("event_type").agg(F.min("_g").alias("_s"))
    g = g.join(F.broadcast(starts), "event_type")   # one row per event type
    return g.select(
        F.col("event_type").alias("mode"), (F.col("_g") - F.col("_s")).alias("index"),
        F.col("event_id"), F.col("ts"),
        F.col("user_id").cast("string").alias("db_id"), F.col("props").alias("question"),
        F.lit("").alias("gold_sql"), F.lit("").alias("pred_sql"),
        (F.col("value") > 60).alias("exact_match"), (F.col("value") > 25).alias("exec_match"),
        F.when(F.col("value") < 2, F.concat(F.lit("invalid: "), F.col("event_type"))).alias("pred_error"),
        F.col("value").alias("generation_time_s"),
        (F.pmod("user_id", F.lit(50)) != 0).alias("db_found"))


def result_rows(spark: SparkSession, sf_dir: str):
    """Gold/pred result rows per order (example_id = o_orderkey) and their status."""
    li = table(spark, sf_dir, "lineitem")
    ok = F.col("l_orderkey")
    ln = F.col("l_linenumber").cast("string")
    # whole rows; doubles by their bits' text in no engine's format: as exact decimals
    money = [F.col(c).cast("decimal(18,4)").cast("string") for c in
             ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    rest = [F.col(c).cast("string") for c in ("l_partkey", "l_suppkey")] + money + [F.col("l_linestatus"), F.date_format("l_shipdate", "yyyy-MM-dd")]
    gold = li.select(ok.alias("pair_id"), F.lit("gold").alias("side"),
                     F.array(ln, *rest, F.col("l_returnflag")).alias("row"))
    base = li.where(~((F.pmod(ok, F.lit(7)) == 0) & (F.col("l_linenumber") == 1))
                    & (F.pmod(ok, F.lit(19)) != 0))
    row = (F.when(F.pmod(ok, F.lit(13)) == 0, F.array(F.col("l_returnflag"), ln, *rest))
           .when(F.pmod(ok, F.lit(5)) == 0, F.array(ln, *rest, F.lower("l_returnflag")))
           .otherwise(F.array(ln, *rest, F.col("l_returnflag"))))
    pred = base.select(ok.alias("pair_id"), F.lit("pred").alias("side"), row.alias("row"))
    dup = li.where((F.pmod(ok, F.lit(11)) == 0) & (F.col("l_linenumber") == 1)
                   & (F.pmod(ok, F.lit(19)) != 0)) \
        .select(ok.alias("pair_id"), F.lit("pred").alias("side"), row.alias("row"))
    rows = gold.unionByName(pred).unionByName(dup)
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pair_id"))
    status = (o.select("pair_id", F.lit("gold").alias("side"), F.lit(None).cast("string").alias("error"))
              .unionByName(o.select("pair_id", F.lit("pred").alias("side"),
                                    F.when(F.pmod("pair_id", F.lit(17)) == 0, F.lit("runtime error"))
                                    .alias("error"))))
    return rows, status


def token_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One token per word of the whole text, ``code point of its first letter + 256 * length``;
    some rows lack mask/labels."""
    d = table(spark, sf_dir, "documents")
    ids = F.transform(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)),
                      lambda w: F.ascii(w) + 256 * F.length(w))
    return (d.select(F.col("doc_id").alias("pos"), ids.cast("array<int>").alias("input_ids"))
            .withColumn("attention_mask", F.when(F.pmod("pos", F.lit(3)) == 0, F.lit(None))
                        .otherwise(F.array_repeat(F.lit(1), F.size("input_ids"))).cast("array<int>"))
            .withColumn("labels", F.when(F.pmod("pos", F.lit(4)) == 0, F.lit(None))
                        .otherwise(F.col("input_ids")).cast("array<int>")))


def registry(spark: SparkSession, sf_dir: str) -> dict[str, dict[str, str]]:
    """Database locations: every document source resolves to the TPC-H-like
    tables, except sources ending in 3 (missing databases). One entry per
    distinct source, i.e. per database."""
    paths = {t: f"{sf_dir.rstrip('/')}/{t}.parquet" for t in TPCH_TABLES}
    srcs = [r[0] for r in table(spark, sf_dir, "documents").select("source").distinct()
            .where(~F.col("source").like("%3")).collect()]
    return {s: dict(paths) for s in sorted(srcs)}


def registry_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same locations as ``(db_id, table_name, path)`` rows."""
    places = F.array(*[F.struct(F.lit(t).alias("table_name"), F.lit(f"{sf_dir.rstrip('/')}/{t}.parquet").alias("path"))
                       for t in TPCH_TABLES])
    known = table(spark, sf_dir, "documents").select(F.col("source").alias("db_id")).distinct().where(~F.col("db_id").like("%3"))
    return known.select("db_id", F.inline(places))
