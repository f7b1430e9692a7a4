"""Execution match: run query texts on Spark tables, compare result multisets.

Only query *planning* happens on the driver. Every distinct (database, text) is parsed and
analyzed by itself, so parse and analysis errors are known at once; the texts that pass are run
together, ``fused`` of one database as one plan (a union of each text's counted rows, marked by query id),
so jobs fall by that factor. Results never come back to the driver: a batch is
written as ``(query_id, row array<string>, n)`` under the shared folder, and the batches that succeeded are
read back as one distributed table.

Every job has a time limit. A watchdog cancels the jobs of a batch by their tag when the limit
is over, again and again until the batch has ended, so stages that start later are met too. A batch that
fails or is late is cut in halves until the one text to blame is alone; that text gets the
error, the others their results. So an endless text costs a few limits, not a thread.

A text must be one query: it is parsed bare, so a table name or unbalanced
parentheses are errors. Child sessions cannot read files by path nor call JVM methods.
Parse, analysis and query runtime errors and the time limit are the query's own and become its
error text; anything else (a lost cluster, a full disk) raises.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import groupby, islice

from pyspark.errors import (AnalysisException, ArithmeticException, ArrayIndexOutOfBoundsException,
                            DateTimeException, NumberFormatException, ParseException, SparkRuntimeException)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusql.functions.sqltext import execution_text
from corpusql.session import scratch_path, stored
from corpusql.sources.registry import DatabaseSessions

QUERY_ERRORS = (ParseException, AnalysisException, ArithmeticException, ArrayIndexOutOfBoundsException,
                DateTimeException, NumberFormatException, SparkRuntimeException)
ROWS = "query_id string, row array<string>, n bigint"
TIME_LIMIT_S = 120.0
FUSED = 32
#: Errors that the driver holds before it writes them.
ERRORS_HELD = 1000


def _error_text(e: Exception) -> str:
    msg = str(e).strip()
    return msg.splitlines()[0] if msg else type(e).__name__


class _Watch:
    """Cancels the jobs that the current thread starts within ``with`` once ``limit_s`` is over."""

    def __init__(self, spark: SparkSession, limit_s: float):
        self.sc, self.limit_s = spark.sparkContext, limit_s
        self.tag, self.late, self._done = f"corpusql-{uuid.uuid4().hex}", False, threading.Event()

    def _watch(self) -> None:
        end = time.monotonic() + self.limit_s
        while not self._done.wait(min(0.5, max(0.01, end - time.monotonic()))):
            if time.monotonic() >= end:
                self.late = True
                self.sc.cancelJobsWithTag(self.tag)

    def __enter__(self) -> _Watch:
        self.sc.addJobTag(self.tag)
        self._thread = threading.Thread(target=self._watch, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, *_) -> None:
        self._done.set()
        self._thread.join()
        self.sc.removeJobTag(self.tag)


def stringify_rows(df: DataFrame) -> DataFrame:
    """Every value through ``string``, NULL as the text ``None``; columns by position."""
    df = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return df.select(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in df.columns]).alias("row"))


def with_query_ids(queries: DataFrame, sessions: DatabaseSessions, **texts: str) -> DataFrame:
    """Adds ``phys`` (the physical database, NULL when missing) and for each
    ``name="text column"`` the query's execution text ``name_sql`` and id ``name``."""
    found = queries.join(sessions.physical(), "db_id", "left")
    place = F.coalesce("phys", F.concat(F.lit("missing:"), F.coalesce("db_id", F.lit(""))))
    for name, text in texts.items():
        found = found.withColumn(f"{name}_sql", execution_text(text))
        found = found.withColumn(name, F.sha2(F.concat(place, F.lit("\u0000"), F.col(f"{name}_sql")).cast("binary"), 256))
    return found


def _batches(numbered: DataFrame, fused: int) -> Iterator[tuple[str, list[tuple[str, str]]]]:
    """``(database, [(query id, text)])`` of at most ``fused`` texts; the driver holds one batch."""
    rows = numbered.where("phys IS NOT NULL").orderBy("phys", "query_id").toLocalIterator()
    for phys, own in groupby(rows, key=lambda r: r["phys"]):
        while some := [(r["query_id"], r["exec_sql"]) for r in islice(own, fused)]:
            yield phys, some


def _run_fused(session: SparkSession, texts: list[tuple[str, DataFrame]], out: str, limit_s: float,
               done: list[str], errors: list[tuple[str, str]]) -> None:
    """Runs the analyzed ``texts`` as one job; on failure or delay each half by itself."""
    path = f"{out}/{uuid.uuid4().hex}"
    marked = [stringify_rows(df).select(F.lit(q).alias("query_id"), "row") for q, df in texts]
    watch = _Watch(session, limit_s)
    try:
        with watch:
            reduce(DataFrame.union, marked).groupBy("query_id", "row").agg(F.count("*").alias("n")).write.parquet(path)
    except Exception as e:
        if not watch.late and not isinstance(e, QUERY_ERRORS):
            raise
        if len(texts) == 1:
            errors.append((texts[0][0], f"timed out after {limit_s:g} s" if watch.late else _error_text(e)))
            return
        half = len(texts) // 2
        for part in (texts[:half], texts[half:]):
            _run_fused(session, part, out, limit_s, done, errors)
    else:
        done.append(path)


def execute_queries(spark: SparkSession, queries: DataFrame, sessions: DatabaseSessions, max_workers: int = 8,
                    time_limit_s: float = TIME_LIMIT_S, fused: int = FUSED) -> tuple[DataFrame, DataFrame]:
    """``queries(db_id, sql)`` -> ``(rows(query_id, row, n), status(query_id, db_id,
    exec_sql, error, n_rows))``; each different text runs once per physical database;
    n is how often a row occurs; n_rows is -1 on error. A text that takes more than
    ``time_limit_s`` by itself has the error "timed out after ... s"."""
    numbered = (with_query_ids(queries.select("db_id", "sql"), sessions, query_id="sql")
                .groupBy("query_id").agg(F.first("phys").alias("phys"), F.min("db_id").alias("db_id"),
                                         F.first("query_id_sql").alias("exec_sql")))
    numbered = stored(numbered, "queries")
    out, failed_path = scratch_path(spark, "results"), scratch_path(spark, "query-errors")

    def run(batch):
        phys, texts = batch
        session = sessions.session_for_key(phys)
        done, errors, analyzed = [], [], []
        for query_id, text in texts:
            try:
                session._jsparkSession.sessionState().sqlParser().parseQuery(text)
                analyzed.append((query_id, session.sql(text)))
            except QUERY_ERRORS as e:
                errors.append((query_id, _error_text(e)))
        if analyzed:
            _run_fused(session, analyzed, out, time_limit_s, done, errors)
        return done, errors

    paths: list[str] = []
    errors: list[tuple[str, str]] = []
    written = False
    error_schema = "query_id string, error string"

    def write_errors() -> None:
        spark.createDataFrame(errors, error_schema).coalesce(1).write.mode("append").parquet(failed_path)
        errors.clear()
    batches = _batches(numbered, fused)
    with ThreadPoolExecutor(max_workers=max_workers) as pool:
        while some := list(islice(batches, 2 * max_workers)):
            for done, bad in pool.map(run, some):
                paths += done
                errors += bad
            if len(errors) >= ERRORS_HELD:
                write_errors()
                written = True
    if written and errors:
        write_errors()
    failed = spark.read.schema(error_schema).parquet(failed_path) if written else spark.createDataFrame(errors, error_schema)
    rows = spark.read.schema(ROWS).parquet(*paths) if paths else spark.createDataFrame([], ROWS)
    sums = rows.groupBy("query_id").agg(
        F.sum("n").alias("_n"), F.sum(F.col("n") * F.xxhash64("row").cast("decimal(38,0)")).cast("string").alias("digest"))
    missing = F.when(F.col("phys").isNull(), F.concat(F.lit("Database not found: "), F.coalesce("db_id", F.lit(""))))
    status = (numbered.join(failed, "query_id", "left").join(sums, "query_id", "left")
              .withColumn("error", F.coalesce("error", missing))
              .select("query_id", "db_id", "exec_sql", "error",
                      F.when(F.col("error").isNotNull(), F.lit(-1)).otherwise(F.coalesce("_n", F.lit(0)))
                      .cast("bigint").alias("n_rows"), F.coalesce("digest", F.lit("")).alias("digest")))
    return rows.select("query_id", "row", "n"), stored(status, "query-status")


def row_key(row: str) -> Column:
    """One text per different row: every value behind its length, NULL as a letter, so no two rows share one. An array keeps
    16 bytes or more per value, which is most of what short values take when they are shuffled."""
    return F.array_join(F.transform(row, lambda x: F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("n"))), "")


def result_sets_equal(rows: DataFrame, status: DataFrame) -> DataFrame:
    """Order-insensitive multiset equality per ``pair_id``.

    ``rows(pair_id, side, row)`` with side 'gold'/'pred' and optionally a count ``n``;
    ``status(pair_id, side, error)``. Error (or missing status) on either side -> False. Two empty results
    match, so the verdict starts from the status table and the row check is a
    left join defaulting to True.
    """
    n = F.col("n") if "n" in rows.columns else F.lit(1)
    signed = rows.select("pair_id", row_key("row").alias("row"), F.when(F.col("side") == "gold", n).otherwise(-n).alias("s"))
    # only rows that occur more often on one side go on to the verdict
    diff = (signed.groupBy("pair_id", "row").agg(F.sum("s").alias("d")).where("d <> 0")
            .select("pair_id", F.lit(False).alias("_same")).distinct())
    st = status.groupBy("pair_id").agg(
        F.max(F.when(F.col("side") == "gold", F.col("error").isNull())).alias("_gok"),
        F.max(F.when(F.col("side") == "pred", F.col("error").isNull())).alias("_pok"))
    return (st.join(diff, "pair_id", "left")
            .select("pair_id",
                    (F.coalesce("_gok", F.lit(False)) & F.coalesce("_pok", F.lit(False))
                     & F.coalesce("_same", F.lit(True))).alias("exec_match")))


def execution_accuracy(spark: SparkSession, pairs: DataFrame, sessions: DatabaseSessions, max_workers: int = 8,
                       time_limit_s: float = TIME_LIMIT_S, fused: int = FUSED) -> DataFrame:
    """``pairs(example_id, db_id, gold_sql, pred_sql)`` -> verdict per example.

    Output ``(example_id, db_id, exec_match, gold_rows, pred_rows, gold_error,
    pred_error, db_found)``. A missing database gives False with both errors set
    and -1 rows (``db_found`` False so metrics do not count it as an execution
    error). Queries are executed once per distinct text. A pair of the same query
    needs no comparison, one whose row counts or digests differ is no match, and only the
    remaining pairs have their rows compared.
    """
    keyed = stored(with_query_ids(pairs.select("example_id", "db_id", "gold_sql", "pred_sql"), sessions,
                                  gq="gold_sql", pq="pred_sql")
                   .select("example_id", "db_id", "phys", "gq", "pq", "gold_sql", "pred_sql"), "pairs")
    sides = (keyed.select("db_id", F.col("gold_sql").alias("sql"))
             .unionByName(keyed.select("db_id", F.col("pred_sql").alias("sql"))))
    rows, status = execute_queries(spark, sides, sessions, max_workers, time_limit_s, fused)

    def side(name: str, key: str) -> DataFrame:
        return status.select(F.col("query_id").alias(key), F.col("error").alias(f"{name}_error"),
                             F.col("n_rows").alias(f"{name}_rows"), F.col("digest").alias(f"{name}_digest"))
    judged = (keyed.select("gq", "pq").distinct().join(side("gold", "gq"), "gq").join(side("pred", "pq"), "pq")
              .withColumn("pair_id", F.concat_ws(":", "gq", "pq"))
              .withColumn("run", F.col("gold_error").isNull() & F.col("pred_error").isNull())
              .withColumn("open", F.col("run") & (F.col("gq") != F.col("pq")) & (F.col("gold_rows") == F.col("pred_rows"))
                          & (F.col("gold_digest") == F.col("pred_digest"))))
    open_ = judged.where("open")
    both = None
    for name, key in (("gold", "gq"), ("pred", "pq")):
        part = (open_.select("pair_id", F.col(key).alias("query_id")).join(rows, "query_id")
                .select("pair_id", F.lit(name).alias("side"), "row", "n"))
        both = part if both is None else both.unionByName(part)
    quiet = None
    for name in ("gold", "pred"):
        part = open_.select("pair_id", F.lit(name).alias("side"), F.lit(None).cast("string").alias("error"))
        quiet = part if quiet is None else quiet.unionByName(part)
    verdict = result_sets_equal(both, quiet).withColumnRenamed("exec_match", "same")
    res = keyed.join(judged.join(verdict, "pair_id", "left"), ["gq", "pq"])
    match = F.when(F.col("open"), F.col("same")).otherwise(F.col("run") & (F.col("gq") == F.col("pq")))
    return res.select("example_id", "db_id", match.alias("exec_match"), "gold_rows", "pred_rows", "gold_error",
                      "pred_error", F.col("phys").isNotNull().alias("db_found"))
