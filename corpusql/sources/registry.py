"""Database registry: ``(db_id, table_name, path)`` rows locate each database's tables.

Execution needs per-database name spaces (different databases reuse table
names and temp views have none), so each database gets its own child session
sharing the SparkContext; only its tables are registered there.
"""

from __future__ import annotations

import os
import threading
from collections import OrderedDict
from concurrent.futures import ThreadPoolExecutor
from itertools import islice
from urllib.parse import unquote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusql.session import scratch_path, stored

#: Paths that the driver looks up at a time, of file systems that tasks have no client for.
DRIVER_PATHS = 1000


def registry_from_dirs(spark: SparkSession, entries: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(entries, "db_id string, table_name string, path string")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in its own file system."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def existing_paths(registry: DataFrame) -> DataFrame:
    """``(path, there)`` of the registry's paths, each looked up once.

    Tasks look at local, HDFS and object-store paths; whatever a task has no client for stays open, and
    the driver asks Spark's own file systems for it, ``DRIVER_PATHS`` at a time, writing the answers as it goes.
    """
    spark = registry.sparkSession
    default = spark._jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(spark._jsc.hadoopConfiguration()).toString()

    def look(batches):
        for batch in batches:
            paths = batch.column(0).to_pylist()
            yield pa.record_batch([batch.column(0), pa.array([_seen(p, default) for p in paths], pa.bool_())], ["path", "there"])
    asked = stored(registry.select("path").distinct().mapInArrow(look, "path string, there boolean"), "paths")
    rest = asked.where("there IS NULL").select("path")
    out, waiting, written = scratch_path(spark, "paths"), rest.toLocalIterator(), False
    with ThreadPoolExecutor(max_workers=16) as pool:
        while some := [r["path"] for r in islice(waiting, DRIVER_PATHS)]:
            there = list(zip(some, pool.map(lambda p: path_exists(spark, p), some)))
            spark.createDataFrame(there, "path string, there boolean").write.mode("append").parquet(out)
            written = True
    known = asked.where("there IS NOT NULL")
    return known.unionByName(spark.read.schema(known.schema).parquet(out)) if written else known


def _seen(path: str, default: str) -> bool | None:
    """Whether a task sees ``path``; None if it has no client for its file system."""
    scheme = urlsplit(path).scheme or urlsplit(default).scheme
    if scheme == "file":
        return os.path.exists(unquote(urlsplit(path).path) if urlsplit(path).scheme else path)
    if scheme not in ("hdfs", "s3", "gs", "abfs", "abfss"):
        return None
    try:
        system, at = pafs.FileSystem.from_uri(path if urlsplit(path).scheme else default.rstrip("/") + path)
        return system.get_file_info(at).type != pafs.FileType.NotFound
    except (OSError, ValueError, pa.ArrowException):
        return None


def existing_databases(registry: DataFrame) -> DataFrame:
    """``(db_id, n_tables, there, tables)`` per database of the registry: whether all its paths are
    there, and its ``(table_name, path)`` in order."""
    return registry.join(existing_paths(registry), "path").groupBy("db_id").agg(
        F.count("*").alias("n_tables"), F.bool_and("there").alias("there"),
        F.array_sort(F.collect_list(F.struct("table_name", "path"))).alias("tables"))


def resolve_database(db_ids: DataFrame, registry: DataFrame) -> DataFrame:
    """Per requested ``db_id``: its table count and whether it exists, i.e. has registered
    tables and all their paths are there. Paths are looked up once each."""
    wanted = registry.join(db_ids.select("db_id").distinct(), "db_id", "left_semi")
    return (db_ids.select("db_id").distinct()
            .join(existing_databases(wanted), "db_id", "left")
            .select("db_id",
                    F.coalesce("n_tables", F.lit(0)).cast("bigint").alias("n_tables"),
                    F.coalesce("there", F.lit(False)).alias("found")))


class DatabaseSessions:
    """Lazily created child sessions, one per physical database, with its tables as views.

    ``tables`` is a registry ``(db_id, table_name, path)`` or, for a few databases, a dictionary.
    The databases that exist are a stored table; the driver learns the tables of a database
    when its session is opened, and keeps at most ``SESSIONS_HELD`` sessions.

    Texts that run in them come from models: they cannot read files by path nor call JVM
    methods.
    """

    UNSAFE_FUNCTIONS = ("reflect", "java_method", "try_reflect")
    SESSIONS_HELD = 64

    def __init__(self, spark: SparkSession, tables: DataFrame | dict[str, dict[str, str]],
                 fmt: str = "parquet"):
        if isinstance(tables, dict):
            tables = registry_from_dirs(spark, [(d, t, p) for d, own in tables.items() for t, p in own.items()])
        self.spark = spark
        self.fmt = fmt
        self._registry = tables
        self._databases: DataFrame | None = None
        self._sessions: OrderedDict[str, SparkSession] = OrderedDict()
        self._lock = threading.Lock()

    def _existing(self) -> DataFrame:
        if self._databases is None:
            found = existing_databases(self._registry).where("there")
            self._databases = stored(found.select("db_id", F.sha2(F.to_json("tables").cast("binary"), 256).alias("phys"), "tables"),
                                     "databases")
        return self._databases

    def physical(self) -> DataFrame:
        """``(db_id, phys)`` of the databases that exist: ids whose tables resolve to the same
        paths share results, so a query text runs once per physical database."""
        return self._existing().select("db_id", "phys")

    def session_for_key(self, key: str) -> SparkSession:
        with self._lock:
            if key in self._sessions:
                self._sessions.move_to_end(key)
                return self._sessions[key]
            s = self.spark.newSession()
            s.conf.set("spark.sql.runSQLOnFiles", "false")
            functions = s._jsparkSession.sessionState().functionRegistry()
            for name in self.UNSAFE_FUNCTIONS:
                functions.dropFunction(self.spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name))
            for name, path in self._existing().where(F.col("phys") == key).select("tables").first()["tables"]:
                s.read.format(self.fmt).load(path).createOrReplaceTempView(name)
            self._sessions[key] = s
            if len(self._sessions) > self.SESSIONS_HELD:
                self._sessions.popitem(last=False)
            return s
