"""Spark session and shared-folder helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "corpusql") -> SparkSession:
    """Build (or reuse) a session with AQE on and the UI off.

    On a cluster the master and most settings come from spark-submit; the
    values here only fill what is unset.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the
    session, or the one given to ``setCheckpointDir``.

    Where neither is set, a local master gets a folder of its own and any other master
    raises: executors do not see a folder that the driver makes on its machine.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not root and sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="corpusql-"))
    if root and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return (root or sc.getCheckpointDir()).rstrip("/")


_scopes: list[list[str]] = []


def owned(path: str) -> str:
    """``path``, to be removed with the innermost open ``scratch_scope``."""
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Owns the scratch tables made within: they are removed when the scope ends, so a result must be
    consumed in it. Scopes nest, an inner one removes its own. Without any, tables stay, as results are read from
    them lazily.

        with scratch_scope(spark):
            query(spark, sf_dir).write.parquet(target)
    """
    mine: list[str] = []
    _scopes.append(mine)
    try:
        yield
    finally:
        _scopes[:] = [x for x in _scopes if x is not mine]
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for name in mine:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique location under the shared folder, removed with the scope that is open."""
    return owned(f"{shared_root(spark)}/corpusql/{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, with its measured size."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
