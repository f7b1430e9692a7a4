"""What a query text reads, joins and aggregates, from its parsed plan.

Names in comments, literals or quoted identifiers are no tables, a comma between tables is a join, and a
name defined by WITH is no table. Only parsing is on the driver, for each different text once, some
at a time; the answers are a table.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

from corpusql.session import scratch_path

AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX")
SHAPE = "sql string, tables array<string>, joins int, aggregates array<string>"
#: Texts that the driver parses at a time.
PARSED_AT_ONCE = 512


def _walk(node, tables: set[str], defined: set[str], aggregates: list[str]) -> int:
    """Collects names from a plan's JSON; returns the number of joins."""
    if isinstance(node, list):
        return sum(_walk(x, tables, defined, aggregates) for x in node)
    if not isinstance(node, dict):
        return 0
    kind = str(node.get("class", "")).rsplit(".", 1)[-1]
    if kind == "UnresolvedRelation":
        tables.add(node["multipartIdentifier"].strip("[]").lower())
    elif kind == "UnresolvedFunction":
        name = node["nameParts"].strip("[]").upper()
        if name in AGGREGATES:
            aggregates.append(name)
    elif kind == "UnresolvedWith":
        defined.update(str(x["_1"]).lower() for x in node["cteRelations"])
    return (kind == "Join") + sum(_walk(v, tables, defined, aggregates) for v in node.values() if isinstance(v, (dict, list)))


def text_shape(spark: SparkSession, sql: str) -> tuple[list[str], int, list[str]] | None:
    """Tables, number of joins and aggregate calls of a text; None if it is no query."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parseQuery(sql)
    except ParseException:
        return None
    tables: set[str] = set()
    defined: set[str] = set()
    aggregates: list[str] = []
    joins = _walk(json.loads(plan.toJSON()), tables, defined, aggregates)
    return sorted(tables - defined), joins, sorted(aggregates)


def query_shapes(texts: DataFrame) -> DataFrame:
    """``(sql, tables, joins, aggregates)`` of the different ``texts(sql)`` that are queries."""
    spark = texts.sparkSession
    out, written = scratch_path(spark, "shapes"), False
    waiting = texts.where("sql IS NOT NULL").distinct().toLocalIterator()
    with ThreadPoolExecutor(max_workers=8) as pool:
        while some := [r["sql"] for r in islice(waiting, PARSED_AT_ONCE)]:
            found = [(t, *s) for t, s in zip(some, pool.map(lambda t: text_shape(spark, t), some)) if s]
            if found:
                spark.createDataFrame(found, SHAPE).coalesce(1).write.mode("append").parquet(out)
                written = True
    return spark.read.schema(SHAPE).parquet(out) if written else spark.createDataFrame([], SHAPE)
