"""Example conversion, database-level split, and corpus selection operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusql.functions.prompts import INSTRUCTION_TEXT
from corpusql.functions.text import hash_key
from corpusql.operators.positions import dense_positions


def convert_examples(raw: DataFrame, lookup: DataFrame) -> DataFrame:
    """Raw ``(db_id, question, query, pos)`` + ``(db_id, schema)`` -> instruction rows.

    Inner join on exact ``db_id``: examples without a schema are dropped (see
    ``orphan_examples``). The lookup has one row per database; Spark broadcasts it
    when its measured size is under the broadcast threshold and otherwise runs a
    shuffle join, whose hot keys AQE splits.
    """
    return (raw.join(lookup, "db_id", "inner")
            .select(F.lit(INSTRUCTION_TEXT).alias("instruction"), "schema", "question",
                    F.col("query").alias("output"), "db_id", "pos"))


def orphan_examples(raw: DataFrame, lookup: DataFrame) -> DataFrame:
    """``(db_id, n_skipped)`` for example databases missing from the catalog."""
    return (raw.join(lookup.select("db_id"), "db_id", "left_anti")
            .groupBy("db_id").agg(F.count("*").alias("n_skipped")))


def n_validation_databases(n_databases: int, val_ratio: float) -> int:
    """``max(1, int(n * ratio))`` (Python truncation), capped at ``n``."""
    if n_databases <= 0:
        return 0
    return min(n_databases, max(1, int(n_databases * val_ratio)))


def split_by_database(examples: DataFrame, val_ratio: float, seed: int,
                      train_name: str = "train", val_name: str = "val") -> DataFrame:
    """Add ``split``: whole databases go to validation.

    Databases are ordered by ``md5(seed:db_id)`` (ties by id) and the first
    ``max(1, int(n * ratio))`` are held out. Only the distinct ids are ranked; the
    cut is one threshold key, so the examples themselves are labelled by a
    narrow projection (no join, no shuffle of examples).
    """
    key = F.struct(hash_key(F.lit(seed), F.col("db_id")).alias("k"), F.col("db_id").alias("d"))
    ids = examples.select("db_id").distinct().where(F.col("db_id").isNotNull())
    ranked = dense_positions(ids.select("db_id", key.alias("_key")), ["_key"], name="_g")
    n_val = n_validation_databases(ranked.total_rows, val_ratio)
    if n_val == 0:
        return examples.withColumn("split", F.lit(train_name))
    cut = ranked.where(F.col("_g") == n_val - 1).select("_key").first()["_key"]
    threshold = F.struct(F.lit(cut["k"]).alias("k"), F.lit(cut["d"]).alias("d"))
    return examples.withColumn(
        "split", F.when(key <= threshold, F.lit(val_name)).otherwise(F.lit(train_name)))


def split_order(examples: DataFrame) -> DataFrame:
    """``ord``: 0-based position inside each split in (db_id, pos) order."""
    g = dense_positions(examples, ["split", "db_id", "pos"], name="_g")
    starts = g.groupBy("split").agg(F.min("_g").alias("_start"))
    # one row per split name: a proven bound for the broadcast
    return (g.join(F.broadcast(starts), "split")
            .withColumn("ord", F.col("_g") - F.col("_start")).drop("_g", "_start"))


def split_summary(examples: DataFrame) -> DataFrame:
    return examples.groupBy("split").agg(
        F.count("*").alias("n_examples"),
        F.countDistinct("db_id").alias("n_databases"))


def filter_database(examples: DataFrame, db_id: str) -> DataFrame:
    return examples.where(F.col("db_id") == F.lit(db_id))


def available_databases(examples: DataFrame, k: int = 20) -> DataFrame:
    """First ``k`` ids in sorted order plus how many ids are not listed."""
    ids = examples.select("db_id").distinct()
    total = ids.agg(F.count("*")).scalar()
    return (ids.orderBy("db_id").limit(k)
            .select("db_id", F.greatest(total - F.lit(k), F.lit(0)).alias("n_more")))


def sample_examples(examples: DataFrame, k: int, seed: int) -> DataFrame:
    """Seeded sample of exactly ``k`` rows, without replacement, deterministic.

    ``k <= 0`` or ``k >= n`` keeps every row. Rows are ranked by
    ``md5(seed:pos)``: a per-partition top-k followed by one merge of k rows.
    """
    if k <= 0:
        return examples
    return examples.orderBy(hash_key(F.lit(seed), F.col("pos")), "pos").limit(k)


def limit_examples(examples: DataFrame, n: int | None, index_col: str = "index") -> DataFrame:
    """First ``n`` examples by dense 0-based position; 0/None keeps all."""
    if not n:
        return examples
    return examples.where(F.col(index_col) < F.lit(n))
