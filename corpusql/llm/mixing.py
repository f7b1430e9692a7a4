"""Mixing sources to target weights by hash thresholds.

Every source gets a share of all words by its weight, held at ``most`` times its own
size; the excess is shared again by weight until no source is above its limit. A
source whose target is ``k`` times its size and a rest is taken ``k`` times whole; the
rest is taken from the documents with the smallest hashes. The threshold is found by
histograms: words are summed by source and hash bucket, the bucket in which the rest
ends is found, and only that bucket is refined, so documents are never sorted. Sums
are pre-aggregated before their shuffle, so a source with most rows is no hot task.

Defined cases: a null text has size 0; a null source is a source of its own, ordered
last; a source of size 0 has target 0; repeated rows are separate documents, but rows
with the same id in one source are taken or left together; an empty table gives an empty result. Other columns
stay untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusql.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
LEVEL_BITS = 12
HASH_BITS = 60
WEIGHTS = (5, 2, 1)
MOST = 3


def size_of(text: Column | str) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def hash_of(doc_id: Column | str) -> Column:
    """The first 60 bits of the id's MD5: the same on every run and in any engine."""
    key = F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``(source, source_size, target)``. One row per source, so the two ordered passes
    over sources run in one task however large the sources are."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighted = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (nth % len(weights)) + 1))
    limit = F.lit(most) * F.col("source_size")
    order = Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    level = (weighted
             .withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0)))
             .withColumn("weights", F.sum("weight").over(rest))
             .withColumn("held", F.col("left") * F.col("weight") >= limit * F.col("weights"))
             # the first source that isn't held sets what a unit of weight is worth
             .withColumn("unit", F.min_by(F.when(~F.col("held"), F.col("left") / F.col("weights")),
                                          F.when(~F.col("held"), limit / F.col("weight"))).over(everything)))
    return level.select("source", "source_size",
                        F.when(F.col("held"), limit.cast("double"))
                        .otherwise(F.least(F.col("unit") * F.col("weight"), limit.cast("double"))).alias("target"))


def thresholds(sized: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(source, source_size, target, whole, b1, b2, last)``: a document is taken ``whole`` times, and
    once more where its hash lies below the boundary (``b1``, ``b2``, ``last``)."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = wanted.withColumn("whole", F.least(whole, F.lit(MOST)).cast("bigint"))
    plan = plan.withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    inside, budget = sized, plan.select("source", "rest")
    for level, shift in ((1, HASH_BITS - LEVEL_BITS), (2, HASH_BITS - 2 * LEVEL_BITS), (3, 0)):
        name = f"b{level}"
        sums = (inside.withColumn(name, F.shiftright("hash", shift))
                .groupBy("source", name).agg(F.sum("size").alias("words")))
        upto = Window.partitionBy("source").orderBy(name)
        found = (sums.withColumn("upto", F.sum("words").over(upto))
                 .join(budget.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
                 .where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest")))
                 .select("source", name, "words", (F.col("rest") - F.col("upto") + F.col("words")).alias("rest")))
        found = stored(found, f"mix-{name}")
        if level == 3:   # one hash value left: take it if that comes nearer to the target
            found = found.select("source", (F.col(name) + (F.col("words") - F.col("rest") < F.col("rest")).cast("int"))
                                 .alias("last"))
        here = found.drop("words", "rest").withColumnRenamed("source", f"s{level}")
        plan = plan.join(here, F.col("source").eqNullSafe(F.col(f"s{level}")), "left").drop(f"s{level}")
        if level < 3:
            budget = found.select("source", "rest")
            edge = found.select(F.col("source").alias("s"), F.col(name).alias("b"))
            inside = inside.join(edge, F.col("source").eqNullSafe(F.col("s"))
                                 & (F.shiftright("hash", shift) == F.col("b")), "left_semi")
    return plan.drop("rest")


def copies(hash_: Column, plan=F.col) -> Column:
    """How often a document is taken, from its hash and its source's ``thresholds`` row."""
    one, two = F.shiftright(hash_, HASH_BITS - LEVEL_BITS), F.shiftright(hash_, HASH_BITS - 2 * LEVEL_BITS)
    below = ((one < plan("b1"))
             | ((one == plan("b1")) & ((two < plan("b2")) | ((two == plan("b2")) & (hash_ < plan("last"))))))
    return plan("whole") + F.coalesce(below, F.lit(False)).cast("bigint")


def sized_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source") -> DataFrame:
    """``(doc_id, source, size, hash)``, stored: the one pass over the texts."""
    return stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                              size_of(text_col).alias("size"), hash_of(F.col(id_col)).alias("hash")), "mix-sizes")


def mix_table(docs: DataFrame, **columns) -> DataFrame:
    """``(doc_id, size, source, source_size, target, taken)`` per document."""
    sized = sized_documents(docs, **columns)
    plan = thresholds(sized, targets(sized))
    joined = sized.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    return joined.select("doc_id", "size", "source", "source_size", "target",
                         (F.col("size") * copies(F.col("hash"))).alias("taken"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  source_col: str = "source") -> DataFrame:
    """The documents of the mix with their columns; one taken n times is there n times."""
    sized = sized_documents(docs, id_col, text_col, source_col)
    plan = thresholds(sized, targets(sized)).select(F.struct("*").alias("_mix_plan"))
    plan = plan.withColumn("_mix_source", F.col("_mix_plan.source")).select("_mix_source", "_mix_plan")
    kept = docs.join(plan, docs[source_col].eqNullSafe(F.col("_mix_source")))
    times = copies(hash_of(F.col(id_col)), F.col("_mix_plan").getField)
    return (kept.withColumn("_mix_copy", F.explode(F.array_repeat(F.lit(0), times.cast("int"))))
            .select(*docs.columns))


def op5_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_table(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS hash
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS INT) + 1] AS weight FROM per),
level AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS remaining,
         CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS weights
  FROM weighted WINDOW o AS (ORDER BY 3 * source_size / weight, source ASC NULLS LAST)),
unit AS (
  SELECT min_by(remaining / weights, 3 * source_size / weight) AS unit FROM level
  WHERE NOT (remaining * weight >= 3 * source_size * weights)),
plan AS (
  SELECT source, source_size,
         CASE WHEN remaining * weight >= 3 * source_size * weights THEN CAST(3 * source_size AS DOUBLE)
              ELSE least(unit.unit * weight, CAST(3 * source_size AS DOUBLE)) END AS target
  FROM level LEFT JOIN unit ON TRUE),
rests AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS whole FROM plan),
hashes AS (SELECT source, hash, sum(size) AS words FROM sized GROUP BY source, hash),
cumulative AS (
  SELECT h.*, sum(words) OVER (PARTITION BY h.source ORDER BY hash) AS upto, r.whole, r.source_size, r.target,
         greatest(r.target - r.whole * r.source_size, 0) AS rest
  FROM hashes h JOIN rests r ON h.source IS NOT DISTINCT FROM r.source),
taken AS (
  SELECT *, CASE WHEN upto <= rest AND EXISTS_ABOVE THEN 1
                 WHEN upto > rest AND upto - words <= rest AND upto - rest < rest - (upto - words) THEN 1 ELSE 0 END AS extra
  FROM (SELECT *, max(upto) OVER (PARTITION BY source) > rest AS EXISTS_ABOVE FROM cumulative))
SELECT s.doc_id, s.size, t.source_size, t.target, CAST(s.size * (t.whole + t.extra) AS BIGINT) AS taken
FROM sized s JOIN taken t ON s.source IS NOT DISTINCT FROM t.source AND s.hash = t.hash
"""
