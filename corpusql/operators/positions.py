"""Dense global positions in a sort order, without a single-partition window.

``dense_positions`` range-partitions on the order keys (hot keys are split
across partitions because the full key is unique), sorts inside partitions and
checkpoints to the shared folder so partition contents and order are fixed
for every later use (lost executors re-read the checkpoint, they do not
re-sample range bounds). The row's offset inside its partition comes from
``monotonically_increasing_id`` (partition id in the upper bits); the per-
partition counts are one row per partition, so the offsets table is bounded by
the partition count, not by the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusql.session import shared_root

_LOW_BITS = (1 << 33) - 1


def dense_positions(df: DataFrame, order_cols: list, name: str = "g",
                    num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 0-based position of the row in ``order_cols`` order.

    ``order_cols`` must be a total order (include a unique key) for the result
    to be deterministic. Without ``num_partitions`` the count follows the data: adaptive
    execution sizes the partitions.
    """
    spark = df.sparkSession
    shared_root(spark)
    dealt = df.repartitionByRange(num_partitions, *order_cols) if num_partitions else df.repartitionByRange(*order_cols)
    ordered = dealt.sortWithinPartitions(*order_cols).checkpoint(eager=True)
    tagged = ordered.withColumn("_mid", F.monotonically_increasing_id())
    pid = F.shiftright(F.col("_mid"), 33)
    counts = {r["p"]: r["n"] for r in
              tagged.groupBy(pid.alias("p")).agg(F.count("*").alias("n")).collect()}
    offsets, acc = [], 0
    for p in sorted(counts):
        offsets.append((p, acc))
        acc += counts[p]
    # one row per partition: a proven bound for the broadcast
    starts = spark.createDataFrame(offsets, "_p bigint, _start bigint")
    out = (tagged.withColumn("_p", pid).join(F.broadcast(starts), "_p")
           .withColumn(name, F.col("_start") + F.col("_mid").bitwiseAND(F.lit(_LOW_BITS)))
           .select(*df.columns, name))
    out.total_rows = acc   # row count, known from the per-partition counts
    return out
