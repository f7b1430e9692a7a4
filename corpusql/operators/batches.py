"""Training-batch preparation over token arrays (``array<int>`` columns).

Batches are ``pos div batch_size`` of a dense position: each batch is a group
of at most ``batch_size`` rows, so the per-batch window never grows with data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

IGNORE_INDEX = -100  # fixed value: label id ignored by the loss


def truncate_tokens(df: DataFrame, max_len: int) -> DataFrame:
    out = df.withColumn("input_ids", F.slice("input_ids", 1, max_len))
    for c in ("attention_mask", "labels"):
        if c in df.columns:
            out = out.withColumn(c, F.slice(c, 1, max_len))
    return out


def default_features(df: DataFrame) -> DataFrame:
    """Missing mask -> ones; missing labels -> copy of the ids."""
    ids = F.col("input_ids")
    mask = F.col("attention_mask") if "attention_mask" in df.columns else F.lit(None)
    labels = F.col("labels") if "labels" in df.columns else F.lit(None)
    return (df.withColumn("attention_mask", F.coalesce(mask, F.array_repeat(F.lit(1), F.size(ids))))
            .withColumn("labels", F.coalesce(labels, ids)))


def pad_batch(df: DataFrame, batch_size: int, pad_id: int | None = 0, pos: str = "pos") -> DataFrame:
    """Right-pad ids (pad id, 0 when unset), mask (0) and labels (-100) to the
    longest sequence of the batch."""
    pad_id = 0 if pad_id is None else pad_id
    d = default_features(df).withColumn("batch", F.expr(f"`{pos}` div {int(batch_size)}"))
    w = Window.partitionBy("batch")
    d = d.withColumn("_pad", F.max(F.size("input_ids")).over(w) - F.size("input_ids"))
    extra = F.col("_pad")
    return (d.withColumn("attention_mask", F.concat("attention_mask", F.array_repeat(F.lit(0), extra)))
            .withColumn("labels", F.concat("labels", F.array_repeat(F.lit(IGNORE_INDEX), extra)))
            .withColumn("input_ids", F.concat("input_ids", F.array_repeat(F.lit(pad_id), extra)))
            .drop("_pad"))


def completion_mask(df: DataFrame, template: list[int]) -> DataFrame:
    """Labels -> -100 up to and including the *last* occurrence of ``template`` in
    the ids; template absent (or ids shorter than it) -> all -100."""
    L = len(template)
    tmpl = F.array(*[F.lit(int(t)) for t in template])
    ids = F.col("input_ids")
    starts = F.when(F.size(ids) >= L, F.filter(F.sequence(F.lit(1), F.size(ids) - L + 1),
                                               lambda j: F.slice(ids, j, L) == tmpl))
    # materialized once per row, not re-evaluated inside the per-element lambda
    d = df.withColumn("_end", F.array_max(starts) + (L - 1))   # 1-based index of the template's last token
    end = F.col("_end")
    masked = F.transform("labels", lambda x, i: F.when(i < end, F.lit(IGNORE_INDEX)).otherwise(x))
    return d.withColumn("labels", F.when(end.isNull(), F.transform("labels", lambda x: F.lit(IGNORE_INDEX)))
                        .otherwise(masked)).drop("_end")
