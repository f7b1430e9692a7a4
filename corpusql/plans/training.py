"""Training data job: instruction examples -> padded, masked token batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusql.functions.prompts import CONFIG_PROMPT_TEMPLATE
from corpusql.operators import batches, prompting
from corpusql.operators.positions import dense_positions


def training_batches(examples: DataFrame, tokenize: Callable[[Column], Column], template: list[int], max_len: int,
                     batch_size: int, pad_id: int | None = 0) -> DataFrame:
    """``(pos, batch, input_ids, attention_mask, labels)``: prompt and answer as one text,
    tokenized to ``array<int>``, cut to ``max_len``, batched by dense position, padded, and labelled
    behind the last ``template`` only."""
    text = prompting.sft_text(examples, CONFIG_PROMPT_TEMPLATE, keep=("pos",))
    tokens = text.select(F.col("pos").alias("_pos"), tokenize(F.col("text")).alias("input_ids"))
    dense = dense_positions(batches.truncate_tokens(tokens, max_len), ["_pos"], name="pos").drop("_pos")
    padded = batches.pad_batch(dense, batch_size, pad_id)
    return batches.completion_mask(padded, template).select("pos", "batch", "input_ids", "attention_mask", "labels")
