"""Modified Kneser-Ney over 64 byte classes as one dense array.

A small closed form of the model that ``tests/llm/test_quality.py`` holds against brute force. No query scores
with it: ``quality`` counts and scores code points by joins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusql.llm.common import pieces

ORDER, SYMBOL_BITS = 4, 6
SYMBOLS = 1 << SYMBOL_BITS
_KEY_MASK = (1 << SYMBOL_BITS * ORDER) - 1


def byte_classes() -> np.ndarray:
    """Symbol of every byte."""
    out = np.full(256, 59, np.uint8)
    out[0x61:0x7B] = np.arange(26)
    out[0x41:0x5B] = 26 + np.arange(26)
    out[0x09:0x0E], out[0x20], out[0x0A] = 52, 52, 53
    out[0x30:0x3A] = 54
    for symbol, some in ((55, b"."), (56, b","), (57, b"!?;:"), (58, b"'\"()[]-")):
        out[np.frombuffer(some, np.uint8)] = symbol
    out[0x80:0xA0], out[0xA0:0xC0], out[0xC0:0xC4], out[0xC4:] = 62, 63, 60, 61
    return out


_CLASS = byte_classes()
_START = _CLASS[0x0A]        # a document begins like a line


def ngrams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Packed n-gram that ends at each byte."""
    symbol = _CLASS[data]
    begins = offsets[:-1][np.diff(offsets) > 0]
    key, back = symbol.astype(np.int32), symbol
    for n in range(1, ORDER):
        back = np.concatenate([[_START], back[:-1]]).astype(np.uint8)
        back[begins] = _START
        key |= back.astype(np.int32) << (SYMBOL_BITS * n)
    return key


def count_ngrams(texts: DataFrame) -> DataFrame:
    """``(key, c)`` over all texts; partial counts leave a task once per distinct n-gram."""
    def run(batches):
        total = np.zeros(_KEY_MASK + 1, np.int32)
        for batch in batches:
            for _, _, data, at in pieces(batch.column(0)):
                keys, counts = np.unique(ngrams(data, at), return_counts=True) if len(data) else ((), ())
                total[keys] += counts.astype(np.int32) if len(keys) else 0
        keys = np.flatnonzero(total)
        for i in range(0, len(keys), 100_000):
            some = keys[i:i + 100_000]
            yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(total[some].astype(np.int64))], ["key", "c"])
    return texts.mapInArrow(run, "key int, c bigint").groupBy("key").agg(F.sum("c").alias("c"))


def smoothed(counts: DataFrame) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per order 1..ORDER: (n-grams, their discounted probability, contexts, weight of the
    next lower order)."""
    tables = {ORDER: counts}
    for n in range(ORDER - 1, 0, -1):      # how many different symbols come before an n-gram
        tables[n] = (tables[n + 1].groupBy(F.col("key").bitwiseAND(F.lit((1 << SYMBOL_BITS * n) - 1)).alias("key"))
                     .agg(F.count("*").alias("c")))
    out = []
    for n in range(1, ORDER + 1):
        seen = tables[n]
        of = {r["c"]: r["n"] for r in seen.where("c <= 4").groupBy("c").agg(F.count("*").alias("n")).collect()}
        n1, n2, n3, n4 = (of.get(i, 0) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 0.75, 3 - 4 * y * n4 / n3 if n3 else 0.9]
        d = [min(max(x, 0.1), k + 0.9) for k, x in enumerate(raw)]
        cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        row = seen.select("key", "c", F.shiftright("key", SYMBOL_BITS).alias("ctx"), cut.alias("cut"))
        totals = row.groupBy("ctx").agg(F.sum("c").alias("total"), F.sum("cut").alias("freed"))
        probs = row.join(totals, "ctx").select("key", ((F.col("c") - F.col("cut")) / F.col("total")).alias("p"))
        grams = probs.toPandas()
        contexts = totals.select("ctx", (F.col("freed") / F.col("total")).alias("g")).toPandas()
        out.append((grams["key"].to_numpy(np.int32), grams["p"].to_numpy(np.float32),
                    contexts["ctx"].to_numpy(np.int32), contexts["g"].to_numpy(np.float32)))
    return out


def dense(orders) -> np.ndarray:
    """Natural log of the probability of every n-gram's last symbol after the others."""
    lower = np.full(1, 1 / SYMBOLS, np.float32)
    for n, (keys, p, contexts, g) in enumerate(orders, 1):
        weight = np.ones(SYMBOLS ** (n - 1), np.float32)
        weight[contexts] = g
        below = lower.reshape(-1, SYMBOLS) if n > 1 else lower.reshape(1, 1)
        table = weight.reshape(-1, below.shape[0])[:, :, None] * below if n > 1 else np.full((1, 1, SYMBOLS), weight[0] * lower[0])
        table = np.ascontiguousarray(table, np.float32).reshape(-1)
        table[keys] += p
        lower = table
    return np.log(lower)
