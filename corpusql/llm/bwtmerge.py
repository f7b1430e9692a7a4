"""Exact substring deduplication by merged Burrows-Wheeler transforms.

Every byte covered by a string of ``length`` bytes that also starts anywhere else, in
another document or the same, is removed. ``repeats`` sends the text around windows
that may be repeated to tasks by anchor. There the segments are dealt to shards, each shard sorts
its own suffixes into a transform, and the transforms are merged by interleave
refinement: starting from shard after shard, every round reads the transforms in the present order
and deals the entries stably to the buckets of their symbols, after which the order
is right for one more symbol. No suffix is compared or sorted again. A border that
first shows in round ``d`` has a common prefix of ``d - 1`` symbols, so after the last round intervals without
a border inside are the repeated strings.

A symbol is a block of bytes, its suffix goes on ``block`` bytes later, and so a text is
as many interleaved strings as a block has bytes: ``length / block`` rounds settle
``length`` bytes at every byte position. Blocks are ranked by 64-bit hashes.

Strings are judged on the input: removing bytes never makes or unmakes a repeat.

Defined cases: null text is empty; texts shorter than ``length`` stay whole; equal rows
repeat each other, also with the same doc_id; kept bytes need not be valid UTF-8, so
they are binary; an empty table gives an empty result; other columns are kept in ``rest``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusql.llm.common import by_batch, pieces, window_hashes
from corpusql.llm.repeats import NO_ID, Kind, known_documents, with_flags

LENGTH = 400
ANCHOR = 64
BLOCK = 100
SHARD_BYTES = 256 << 10
TASK_BYTES = 1 << 20


def block_of(length: int) -> int:
    """The largest divisor of ``length`` up to ``BLOCK``."""
    return max(b for b in range(1, min(BLOCK, length) + 1) if length % b == 0)


def _stable(values: np.ndarray) -> np.ndarray:
    """Stable order of numbers below 2**32, fewer than 2**32 of them."""
    packed = np.sort(values.astype(np.uint64) << np.uint64(32) | np.arange(len(values), dtype=np.uint64))
    return (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)


def symbols(data: np.ndarray, ends: np.ndarray, block: int) -> np.ndarray:
    """Symbol of the block at each byte; 0 where none fits before its segment's end."""
    n = len(data)
    code = np.zeros(n, np.int64)
    whole = np.flatnonzero(np.arange(n) + block <= ends)
    if len(whole):
        code[whole] = np.unique(window_hashes(data, block)[whole], return_inverse=True)[1] + 1
    return code


def sorted_rows(code: np.ndarray, ends: np.ndarray, block: int, depth: int) -> np.ndarray:
    """A shard's suffixes by their first ``depth`` symbols, by doubling."""
    n = len(code)
    where = np.arange(n)
    rank, have = np.unique(code, return_inverse=True)[1], 1
    while have < depth:
        step = min(have, depth - have)
        ahead = np.zeros(n, np.int64)
        inside = np.flatnonzero(where + step * block <= ends)
        ahead[inside] = rank[inside + step * block] + 1
        order = _stable(ahead)
        order = order[_stable(rank[order])]
        new = np.append(True, (rank[order][1:] != rank[order][:-1]) | (ahead[order][1:] != ahead[order][:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        have += step
    return _stable(rank)


def merge(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows in merged order, common prefix with the row before, in symbols, up to
    ``depth``). Rows are numbered through the shards; each transform is its symbols in
    the shard's order, 0 where a string begins."""
    sizes = np.array([len(t) for t in transforms])
    base = np.cumsum(sizes) - sizes
    bwt = np.concatenate(transforms)
    # strings have an end for every beginning: the empty suffixes come first
    empty = np.repeat(np.arange(len(sizes)), [int((t == 0).sum()) for t in transforms])
    order = np.repeat(np.arange(len(sizes)), sizes)
    border = np.zeros(len(order), bool)
    border[:1] = True
    common = np.full(len(order), depth, np.int64)
    common[:1] = 0

    def rows_of(order):
        row = np.empty(len(order), np.int64)
        for s in range(len(sizes)):
            row[order == s] = base[s] + np.arange(sizes[s])
        return row
    for d in range(1, depth + 1):
        symbol = bwt[rows_of(order)]
        go = np.flatnonzero(symbol)
        go = go[_stable(symbol[go])]
        block = np.cumsum(border)[go]
        seen = np.zeros(len(order), bool)
        seen[:1] = True
        k = len(empty)
        if k < len(seen):
            seen[k] = True
            seen[k + 1:] = (symbol[go][1:] != symbol[go][:-1]) | (block[1:] != block[:-1])
        common[seen & (common == depth) & ~border] = d - 1
        order, border = np.concatenate([empty, order[go]]), seen
    return rows_of(order), common


def repeated_starts(length: int):
    """``solve`` of ``repeats``: runs of a segment's window starts that are repeated, as
    first and last in turn."""
    block = block_of(length)
    depth = length // block

    def solve(texts, starts, n, least):
        data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        sizes = np.array([len(t) + 1 for t in texts])       # with a place for the end
        begin = np.cumsum(sizes) - sizes
        seg = np.repeat(np.arange(len(texts)), sizes)
        ends = (begin + sizes - 1)[seg]
        code = symbols(data, ends, block)
        back = np.arange(len(data)) - block
        before = np.where(back >= begin[seg], code[np.maximum(back, 0)], 0)
        cuts = np.unique(np.append(np.searchsorted(begin, np.arange(0, len(data), SHARD_BYTES)), len(texts)))
        transforms, rows = [], []
        for a, b in zip(cuts[:-1], cuts[1:]):
            lo, hi = begin[a], begin[b - 1] + sizes[b - 1]
            order = lo + sorted_rows(code[lo:hi], ends[lo:hi] - lo, block, depth)
            rows.append(order)
            transforms.append(before[order])
        merged, common = merge(transforms, depth)
        at = np.concatenate(rows)[merged]
        group = np.cumsum(common < depth) - 1
        is_start = at - begin[seg[at]] < starts[seg[at]]
        seen = np.bincount(group[is_start], n[seg[at[is_start]]], group[-1] + 1)
        again = np.zeros(len(data) + 1, bool)
        again[at[is_start]] = seen[group[is_start]] > 1
        edge = np.flatnonzero(again[:-1] & ~np.append(False, again[:-2])), np.flatnonzero(again[:-1] & ~again[1:])
        out = [np.zeros(0, np.int64)] * len(texts)
        first = seg[edge[0]]
        bounds = np.stack([edge[0] - begin[first], edge[1] - begin[first]], axis=1)
        cuts = np.flatnonzero(np.append(True, first[1:] != first[:-1])) if len(first) else []
        for a, b in zip(cuts, [*cuts[1:], len(first)]):
            out[first[a]] = bounds[a:b].ravel()
        return out
    return solve


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, kept binary, n_bytes, n_removed, n_spans, rest)`` per row."""
    known = known_documents(docs, id_col, text_col)
    flagged = with_flags(known, Kind("byte", length, min(ANCHOR, length)), repeated_starts(length), False,
                         most_bytes=TASK_BYTES)

    def run(batch):
        found = batch.column(3)
        for i, j, data, at in pieces(batch.column(1)):
            raw, kept, counts = data.tobytes(), [], []
            for r in range(i, j):
                a, b = int(at[r - i]), int(at[r - i + 1])
                runs = []
                if found[r].is_valid:
                    hits = [(h["lo"] + x, h["lo"] + y + length) for h in found[r].as_py()
                            for x, y in zip(h["flags"][::2], h["flags"][1::2])]
                    for x, y in sorted(hits):
                        if runs and x <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], y)
                        else:
                            runs.append([x, y])
                edges = [0, *(e for run in runs for e in run), b - a]
                kept.append(b"".join(raw[a + x:a + y] for x, y in zip(edges[::2], edges[1::2])))
                counts.append((b - a, sum(y - x for x, y in runs), len(runs)))
            yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(kept, pa.binary()),
                                   *(pa.array([c[k] for c in counts], pa.int64()) for k in range(3)),
                                   batch.column(2).slice(i, j - i)],
                                  ["did", "kept", "n_bytes", "n_removed", "n_spans", "rest"])
    rest = flagged.schema["rest"].dataType.simpleString()
    out = flagged.select("did", "text", "rest", "found").mapInArrow(
        by_batch(run), f"did bigint, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint, rest {rest}")
    return out.select(F.when(F.col("did") != NO_ID, F.col("did")).alias("doc_id"), "kept", "n_bytes", "n_removed",
                      "n_spans", "rest")


def op3_bwt_merge_dedup(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
